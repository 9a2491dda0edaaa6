"""Token ids of texts by the public byte-level BPE vocabulary.

The ids are those that the ``tokenizers`` library gives for the vocabulary's JSON
file. They are computed from the same vocabulary's rank file by ``tiktoken``, which
is several times faster; tests hold the two against each other. The JSON file also
lists added tokens (``<|endoftext|>``): the library cuts texts at them by default, and
so does ``token_ids`` with added=True.
"""

from __future__ import annotations

from array import array

VOCABULARY = "byte_bpe_50k"


def rank_file(vocabulary: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the vocabulary's JSON file beside its rank file; none where there is no such file."""
    import json
    from pathlib import Path

    whole = Path(path).with_suffix(".json")
    if not whole.exists():
        return {}
    return {t["content"]: t["id"] for t in json.loads(whole.read_text(encoding="utf-8")).get("added_tokens", [])}


def encoder(path: str):
    """The encoding of a rank file, built once in each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    from tiktoken import registry

    name = f"ranks:{path}"
    if name not in registry.ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
    return registry.ENCODINGS[name]


def token_ids(encoding, text: str, added: bool = False) -> array:
    """Ids of a text, as unsigned 32-bit integers; with added, strings of added tokens are their own ids, else ordinary text."""
    if not text:
        return array("I")
    return array("I", encoding.encode(text, allowed_special="all") if added else encoding.encode_ordinary(text))
