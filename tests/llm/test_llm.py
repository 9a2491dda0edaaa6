"""Small cases of every operator: brute force, round trips, and nulls, empties, repeats and clashing names."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import components, decontaminate, katz, language, media, ngram_join, packing, pii, quality, rollup, tokens, toxicity
from skyloom.llm.common import settings, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, spans string, key string, w string, h long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "w", 1) for i, t in rows], SCHEMA)


WORDS = [f"word{k}" for k in range(400)]
BASE = " ".join(WORDS[:100])
ODD = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("word50", "other")), (4, None), (5, ""), (6, "  \n "), (7, "two words"), (8, "two words"), (9, " ".join(WORDS[200:300])), (None, BASE), (10, "ÿé 😀 " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).where("false")


def shingles(t):
    w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_classes(rows):
    ids = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t in ids]
    link = [[bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for b in range(len(ids))] for a in range(len(ids))]
    label = list(range(len(ids)))
    for _ in ids:
        for a in range(len(ids)):
            for b in range(len(ids)):
                if link[a][b]:
                    label[a] = label[b] = min(label[a], label[b])
    out = []
    for a, (i, _) in enumerate(ids):
        out.append((i, min(ids[b][0] for b in range(len(ids)) if label[b] == label[a]), sum(link[a][b] for b in range(len(ids)) if b != a)))
    return sorted(out)


def test_ngram_join_odd_cases(odd, none):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_classes(odd).collect() if r.doc_id is not None)
    assert got == expected_classes(ODD)
    assert ngram_join.similar_classes(none).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 9, 10] and None in kept


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    """Different texts under one id: each has its own links, whatever else has its id."""
    other = " ".join(WORDS[150:250])
    rows = [(1, BASE), (1, other), (2, BASE.replace("word50", "new")), (3, other.replace("word200", "new"))]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_classes(docs(spark, rows)).collect())
    assert got == expected_classes(rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs(spark, rows)).collect()) == [1, 1]


def test_ngram_join_large_groups(spark, monkeypatch):
    """Groups beyond one task's size are verified band by band and in pairs of blocks, with the same result."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        w = WORDS[:80].copy()
        for k in rng.integers(0, 80, 2):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    expected = expected_classes(rows)
    monkeypatch.setattr(ngram_join, "UNIT_MEMBERS", 10)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_classes(docs(spark, rows)).collect())
    assert got == expected


def test_ngram_join_few_long_members(spark, monkeypatch):
    """A few long near copies are cut into more blocks than they fill; pairs within a block count once all the same."""
    two_of_four = [r.id for r in spark.range(100).where("pmod(xxhash64(id), 4) < 2").limit(5).collect()]
    rows = [(i, " ".join([*WORDS[:80], f"end{i}"])) for i in two_of_four]
    monkeypatch.setattr(ngram_join, "UNIT_GRAMS", 200)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_classes(docs(spark, rows)).collect())
    assert got == expected_classes(rows)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


E1, C1, P1 = "ana.b@mail.example.com", "4111 1111 1111 1111", "+1 (212) 555-0100"


def brute_spans(t):
    luhn = lambda d: sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_pii_base_spans(spark, none):
    rng = np.random.default_rng(2)
    alphabet = list("a1@.+- ()4é5\n") + ["@x.co", "12.3.4.5", "4111111111111111", "+1 212 555 0100 ", "256.1.1.1", "0041 1111"]
    rows = [(i, "".join(rng.choice(alphabet, 60))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, f"é {E1}, {C1} {P1} 10.0.0.1"), (902, f"{E1}_{E1}"), (903, "1" * 30000), (904, "a" * 30000 + "@b.c"), (None, E1), (905, "1 " * 20000)]
    base = lambda x: ",".join(p for p in x.split(",") if not p.startswith("term"))
    got = sorted((r.doc_id or -1, base(r.spans), r.base_sha256) for r in pii.report(docs(spark, rows)).collect())
    want = sorted((i or -1, brute_spans(t or ""), hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want
    assert pii.report(none).count() == 0


def test_pii_terms_and_sanitising(spark):
    fill = lambda k: " ".join(WORDS[(k * 7) % 300 : (k * 7) % 300 + 12])
    rows = [(i, f"{fill(i)} write to Zelenka{'' if i % 2 else '!'} {E1} {fill(i + 3)}") for i in range(6)] + [(100 + i, fill(i) + " write to nobody") for i in range(150)]
    out = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect()}
    for i in range(6):
        assert E1 not in out[i].text and "[EMAIL]" in out[i].text and "zelenka" not in out[i].text.lower() and "write to [TERM]" in out[i].text
        assert out[i].n_chars == len(out[i].text) and out[i].w == "w"
    assert all(out[100 + i].text == rows[6 + i][1] for i in range(150))


def test_pii_term_near_many_entities_of_one_text(spark):
    """A term near 50 other entities of the same text is in one text: the windows don't count as texts."""
    spot = lambda k, mail: f"{WORDS[k]} Zelenka {mail} {WORDS[k + 100]} " + "1 2 3 . " * 30
    text = "".join(spot(k, E1) for k in range(3)) + "".join(spot(3 + k, f"u{k}@x.org") for k in range(50))
    rows = [(1, text)] + [(100 + i, f"nothing number {i} here") for i in range(400)]
    spans = {r.doc_id: r.spans for r in pii.report(docs(spark, rows)).collect()}
    assert spans[1].count("term:") == 53


def test_pii_words_that_the_window_cuts(spark):
    """Pieces of words at a window's edge or beside a span are no terms."""
    edge = "x" * 73  # with a space on each side, the window's edge lies within Casanova
    near = spark.createDataFrame([(f"Casanova {edge} naïveé{E1}é {edge} Casanova",), (f"Anna {E1} Eva",)], "text string").withColumn("s", F.explode(pii.base_spans("text")))
    assert {w for r in near.select(pii._words_near(F.col("text"), F.col("s")).alias("w")).collect() for w in r.w} == {edge, "anna", "eva"}


def test_pii_terms_of_copied_texts(spark):
    """Copies change no degree: a name that occurs with one entity alone is found, a name beside two is not."""
    rows = [(i, f"{WORDS[i % 5]} Zelenka {E1} {WORDS[50 + i % 5]}") for i in range(200)]
    rows += [(300 + i, f"{WORDS[i % 5]} Horak {mail} {WORDS[50 + i % 5]} for {mail}") for i, mail in enumerate(["a@x.org", "b@x.org"] * 20)]
    rows += [(1000 + i, f"nothing number {i} here") for i in range(20)]
    for some in (rows, [r for k, r in enumerate(rows) if r[1] not in {t for _, t in rows[:k]}]):
        spans = {r.doc_id: r.spans for r in pii.report(docs(spark, some)).collect()}
        assert spans[0].count("term:") == 1 and not spans[300].count("term:")


def test_pii_terms_in_any_script_and_removal(spark):
    """Terms are found in the text in any case of any alphabet; those at REMOVE or more are deleted, those below replaced."""
    names = ["Élodie", "ÉLODIE", "élodie", "Γιώργος", "ΓΙΏΡΓΟΣ", "İzmir", "Özdemir", "ÖZDEMIR", "Жанна", "ЖАННА"]
    seen = {n: [k for k, m in enumerate(names) if pii_fold(m) == pii_fold(n)] for n in names}
    rows = [(10 * i + j, f"{WORDS[9 * i + j]} {name} {mail(seen[name][0])}") for i in range(4) for j, name in enumerate(names)]
    rows += [(500 + i, f"{WORDS[i + 100]} Horak {E1} {WORDS[i + 200]}") for i in range(20)] + [(600 + i, f"Horak {i}") for i in range(15)]
    rows += [(1000 + i, f"nothing number {i} here") for i in range(400)]
    table = docs(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.report(table).collect()}
    texts = dict(rows)
    assert all(f"term:{texts[i].index(name)}:{texts[i].index(name) + len(name)}" in spans[i] for i in range(40) for name in [names[i % 10]])
    removed, replaced = ({r.doc_id: r.text for r in pii.sanitise(table, remove=x).collect()} for x in (True, False))
    assert all(removed[i] == texts[i].split()[0] + "  [EMAIL]" and replaced[i] == texts[i].split()[0] + " [TERM] [EMAIL]" for i in range(40))
    assert removed[500] == replaced[500] == f"{WORDS[100]} [TERM] [EMAIL] {WORDS[200]}" and removed[600] == "Horak 0"


def pii_fold(name):
    return name.replace("İ", "i").lower().replace("ς", "σ")


def mail(k):
    return f"user{k}@x.org"


def test_pii_folding_keeps_places(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    chars = spark.createDataFrame([("".join(map(chr, points[k : k + 4096])),) for k in range(0, len(points), 4096)], "t string")
    assert chars.where(F.length(pii._folded(F.col("t"))) != F.length("t")).count() == 0


def test_media_round_trip(spark, odd, none):
    rows = ODD + [(20, "x" * 600_000)]
    got = media.read_jpeg(media.store_as_jpeg(docs(spark, rows))).collect()
    want = []
    for i, t in rows:
        p = (t or "").encode()
        padded = p + bytes(max(64, -(-len(p) // 64) * 64) - len(p))
        want.append((i or -1, len(p), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same = {r.payload_sha256: (r.media_sha256, r.feature) for r in got}
    assert all(same[r.payload_sha256] == (r.media_sha256, r.feature) for r in got)
    assert media.read_jpeg(media.store_as_jpeg(none)).count() == 0


def test_media_reads_the_stored_markers(spark):
    """A comment segment changes no sample; a broken marker is an error."""
    r = media.store_as_jpeg(docs(spark, [(1, "stored " * 40)])).first()
    seg, data = media._segment, bytes(r.media)
    noted = data[:2] + seg(0xFE, b"note \xff") + data[2:]
    plain, again = (media.decode_dc(x, media.parse_frames(x, 0, len(x), 0))[0] for x in (data, noted))
    assert (plain == again).all()
    with pytest.raises(ValueError, match="marker"):
        media.parse_frames(data[:2] + b"\0" + data[3:], 0, len(data), 0)


def test_media_reads_colour_with_ac_terms():
    """Three components, 2x2 luminance sampling and AC terms: bits are written by hand, DC levels read back."""
    dc = media.huffman_codes(media.DC_COUNTS, media.DC_SYMBOLS)
    ac_counts, ac_symbols = bytes([0, 3] + [0] * 14), bytes([0x00, 0x01, 0xF0])
    ac = media.huffman_codes(ac_counts, ac_symbols)
    rng = np.random.default_rng(4)
    luma = rng.integers(0, 256, (2, 4))
    bits, last = "", [0, 0, 0]

    def block(component, level):
        nonlocal bits
        d, last[component] = level - 128 - last[component], level - 128
        s = abs(d).bit_length()
        code, n = dc[s]
        bits += f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
        for symbol, extra in ((0x01, "1"), (0xF0, ""), (0x01, "0"), (0x00, "")):
            code, n = ac[symbol]
            bits += f"{code:0{n}b}" + extra

    for mcu in range(2):
        for v in range(2):
            for h in range(2):
                block(0, int(luma[v, 2 * mcu + h]))
        block(1, 77)
        block(2, 200)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS) + seg(0xC4, b"\x10" + ac_counts + ac_symbols) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    frames = media.parse_frames(data, 0, len(data), 0)
    assert (frames[0].width, frames[0].height) == (32, 16)
    assert (media.decode_dc(data, frames)[0] == luma).all()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_equals_naive_discriminant(spark):
    """Scores by dense covariances and explicit inverses, from statistics that were collected."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.3 * (i % 2) else w for w in rng.choice(WORDS, int(rng.integers(5, 60))))) for i in range(200)]
    table, marks = docs(spark, rows), labels_of(spark, [(i, i % 2, 0) for i in range(200)])
    x = {r.doc_id: np.asarray(r.features) for r in quality.featurise(table).collect()}
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0]
    by = {k: np.stack([x[i] for i in learned if i % 2 == k]) for k in (0, 1)}
    pool = sum(len(v) * np.cov(v.T, bias=True) for v in by.values()) / len(learned)
    scale = 1 / np.sqrt(np.maximum(np.diag(pool), 1e-6))
    logs = {}
    for k, v in by.items():
        c = 0.9 * np.cov((v * scale).T, bias=True) + 0.1 * pool * np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = {i: f * scale - (v * scale).mean(0) for i, f in x.items()}
        logs[k] = {i: np.log(len(v) / len(learned)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * e @ np.linalg.inv(c) @ e for i, e in d.items()}
    got = {r.doc_id: (r.score, r.predicted) for r in quality.classify(table, marks).collect()}
    for i in x:
        want = 1 / (1 + np.exp(np.clip(logs[0][i] - logs[1][i], -700, 700)))
        assert abs(got[i][0] - want) < 1e-6 and got[i][1] == int(got[i][0] >= 0.3)


def small_network(rng):
    langs = ["de", "en"]
    return toxicity.Network(
        rng.standard_normal(((2 + len(toxicity.PREFIXES)) << toxicity.BUCKET_BITS, toxicity.DIM)).astype(np.float32) * 0.3,
        [rng.standard_normal((w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.standard_normal(toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.standard_normal(len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), 0.3, langs,
        rng.standard_normal((1 << toxicity.LANG_BITS, 2)).astype(np.float32), np.asarray([0.2, -0.4]),
    )


def naive_logit(net, ids):
    """The network's output for one document, word by word."""
    mask = (1 << toxicity.BUCKET_BITS) - 1
    vec = [net.embedding[int(r[0]) & mask] + net.embedding[(int(r[0]) >> (32 - toxicity.BUCKET_BITS)) + mask + 1] + sum(net.embedding[(int(x) & mask) + (2 + k) * (mask + 1)] for k, x in enumerate(r[1:])) for r in ids]
    pooled = []
    for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
        for c in range(toxicity.FILTERS):
            at = [sum(float(vec[p + j] @ f[j][:, c]) for j in range(w) if p + j < len(vec)) for p in range(len(vec))]
            pooled.append(max(0.0, max(at) + float(b[c])) if at else 0.0)
    return float(np.dot(pooled, net.out) + net.out_bias)


def test_toxicity_equals_naive_forward_pass_and_numeric_gradients():
    rng = np.random.default_rng(12)
    net = small_network(rng)
    texts = ["one two three four five", "ÄPFEL und birnen", "", "word", "a b c d e f g h a b"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    ids, at = toxicity.word_ids(raw, offsets)
    z = [naive_logit(net, ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(net.logits(ids, at), z, atol=1e-4)
    for n, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        lang = int(np.argmax(sum((net.odds[int(r[0]) >> (32 - toxicity.LANG_BITS)] for r in ids[i:j]), np.zeros(2))))
        assert abs(net.score(ids, at)[n] - 1 / (1 + np.exp(-(z[n] - net.shift[lang])))) < 1e-4
    x, where = net.pooled(ids, at, True)
    g = np.asarray([1.0, -0.5, 0.3, 0.8, 0.2], np.float32)
    d_filters, d_bias, rows, total = toxicity.gradients(net, ids, at, x, where, g)
    loss = lambda: float(sum(a * b for a, b in zip(g, [naive_logit(net, ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], strict=True)))
    for array, grad, place in [(net.filters[1], d_filters[1], (0, 2, 1)), (net.filters[2], d_filters[2], (2, 0, 3)), (net.bias[0], d_bias[0], (4,)), *[(net.embedding, {(int(r), 3): t[3]}, (int(r), 3)) for r, t in list(zip(rows, total, strict=True))[:3]]]:
        kept, base, eps = array[place], loss(), 1e-3
        array[place] = kept + eps
        numeric = (loss() - base) / eps
        array[place] = kept
        assert abs(numeric - float(grad[place])) < 2e-2 * max(1, abs(numeric))


def test_toxicity_trains_and_adds_up_in_one_worker_a_task(spark):
    rows = spark.range(12).selectExpr("'a word' AS text", "CAST(id % 2 AS INT) AS label", "'en' AS lang", "id AS doc_id", "CAST(id % 6 AS INT) AS shard", "CAST(id % 3 AS INT) AS fold")
    plan = toxicity._changes(rows, ["en"], None)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("InArrow") == 1 and "FlatMap" not in plan


def test_toxicity_shards_go_on_over_batches():
    kind = pa.schema([("text", pa.string()), ("label", pa.int32()), ("lang", pa.string()), ("doc_id", pa.int64()), ("shard", pa.int32()), ("fold", pa.int32())])
    shards = [0, 0, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_pylist([{"text": "x", "label": 0, "lang": "en", "doc_id": i, "shard": shards[i], "fold": shards[i] % 3} for i in own], kind) for own in (range(0, 3), [], range(3, 4), range(4, 8))]
    got = [(fold, [i for b in own for i in b.column("doc_id").to_pylist()]) for fold, own in toxicity._shards(iter(batches))]
    assert got == [(0, [0, 1]), (0, [2, 3, 4]), (1, [5]), (2, [6, 7])]
    assert list(toxicity._shards(iter(batches[1:2]))) == []


def test_toxicity_thresholds_by_brute_force():
    rng = np.random.default_rng(8)
    z, lang, y = rng.normal(size=400), rng.integers(0, 3, 400), rng.integers(0, 2, 400)
    z = np.round(z + y, 1)
    y[lang == 2] = 0  # a language of one class takes the cut of all
    got = toxicity.thresholds(z, lang, y, 4)

    def errors(own, cut):
        return int(((z[own] >= cut) != (y[own] == 1)).sum())

    for k in range(4):
        own = np.flatnonzero(lang == k) if k < 2 else np.arange(400)
        cuts = [*np.unique(z[own]), z.max() + 1]
        assert errors(own, got[k]) <= min(errors(own, c) for c in cuts) + np.bincount(np.searchsorted(np.unique(z[own]), z[own])).max()
    assert got[2] == got[3]
    clear = toxicity.thresholds(np.array([-1.0] * 30 + [3.0] * 30), np.zeros(60, int), np.array([0] * 30 + [1] * 30), 1)
    assert clear.tolist() == [1.0]


def test_toxicity_no_document_sets_a_threshold_by_its_own_network(monkeypatch):
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda d, y, x: (seen.append(len(d)), fit(d[:1], y[:1], x[:1]))[1])
    docs_, labels = [np.zeros((2, 1 + len(toxicity.PREFIXES)), np.uint32)] * 10, np.arange(10) % 2
    toxicity.train(docs_, labels, ["en"] * 10)
    assert seen == [10, 6, 7, 7]


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, "bad word " * 20 if i % 2 else "good word " * 20) for i in range(400)] + [(400, "x" * 300_000)]
    marks = labels_of(spark, [(i, 1, i % 2) for i in range(401)] + [(1, 1, 1)])
    got = toxicity.sample(docs(spark, rows), marks, most=100)
    assert 50 < got.count() < 160 and not {r.doc_id for r in got.collect()} & {i for i in range(401) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert toxicity.sample(docs(spark, rows), marks, most=10_000, most_bytes=1).count() < 20


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(toxicity, "LONGEST", 1000)
    rng = np.random.default_rng(7)
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 400)
    rows = [(i, " ".join([*rng.choice(WORDS, 30), *(["vilewretch"] if i % 3 == 0 else [])])) for i in range(1500)]
    rows += [(9000, "plain " * 300)]
    marks = labels_of(spark, [(i, 1, int(i % 3 == 0)) for i, _ in rows])
    table = docs(spark, rows)
    assert toxicity.labelled(table, marks).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    got = [r for r in toxicity.score(table, toxicity.fit(table, marks)).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got]) > 0.95
    weights = np.array([3, 1, 2]), np.array([-1.0, 0.5, 2.0]), np.array([0, 1, 1])
    plain = toxicity.thresholds(np.repeat(weights[1], weights[0]), np.zeros(6, int), np.repeat(weights[2], weights[0]), 1)
    assert toxicity.thresholds(weights[1], np.zeros(3, int), weights[2], 1, weights[0]).tolist() == plain.tolist()


def test_toxicity_networks_are_the_same_over_any_partitions_and_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 100)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join([*rng.choice(WORDS, 12), *(["vilewretch"] if i % 3 == 0 else [])])) for i in range(300)]
    table, marks = docs(spark, rows), labels_of(spark, [(i, 1, int(i % 3 == 0)) for i, _ in rows])
    folder = f"{shared_dir(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    nets, frame = [toxicity.fit(table, marks)], type(table)
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(n, 40) if cols and isinstance(n, int) else n, *cols))
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    with settings(spark, {"spark.sql.shuffle.partitions": "40"}):
        nets.append(toxicity.fit(table, marks))
    assert np.allclose(nets[0].embedding, nets[1].embedding, atol=1e-5) and nets[0].shift.tolist() == nets[1].shift.tolist()
    assert set(os.listdir(folder)) <= before
    blocks = [toxicity._block(0, 0, 2, np.array([1.0, 2.0])), toxicity._block(1, 0, 1, np.array([5.0, 0.0])), toxicity._block(0, 0, 3, np.array([0.5, 1.0]))]
    sums = {(r["k"], r["b"]): (r["n"], np.frombuffer(r["values"], np.float32).tolist()) for batch in toxicity._added(iter(blocks)) for r in batch.to_pylist()}
    assert sums == {(0, 0): (5, [1.5, 3.0]), (1, 0): (1, [5.0, 0.0])}


def test_quality_and_toxicity_learn(spark, odd, none):
    rng = np.random.default_rng(5)
    good = [(i, " ".join(rng.choice(WORDS, 40)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(x.upper() + "!!" for x in rng.choice(WORDS, 40))) for i in range(120)]
    foul = [(2000 + i, " ".join([*rng.choice(WORDS, 30), "vilewretch", *rng.choice(WORDS, 10)])) for i in range(200)]
    rows = good + bad + foul
    marks = labels_of(spark, [(i, int(i < 1000 or i >= 2000), int(i >= 2000)) for i, _ in rows] + [(None, 1, 1), (5, None, None)])
    table = docs(spark, [*rows, *ODD[4:7]])
    q = {r.doc_id: r for r in quality.classify(table, marks).collect()}
    held = [r for r in q.values() if r.held_out and r.doc_id > 10]
    assert np.mean([r.predicted == int(r.doc_id < 1000 or r.doc_id >= 2000) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in q.values()) and quality.classify(table, marks).count() == len(rows) + 3
    t = {r.doc_id: r for r in toxicity.score(table, toxicity.fit(table, marks)).collect()}
    assert np.mean([r.predicted == int(r.doc_id >= 2000) for r in t.values() if r.held_out and r.doc_id > 10]) > 0.95
    blank = labels_of(spark, []).where("false")
    assert {r.score for r in quality.classify(odd, blank).collect()} == {0.5}
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, blank)).collect()} == {0.5}
    assert quality.classify(none, marks).count() == 0 and toxicity.score(none, toxicity.fit(none, marks)).count() == 0


def naive_ppm(sample, text):
    """Bits of a text after a sample, by dictionaries: prediction by partial matching with exclusion over bytes."""
    def coded(t):
        t = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m.group().lower(), t)
        return re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", t).encode()

    seen = {}
    for t in sample:
        b = b"   " + coded(t)
        for i in range(3, len(b)):
            for k in range(4):
                own = seen.setdefault(b[i - k : i], {})
                own[b[i]] = own.get(b[i], 0) + 1

    def p(context, x):
        lower = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 256)
        own = seen.get(context)
        if not own:
            return lower(x)
        total, escape = sum(own.values()), len(own) / (sum(own.values()) + len(own)) if len(own) < 256 else 0.0
        return own[x] / total * (1 - escape) if x in own else escape * lower(x) / (1 - sum(lower(y) for y in own))

    b = b"   " + coded(text)
    return -sum(np.log2(p(b[i - 3 : i], b[i])) for i in range(3, len(b))), p


def test_language_equals_naive_ppm():
    sample = ["The cat, the hat & ÄPFEL aß", "привет мир", "日本語 12 the end", ""]
    raw = np.frombuffer("".join(sample).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in sample]])
    codes, counts = np.unique(language.symbols(raw, offsets)[2], return_counts=True)
    trees = language.ContextTrees(["x"], [language.build_tree(codes, counts.astype(float))])
    texts = ["the cat and the HUT", "Мир приветов", "日本", "", "q!!  12", "ÄPFEL"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    assert np.allclose(trees.code_lengths(raw, offsets)[:, 0], [naive_ppm(sample, t)[0] for t in texts])
    p = naive_ppm(sample, "")[1]
    for context in (b"the", b" th", b"zzz", b"   ", "日".encode()):
        assert abs(sum(p(context, x) for x in range(256)) - 1) < 1e-9
        codes = (np.uint32(int.from_bytes(context, "big")) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert abs((2.0 ** -trees.trees[0].cost(codes)).sum() - 1) < 1e-9


def test_language_odd_cases(spark, odd, none):
    rows = [(i, "the cat sat on the mat and that is that", "en") for i in range(30)] + [(100 + i, "der hund und die katze sind nicht da", "de") for i in range(30)] + [(200 + i, "это просто текст на русском языке", "ru") for i in range(30)]
    table = spark.createDataFrame([*rows, (500, "the hat", None), (501, "die hunde", None), (502, None, None), (503, " 12 ", None), (504, "русский язык", None), (505, "x" * 200_000 + " the cat" * 9, None), (504, "русский язык", None)], "doc_id long, text string, lang string")
    trees = language.fit(table)
    got = {r.doc_id: r.lang_pred for r in language.identify(table, trees).collect()}
    assert [got[i] for i in (500, 501, 502, 503, 504)] == ["en", "de", "und", "und", "ru"] and got[505] in ("en", "de", "ru")
    assert language.identify(table, trees).count() == len(rows) + 7
    same = language.ContextTrees(["a", "b"], [trees.trees[0]] * 2)  # ties: the first by name
    assert {r.lang_pred for r in language.identify(table, same).collect()} == {"a", "und"}
    found = language.identify(odd, trees).collect()
    assert len(found) == len(ODD) and all(r.held_out is not None for r in found)
    assert language.identify(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_packing_is_gapless(spark, none):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 1200))))) for i in range(150)] + [(900, None), (901, ""), (901, ""), (None, "a b"), (902, "x " * 9000)]
    got = packing.pack_documents(docs(spark, rows)).toPandas()
    encoding = tokens.encoder(tokens.rank_file())
    want = sorted((-1 if i is None else i, len(tokens.token_ids(encoding, t or "")) + 1) for i, t in rows)
    ids = got["doc_id"].fillna(-1).astype(int)
    assert got.groupby(ids)["length"].sum().to_dict() == {i: sum(n for j, n in want if j == i) for i, _ in want}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2
    assert packing.pack_documents(none).count() == 0


def test_token_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encoding = tokens.encoder(tokens.rank_file())
    for text in ["", " a  b\n\n c", "I'm he'll", "日本語 😀 é", "x" * 3000, "<|endoftext|>", "\x00\u0085 ١٢"]:
        assert list(tokens.token_ids(encoding, text)) == t.encode(text, add_special_tokens=False).ids


def test_packing_ids_are_the_tokenizers_by_default(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding = tokens.encoder(tokens.rank_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  \n x", "a  <|endoftext|>\n\n b <|endoftext |>", "<|ENDOFTEXT|> é  ", ""]
    for text in texts:
        assert list(tokens.token_ids(encoding, text, added=True)) == t.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs(spark, list(enumerate(texts)))).collect()}
    ids = [np.asarray([*t.encode(x, add_special_tokens=False).ids, packing.SEPARATOR], np.uint32) for x in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


ITEM = " ".join(WORDS[300:340])


def test_decontamination(spark, none):
    w = WORDS[300:340]
    near = " ".join([*w[:38], "changed", "end"])
    rows = [(1, f"{BASE} {ITEM} {BASE}"), (2, BASE), (3, f"start {near}"), (4, f"Start, {ITEM.upper()}!"), (5, " ".join(w[:20])), (6, None), (7, ""), (None, ITEM), (8, ITEM), (8, ITEM), (9, "tiny item")]
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "tiny item"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 1), (8, 1), (9, 4)}
    assert got[1, 1].start == 100 and got[1, 1].similarity == 1.0 and 0.8 <= got[3, 1].similarity < 1
    kept = sorted(r.doc_id for r in decontaminate.clean(docs(spark, rows), bench).collect() if r.doc_id is not None)
    assert kept == [2, 5, 6, 7]
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs(spark, rows), bench.where("false")).count() == 0


@pytest.mark.parametrize(("order", "hot"), [(3, 100_000), (3, 40), (2, 40), (4, 100_000), (1, 100_000)])
def test_katz_equals_brute_force(spark, none, monkeypatch, order, hot):
    """Scores of every order, with hot contexts and without, equal plain recursion over dictionaries."""
    rng = np.random.default_rng(7)
    p = 1 / np.arange(1, 121)
    rows = [(i, " ".join(rng.choice(WORDS[:120], int(rng.integers(0, 60)), p=p / p.sum()))) for i in range(250)] + [(900, None), (901, "A a Ä\x0bb"), (901, "A a Ä\x0bb")] + [(1000 + i, "same words again") for i in range(40)]
    monkeypatch.setattr(katz, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(katz, "HOT", hot)
    want = sorted(katz.brute_force([(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows], order)[0])
    got = sorted(tuple(r) for r in katz.score_documents(docs(spark, rows), order).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_katz_odd_tables(spark, odd, none):
    assert katz.score_documents(none).count() == 0
    got = sorted((r.doc_id or -1, r.n_tokens, r.held_out) for r in katz.score_documents(odd).collect())
    assert got == sorted((i or -1, len((t or "").split()) + 1, i is None or zlib.crc32(str(i).encode()) % 7 == 2) for i, t in ODD)
    unseen = katz.score_documents(odd.where("doc_id is null")).first()
    assert (unseen.train_tokens, unseen.n_known, unseen.base_score, unseen.score) == (0, 0, 0.0, 0.0)


def test_katz_contexts_sum_to_one(spark, monkeypatch):
    """The written tables hold the corpus's counts, and probabilities after any context sum to one."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS[:30], 25))) for i in range(60)]
    monkeypatch.setattr(katz, "HOT", 30)
    trained = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    _, (p, count) = katz.brute_force(trained)
    words = [*{w for w, in count[1]}, "never seen"]
    for history in [(), (0,), (0, 0), ("word3",), ("word3", "word4"), (0, "word9"), ("nobody", "word2"), *[h[:2] for h in list(count[3])[:20] if h[1] is not None]]:
        assert abs(sum(p(history, w) for w in words) - 1) < 1e-9
    tables = katz.gather(docs(spark, rows))
    for n in (2, 3):
        stored = katz.count_table(tables, n)
        assert sorted(r["count"] for r in stored.collect()) == sorted(count[n].values())
        contexts = {g[:-1] for g in count[n]}
        assert stored.select("context").distinct().count() == len(contexts)
        backoff = {round(r.lost, 6) for r in katz.backoff_table(tables, n).collect()}
        d = tables.d[n]
        assert backoff == {round(sum((1 - d[c]) * c for g, c in count[n].items() if g[:-1] == h and c <= katz.K), 6) for h in contexts}
    tables.discard()


def test_rollup_is_idempotent(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", "en", "v1", 10, 12), ("a", None, "v1", 5, 5), ("a", "en", "v1", 7, 7)], "source string, lang string, tokenizer string, tokens long, new long")
    assert r.totals().count() == 0
    assert r.commit("one", rollup.inserts(rows)) and not r.commit("one", rollup.inserts(rows))
    assert r.commit("two", rollup.deletes(rows.where("tokens = 7"))) and r.commit("three", rollup.revisions(rows.where("tokens = 10"), "new"))
    assert sorted((x.source, x.lang or "", x.n_docs, x.n_tokens) for x in r.totals().collect()) == [("a", "", 1, 5), ("a", "en", 1, 12)]
    with pytest.raises(ValueError):
        r.commit("a/b", rollup.inserts(rows))


def test_rollup_compaction(spark, tmp_path):
    """A sum replaces its batches, batches stay known, and later ones are added."""
    r = rollup.TokenRollup(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", None, "v1", 10, 12), ("a", "en", "v1", 7, 7)], "source string, lang string, tokenizer string, tokens long, new long")
    totals = lambda: sorted((x.source, x.lang or "", x.n_docs, x.n_tokens) for x in r.totals().collect())
    r.compact()
    r.commit("one", rollup.inserts(rows))
    r.compact()
    assert totals() == [("a", "", 1, 10), ("a", "en", 1, 7)] and not r.commit("one", rollup.inserts(rows))
    r.commit("two", rollup.revisions(rows, "new"))
    r.commit("three", rollup.deletes(rows.where("lang = 'en'")))
    for _ in range(2):
        assert totals() == [("a", "", 1, 12)]
        r.compact()
    assert not r.commit("two", rollup.inserts(rows)) and totals() == [("a", "", 1, 12)]


def test_rollup_compaction_keeps_what_comes_between(spark, tmp_path, monkeypatch):
    """A batch committed while a compaction runs counts, and totals asked for before it can still be read."""
    r = rollup.TokenRollup(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", "en", "v1", 10)], "source string, lang string, tokenizer string, tokens long")
    r.commit("one", rollup.inserts(rows))
    before = r.totals()
    held = rollup.TokenRollup._rows

    def commit_meanwhile(self, names):
        found = held(self, names)
        rollup.TokenRollup.commit(self, "between", rollup.inserts(rows))
        return found

    monkeypatch.setattr(rollup.TokenRollup, "_rows", commit_meanwhile)
    r.compact()
    monkeypatch.setattr(rollup.TokenRollup, "_rows", held)
    assert [x.n_tokens for x in r.totals().collect()] == [20] and [x.n_tokens for x in before.collect()] == [10]
    assert not r.commit("between", rollup.inserts(rows))
    middle = r.totals()
    for n in (20, 20):
        r.compact()
        assert [x.n_tokens for x in r.totals().collect()] == [n]
    r.commit("two", rollup.deletes(rows))
    r.compact()
    assert [x.n_tokens for x in r.totals().collect()] == [10]
    assert middle is not None and not any(p.name.endswith(".parquet") for p in (tmp_path / "batch=one").iterdir())  # two compactions later its rows are gone


def test_rollup_odd_cases(spark, odd, none, tmp_path):
    """Null and empty texts, ids and keys, repeated rows and an empty table."""
    got = {r.doc_id if r.doc_id is not None else -1: r.tokens for r in rollup.count_tokens(odd).collect()}
    assert got[4] == got[5] == [0, 0] and got[7] == got[8] and -1 in got
    for name, rows in (("odd", ODD), ("none", [])):
        docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    totals = {r.tokenizer: r.n_docs for r in rollup.op8_token_counts(spark, f"{tmp_path}/odd").collect()}
    copies = sum(t is not None and i is not None and any((u or "") == t and j is not None and j < i for j, u in ODD) for i, t in ODD) + 1  # id 5, empty as id 4
    assert totals == dict.fromkeys(rollup.VERSIONS, len(ODD) - (copies - 1))
    assert rollup.op8_token_counts(spark, f"{tmp_path}/none").count() == 0


def test_rollup_query_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for d in rows:
        first[d.text] = min(d.doc_id, first.get(d.text, d.doc_id))
    want = {}
    for v in rollup.VERSIONS:
        e = tokens.encoder(tokens.rank_file(v))
        for d in rows:
            if first[d.text] == d.doc_id:
                n, t = want.get((d.source, d.lang, v), (0, 0))
                want[d.source, d.lang, v] = (n + 1, t + len(e.encode_ordinary(d.text)) + 1)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.op8_token_counts(spark, sf).collect()}
    assert got == want


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).persist()
        assert d.columns == columns, name
        assert 0.5 * before < d.count() <= before, name
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).agg(F.sum("length")).first()[0] > 0
