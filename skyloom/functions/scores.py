"""Proper scores, Dirichlet summaries and information gain over arrays of probabilities."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.special import digamma, lgamma


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x / total(a))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; zero probabilities add nothing."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)))


def argmax(p: Column) -> Column:
    """Place from 0 of the largest value; the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, label: Column) -> Column:
    return F.get(p, label.cast("int"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def squared_error(p: Column, label: Column) -> Column:
    """Sum over classes of the squared distance from the label's unit vector."""
    return total(F.transform(p, lambda x: x * x)) - 2 * at(p, label) + 1


def brier(p: Column, label: Column) -> Column:
    return 1 - 0.5 * squared_error(p, label)


def brier_correctness(p: Column, label: Column) -> Column:
    return (argmax(p) == label).cast("double") - squared_error(p, label)


def log_score(p: Column, label: Column, eps: float = 1e-7) -> Column:
    return 1 + F.ln(F.greatest(at(p, label), F.lit(eps))) / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double"))


def doubt_score(p: Column, label: Column, eps: float = 0.01) -> Column:
    right = F.ln(clip(at(p, label), eps, 1 - eps))
    return F.when(argmax(p) == label, right).otherwise(F.ln(1 - clip(F.array_max(p), eps, 1 - eps)))


def tsallis(p: Column, label: Column, alpha: float = 1.5, eps: float = 1e-7) -> Column:
    """Log score near alpha 1, Brier score near 2, and between them the power score."""
    if abs(alpha - 1) < 1e-4:
        return log_score(p, label, eps)
    if abs(alpha - 2) < 1e-4:
        return brier(p, label)
    q = F.transform(p, lambda x: clip(x, eps, 1.0))
    return alpha / (alpha - 1) * F.pow(at(q, label), F.lit(alpha - 1)) - total(F.transform(q, lambda x: F.pow(x, F.lit(alpha)))) - 1


def focal_brier(p: Column, label: Column, gamma: float = 2.0) -> Column:
    return 1 - 0.5 * F.pow(1 - clip(at(p, label), 0.0, 1.0), F.lit(gamma)) * squared_error(p, label)


def composite(p: Column, label: Column, brier_weight: float = 1.0, log_weight: float = 0.5, doubt_weight: float = 0.2) -> Column:
    return brier_weight * brier(p, label) + log_weight * log_score(p, label) + doubt_weight * doubt_score(p, label)


def dirichlet_mean(alpha: Column) -> Column:
    return normalise(alpha)


def vacuity(alpha: Column) -> Column:
    return F.size(alpha) / total(alpha)


def dirichlet_error(alpha: Column, p: Column) -> Column:
    """Standard deviation of a class probability p under the Dirichlet."""
    return F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / (total(alpha) + 1)))


def information_gain(alpha: Column) -> Column:
    """Mutual information of label and class probabilities (BALD), at least 0."""
    s = total(alpha)
    expected = F.aggregate(alpha, F.lit(0.0), lambda acc, a: acc - a / s * (digamma(a + 1) - digamma(s + 1)))
    return F.greatest(F.lit(0.0), entropy(normalise(alpha)) - expected)


def dirichlet_divergence(alpha: Column) -> Column:
    """Kullback-Leibler divergence from the uniform Dirichlet."""
    s, k = total(alpha), F.size(alpha).cast("double")
    logs = F.aggregate(alpha, F.lit(0.0), lambda acc, a: acc - lgamma(a) + (a - 1) * (digamma(a) - digamma(s)))
    return lgamma(s) - lgamma(k) + logs


def conformal_set(p: Column, names: Column, level: float, fallback: bool = True) -> Column:
    """Names of the classes with p >= 1 - level; with fallback the top class where none is."""
    found = F.transform(F.filter(F.arrays_zip(p.alias("p"), names.alias("n")), lambda x: x["p"] >= 1 - level), lambda x: x["n"])
    return F.when(F.size(found) == 0, F.array(F.get(names, argmax(p)))).otherwise(found) if fallback else found


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Binomial interval; NULL for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return mid - half, mid + half


def risk_weight(p: Column, doubt: Column, tension: Column, gamma: float = 2.0, most: float = 0.10) -> Column:
    return F.when(tension <= most, p * F.pow(1 - doubt, F.lit(gamma))).otherwise(0.0)


