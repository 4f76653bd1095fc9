"""BM25 and multipliers as column expressions (fixed values: the weights below)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25_score(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    """Log-damped tf; 0 where the mean length is 0 and the length is not, as the limit is."""
    damped = F.ln(1 + tf)
    norm = F.when(mean > 0, 1 - B + B * length / F.when(mean > 0, mean))
    return F.when(mean > 0, idf * damped * (K1 + 1) / (damped + K1 * norm)).when(length > 0, F.lit(0.0)).otherwise(idf * damped * (K1 + 1) / (damped + K1 * (1 - B)))


def zone_weight(zone: Column) -> Column:
    return F.when(zone == 0, 2.0).otherwise(0.25)


def definition_weight(is_def: Column) -> Column:
    return F.when(is_def == 2, 8.0).when(is_def == 1, 5.0).when(is_def == -1, 2.0).otherwise(1.0)


def unique_weight(unique: Column, total: Column) -> Column:
    return F.when((total > 0) & (unique > 0), 1 + unique / F.when(total > 0, total) * 0.5).otherwise(1.0)


def comment_weight(ratio: Column) -> Column:
    return F.greatest(1 - 0.5 * ratio, F.lit(0.5))


def path_role(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))

    def under(*names: str) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | p.contains("/" + n) | p.startswith(n)
        return hit

    return F.when(under("src/"), 2.0).when(under("test", "spec"), 0.6).when(under("deps/", "vendor/"), 0.3).when(under("scripts/"), 0.6).when(p.rlike(r"\.(md|rst|txt)\z"), 0.25).otherwise(1.0)


def filename_coverage(path: Column, raw: Sequence[str]) -> Column:
    """1 + the share of the query's terms, repeats counted, that the lower-cased path contains (dash and underscore alike)."""
    p, n = F.lower(path), F.lit(0)
    for t in raw:
        t = t.lower()
        hit = p.contains(t) | p.contains(t.replace("_", "-")) | p.contains(t.replace("-", "_"))
        n = n + F.when(hit, 1).otherwise(0)
    return 1 + n / F.lit(max(len(raw), 1))


def proximity(first_lines: Column, gap: int = 10) -> Column:
    """Weight for the least distance between the first lines of different terms."""
    s = F.sort_array(first_lines)
    least = F.array_min(F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: x - F.get(s, i)))
    return F.when((F.size(s) >= 2) & (least <= gap), 1 + (gap - least + 1) / F.lit(float(gap)) * 0.5).otherwise(1.0)


def proximity_bonus(sets: Column, gap: int = 10) -> Column:
    """Half the mean, over pairs of line sets, of the closeness of their nearest lines; 0 beyond the gap and for fewer than two sets.

    ``gap`` 0 counts the same line as infinitely close.
    """
    near = lambda a, b: F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))
    close = lambda d: F.when(d <= gap, (gap - d + 1) / F.lit(float(gap)) if gap else F.lit(float("inf"))).otherwise(F.lit(0.0))
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.filter(sets, lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(close(near(p["a"], p["b"])), F.lit(0.0)))
    n = F.size(sets) * (F.size(sets) - 1) / 2
    return F.when(F.size(sets) < 2, 0.0).otherwise(total / F.when(n > 0, n) * 0.5)


def classify_definition(df: Column, entropy: Column) -> Column:
    """2, 1, 0 or -1 by rarity and by how varied the left contexts are (null: unknown)."""
    rare = df < 20
    return F.when(rare & (entropy < 1), 2).when(rare & (entropy < 2), 1).when(~rare & (entropy > 2.5), 0).when(entropy.isNotNull(), 1).when(df < 10, -1).otherwise(0)


def override_definition(is_def: Column, zone: Column, df: Column, entropy: Column) -> Column:
    known = (zone == 0) & entropy.isNotNull()
    return F.when(known & (df < 20) & (entropy < 1), 2).when(known & (df < 20) & (entropy < 2), F.greatest(is_def, F.lit(1))).when(known & (df >= 20) & (entropy > 2.5), 0).otherwise(is_def).cast("int")
