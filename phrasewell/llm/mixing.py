"""Mixing sources to target word counts (operator 1) by Efraimidis-Spirakis sampling.

Every source gets a target number of words.  Complete epochs of a source come
first; for the rest of its target, documents are taken in the order of the
exponential key ``-ln(u) / weight`` (smallest first), where ``u`` is a
hash of the document, until the prefix sum of their sizes meets the target.

The prefix sum is distributed: sizes are summed per (source, key bucket), a
running sum over buckets finds the bucket each target falls in, and only that
bucket is ordered row by row.  A bucket is a thousandth of a factor of two on the key's scale,
so whatever the weights are it holds under 0.1 % of a source's rows; rows that are repeated
are counted, not sorted one by one.  Targets are computed on tables: the driver sees sums, whatever the number of sources.

Null sources form a source of their own, last in order.  Null or blank texts
have size 0 and are never taken in part: they come along with each complete
epoch.  Very long texts are counted whole; one that crosses its target is taken if that brings the source nearer.
Ties in the key go by row hash.  Repeated rows (equal doc_id and text) tie in both, and
are interchangeable: as many of them are taken as fit.  Other columns pass through :func:`mixed_documents`,
where rows are told apart by all their columns; :func:`mix` has columns of its own only.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_words, materialize

#: Bits of a key's mantissa that tell buckets apart.
BUCKET_BITS = 10
#: Rounds in which capped sources are found; each caps one more source at least.
MAX_ROUNDS = 10_000


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Target per source: ``share`` of all sizes dealt by weight, none above ``most`` times its source's size.

    The definition, for few sources on the driver; :func:`target_table` computes the same on tables.  ``weights`` repeat over the sources by code point, null last; what a capped
    source can't take is dealt again by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def text_weight(text: Column) -> Column:
    """Quality weight in (0, 1]: falls with the share of symbol characters among all."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.05), 1 - 20 * F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def target_table(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes (source, words)`` with ``target``.

    Sources are numbered in order by range partitions; then capped sources are dealt out in rounds, of
    which the driver sees sums only.
    """
    at = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = materialize(at.withColumn("part", F.spark_partition_id()), "sources")
    before = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = before.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("skip"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("skip")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    at = materialize(at.join(before, F.col("part") == F.col("p")).select("source", "words", weight.alias("weight")), "weighed")
    total = at.agg(F.sum("words")).first()[0]
    rate, cap = 0.0, F.col("words") * F.lit(float(most))
    for _ in range(MAX_ROUNDS):
        over = F.col("weight") * rate > cap if rate else F.lit(False)
        r = at.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        now = max(rate, (share * (total or 0) - r["capped"]) / r["open"]) if r["open"] else rate
        if now == rate:
            break
        rate = now
    return at.select("source", "words", F.least(F.col("weight") * rate, cap).alias("target"))


def row_hash(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """The hash that orders ties of :func:`mix`."""
    return F.xxhash64(F.lit(seed + 1), doc_id, text)


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, quality: Column | None, seed: int) -> list[Column]:
    quality = text_weight(docs[text]) if quality is None else quality
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[doc_id], docs[text]), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return [docs[doc_id].alias("doc_id"), docs[source].alias("source"), count_words(docs[text]).alias("size"), (-F.ln(u) / quality).alias("key"), row_hash(docs[doc_id], docs[text], seed).alias("tie")]


def bucket(key: Column) -> Column:
    """A key's place on its logarithmic scale: the exponent and ``BUCKET_BITS`` bits of the mantissa."""
    step = F.lit(float(1 << BUCKET_BITS))
    exponent = F.floor(F.log2(key))
    return (exponent * step + F.floor((key / F.pow(F.lit(2.0), exponent) - 1) * step)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, epochs, copies, taken, tie`` (``tie``: row hash).

    ``taken`` counts words over all repeats; a document comes at most
    ``ceil(most)`` times.  Reruns agree: keys depend on the rows alone.
    """
    slim = materialize(docs.select(*_keyed(docs, doc_id, text, source, quality, seed)), "mix")
    return _taken(slim, weights, share, most).select("doc_id", "source", "size", "source_size", "target", "epochs", "copies", "taken", "tie")


def _taken(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``slim (source, size, key, tie, ...)`` with ``source_size, target, epochs, copies, taken``: a row for each row."""
    names = slim.columns
    slim = slim.withColumn("bucket", bucket(F.col("key")))
    per_bucket = materialize(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    goal = target_table(per_bucket.groupBy("source").agg(F.sum("words").alias("words")), weights, share, most)
    epochs = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    plan = goal.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("words")).alias("rest"))
    plan = materialize(plan, "mix-targets")

    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edges = per_bucket.withColumn("until", running).join(plan.select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
    # The bucket in which the running sum first passes the rest; no row: the whole source fits or the rest is 0.
    edges = edges.where((F.col("until") > F.col("rest")) & (F.col("until") - F.col("words") <= F.col("rest")) & (F.col("words") > 0)).select(F.col("source").alias("e"), F.col("bucket").alias("edge"), (F.col("rest") - (F.col("until") - F.col("words"))).alias("budget"))
    plan = materialize(plan.join(edges, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "mix-plan")
    # Whether the plan is sent whole is left to its size; a source's rows need not meet.
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    on_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    within = (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))) & (F.col("rest") > 0)
    outside = rows.where(~on_edge).withColumn("extra", F.when(within, 1).otherwise(0))
    # On the edge, equal rows of an input partition are one row with their number, dealt out again after the prefix sum.
    facts = ["source_size", "target", "epochs", "rest", "edge", "budget"]
    inside = rows.where(on_edge).withColumn("part", F.spark_partition_id())
    inside = inside.groupBy(*names, "bucket", *facts, "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("key", "tie", *(c for c in names if c not in ("source", "key", "tie")), "part").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("size") * F.col("n")).over(upto) - F.col("size") * F.col("n")
    # The document that crosses the budget is taken if that brings the source nearer to its target.
    fit = F.when(F.col("size") > 0, F.floor((F.col("budget") - before - F.col("size") / 2) / F.col("size")) + 1).otherwise(F.when(before <= F.col("budget"), F.col("n")).otherwise(0))
    inside = inside.withColumn("fit", F.greatest(F.lit(0), F.least(fit, F.col("n"))))
    inside = inside.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("extra", F.when(F.col("k") <= F.col("fit"), 1).otherwise(0))
    copies = F.col("epochs") + F.col("extra")
    columns = [*names, "source_size", "target", "epochs", copies.alias("copies"), (F.col("size") * copies).alias("taken")]
    return outside.select(*columns).unionByName(inside.select(*columns))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: ``docs``, each row as often as :func:`mix` takes it.

    Rows are told apart by a 128-bit hash of all their columns; only rows equal in every column are pooled, and one of them comes as often as all together.
    """
    every = [F.to_json(docs[f.name]) if isinstance(f.dataType, T.MapType) else docs[f.name] for f in docs.schema.fields]
    # Hashes skip nulls, so where they stand is hashed as well.
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in every))
    h1, h2 = F.xxhash64(F.lit(seed + 2), nulls, *every), F.xxhash64(F.lit(seed + 3), nulls, *every)
    slim = materialize(docs.select(*_keyed(docs, doc_id, text, source, quality, seed)[1:], h1.alias("r1"), h2.alias("r2")), "mix")
    plan = _taken(slim, weights, share, most).groupBy("r1", "r2").agg(F.sum("copies").alias("copies")).where("copies > 0")
    plan = materialize(plan, "mix-copies")
    # One row of equal ones stays, and meets its number of copies in the same partition: texts move once.
    named = docs.select(h1.alias("__r1"), h2.alias("__r2"), F.struct(*docs.columns).alias("__row"))
    named = named.groupBy("__r1", "__r2").agg(F.first("__row").alias("__row"))
    out = named.join(plan.hint("merge"), (F.col("__r1") == F.col("r1")) & (F.col("__r2") == F.col("r2")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
