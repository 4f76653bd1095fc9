"""Sharding by extendible hashing (operator 10).

The directory is indexed by leading bits of each row's hash.  It starts with
one bucket; only a bucket whose rows exceed the byte limit is split on its
next bit, until every shard fits.  Splitting works on a slim table of (hash,
bytes) sums, so texts are read once and never shuffled.

* A single row above the limit becomes a shard of its own once no other row shares its bits.
* Rows that agree in all ``MAX_BITS`` bits (repeated rows) can't be split by
  hashing: they are dealt to numbered overflow shards that each fit the limit.
* Null or empty texts have 0 bytes; very long texts are measured whole.  Any column may be null.  An empty table gives an empty result.
* Writing carries each row's own shard to its file, so rows that repeat, or share a doc_id, are written once each.
  Only a column named ``_shard`` is taken: it becomes the folder, and an input column of that name is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_BITS = 60
STEP = 4


def key_hash(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns' texts, as a non-negative long (reproducible in any SQL engine)."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def directory(sums: DataFrame, limit: int) -> DataFrame:
    """``prefix, depth, shard_bytes``: the leaves of the directory over ``sums (hash, bytes)``.

    Each round looks at oversized buckets only, ``STEP`` bits at a time; within
    a round a bucket stops at the first depth at which it fits.
    """
    done, depth = [], 0
    level = sums.select(F.lit(0).cast("long").alias("prefix"), "hash", "bytes")
    total = sums.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return sums.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    if total["b"] <= limit:
        return sums.sparkSession.createDataFrame([(0, 0, total["b"])], "prefix long, depth int, shard_bytes long")
    while True:
        last = min(depth + STEP, MAX_BITS)
        # Sums at the finest depth of the round, then coarser ones from those: one shuffle of the slim table.
        fine = level.groupBy(F.shiftright("hash", MAX_BITS - last).alias("p")).agg(F.sum("bytes").alias("bytes"))
        fine = materialize(fine, f"directory-{last}")
        at = fine.select("p", "bytes", F.explode(F.sequence(F.lit(depth + 1), F.lit(last))).alias("depth"))
        at = at.withColumn("prefix", F.expr(f"shiftright(p, {last} - depth)")).groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.min("p").alias("low"))
        # The first depth at which the bucket of a fine prefix fits.
        leaf = Window.partitionBy("p").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        paths = fine.select("p", F.explode(F.sequence(F.lit(depth + 1), F.lit(last))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(p, {last} - depth)"))
        paths = paths.join(at.select("depth", "prefix", "shard_bytes"), ["depth", "prefix"])
        paths = paths.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_BITS)).withColumn("before", F.coalesce(F.max("fits").over(leaf), F.lit(False)))
        paths = materialize(paths, f"paths-{last}")
        done.append(paths.where(F.col("fits") & ~F.col("before")).select("prefix", F.col("depth").cast("int").alias("depth"), "shard_bytes").distinct())
        big = paths.where((F.col("depth") == last) & ~F.col("fits") & ~F.col("before")).select("p")
        depth = last
        if big.isEmpty():
            break
        level = level.join(big.withColumnRenamed("p", "b"), F.shiftright("hash", MAX_BITS - depth) == F.col("b"), "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _sums(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("__hash").agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumnRenamed("__hash", "hash"), "shard-sums")


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    return docs.withColumns({"__bytes": size, "__hash": key_hash(docs[doc_id], F.md5(F.coalesce(docs[text], F.lit(""))))})


def _placed(rows: DataFrame, sums: DataFrame, leaves: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``__bytes`` and ``__hash``) and the shard of each: ``__shard, __depth, __shard_bytes``.

    Rows stand on the larger side of each join; they move only where the directory is too large to be sent.
    """
    names = [c for c in rows.columns if c != "__hash"]
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # 60 at most
    leaves = leaves.select(F.col("prefix").alias("__prefix"), F.col("depth").alias("__depth"), F.col("shard_bytes").alias("__shard_bytes"))
    # The leaf of a hash: prefixes of leaves are disjoint, so exactly one (depth, prefix) matches.  Hashes, not rows, are repeated for each depth.
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.shiftright("hash", MAX_BITS - d).alias("p")) for d in sorted(depths or [0]))))
    of = sums.withColumn("__at", at).join(leaves, (F.col("__at.d") == F.col("__depth")) & (F.col("__at.p") == F.col("__prefix")))
    bits = F.when(F.col("__depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("__prefix"), F.col("__depth"), "0"))
    over = (F.col("n") > 1) & (F.col("bytes") > limit)
    of = materialize(of.select(F.col("hash").alias("__h"), bits.alias("__shard"), "__depth", "__shard_bytes", F.when(over, F.col("n")).alias("__n")), "shard-of")
    rows = rows.join(of, F.col("__hash") == F.col("__h"))
    whole = rows.where("__n is null").select(*names, "__shard", "__depth", "__shard_bytes")

    # Rows that one hash can't keep within the limit: equal in bytes, numbered by their partition's offset and their place there.
    part = rows.where("__n is not null").withColumn("__part", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id())
    part = materialize(part, "overflow")
    offset = part.groupBy("__h", "__part").agg(F.count(F.lit(1)).alias("c"))
    offset = offset.withColumn("__skip", F.sum("c").over(Window.partitionBy("__h").orderBy("__part")) - F.col("c")).select(F.col("__h").alias("__oh"), F.col("__part").alias("__op"), "__skip")
    number = F.row_number().over(Window.partitionBy("__h", "__part").orderBy("__mono")) - 1
    part = part.withColumn("__number", number).join(offset, (F.col("__h") == F.col("__oh")) & (F.col("__part") == F.col("__op"))).withColumn("__number", F.col("__number") + F.col("__skip"))
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("__bytes"), F.lit(1))))
    chunk = F.floor(F.col("__number") / each)
    part = part.select(*names, F.concat_ws("/", "__shard", chunk.cast("string")).alias("__shard"), "__depth", (F.least(each, F.col("__n") - chunk * each) * F.col("__bytes")).alias("__shard_bytes"))
    return whole.unionByName(part)


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, bytes, shard (its bits, and /k for overflow k), depth, shard_bytes``.

    ``shard_bytes`` is at most ``limit`` unless the shard is one row that is larger by itself.
    """
    slim = materialize(_measured(docs, doc_id, text).select(docs[doc_id].alias("doc_id"), "__bytes", "__hash"), "shard")
    sums = _sums(slim)
    leaves = materialize(directory(sums, limit), "leaves")
    return _placed(slim, sums, leaves, limit).select("doc_id", F.col("__bytes").alias("bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__shard_bytes").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder per shard (``_shard=``): every row once, in the shard that :func:`assign` gives it."""
    if "_shard" in docs.columns:
        raise ValueError("a column named _shard would clash with the shard folders")
    rows = _measured(docs, doc_id, text)
    sums = _sums(rows.select("__bytes", "__hash"))
    leaves = materialize(directory(sums, limit), "leaves")
    # An empty directory entry stands as "all", since partition values can't be empty.
    name = F.when(F.col("__shard") == "", F.lit("all")).otherwise(F.replace("__shard", F.lit("/"), F.lit("-")))
    placed = _placed(rows, sums, leaves, limit).withColumn("_shard", name)
    placed.select(*docs.columns, "_shard").repartition("_shard").write.partitionBy("_shard").parquet(path)
