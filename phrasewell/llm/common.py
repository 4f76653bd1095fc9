"""Shared helpers: scratch tables in the cluster's shared folder, and column idioms."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the white-space tokenisation used by several operators.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master may fall back on a temporary folder; on a cluster an
    unset folder is an error, since executors could not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="phrasewell-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


#: Scratch tables by the owner that was named when they were written.
_owner: ContextVar[str] = ContextVar("owner", default="")
_made: dict[str, list[str]] = defaultdict(list)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor; tables stay until
    they are dropped (see :func:`owned_by` and :func:`drop_scratch`).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phrasewell-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made[_owner.get()].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, in the middle of an operator.

    What was made of them must stand as tables.  Shuffle files of finished queries go with the driver's next
    garbage collection, which is asked for here, so that disk holds one phase at a time.
    """
    for t in tables:
        for made in _made.values():
            if t._scratch in made:
                made.remove(t._scratch)
        _delete(t.sparkSession, t._scratch)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``owner``."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def drop_scratch(spark: SparkSession, owner: str = "") -> None:
    """Delete the scratch tables of ``owner``; call when no result that reads them is still needed."""
    for path in _made.pop(owner, []):
        _delete(spark, path)


#: Words of 64 bits in a sieve, at most: the bound of what is broadcast (rows of two longs).
SIEVE_WORDS = 1 << 18


def sieved(docs: DataFrame, key: Column, wanted: DataFrame, *names: str) -> DataFrame:
    """``docs`` with the boolean ``__maybe``: false only if no row of ``wanted`` has the long ``key`` (its hash of the columns ``names``).

    A bitmap of at most ``SIEVE_WORDS`` words is broadcast, so rows that a join would not touch need not move,
    whatever the size of ``wanted``; a full bitmap lets all rows through.
    """
    slot = lambda c: F.pmod(c, F.lit(64 * SIEVE_WORDS))
    marks = wanted.select(slot(F.xxhash64(*names)).alias("s")).select(F.shiftright("s", 6).alias("__word"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    marks = materialize(marks.groupBy("__word").agg(F.bit_or("bit").alias("__mask")), "sieve")
    out = docs.withColumn("__slot", slot(key)).join(F.broadcast(marks), F.shiftright("__slot", 6) == F.col("__word"), "left")
    bit = F.getbit(F.col("__mask"), F.col("__slot").bitwiseAND(F.lit(63)).cast("int")) == 1
    return out.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__slot", "__word", "__mask")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of white-space separated words; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    """Number of white-space separated words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows: binary and list columns get 64-bit offsets, as those of 32 bits end at 2 GiB and would leave several chunks."""
    if len(held) == 1:
        return held[0]
    kind = lambda t: pa.large_binary() if pa.types.is_binary(t) else pa.large_string() if pa.types.is_string(t) else pa.large_list(t.value_type) if pa.types.is_list(t) else t
    wide = pa.schema([pa.field(f.name, kind(f.type)) for f in held[0].schema])
    whole = pa.Table.from_batches(held).cast(wide).combine_chunks().to_batches()
    if len(whole) > 1:
        raise ValueError("the rows of a group do not fit one batch")
    return whole[0]


def in_groups(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``kernel`` over each group of ``keys`` (rows in ``order``), many groups a batch.

    Groups are of bounded size here, and most are tiny, so they are cut from sorted batches without a frame for each.
    """
    types = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(out: list[dict]) -> None:
            if (found := kernel(joined(held))) is not None:
                out.append(found)
            held.clear()

        def packed(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[c], np.int64) for o in out]), pa.int64()) for c in types.names], schema=types)

        for b in batches:
            if not b.num_rows:
                continue
            out: list[dict] = []
            k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(k[:, s].tolist())
                if held and key != last:
                    done(out)
                held.append(b.slice(s, e - s))
                last = key
            if out:
                yield packed(out)
        out = []
        if held:
            done(out)
        if out:
            yield packed(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
