"""A corpus pipeline of five stages over ``documents``; see ``STAGES``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``docs``.  Texts are whole throughout, however long, and no stage drops
documents for any other reason than its operator's decision.  Any column may be null; extra columns pass through
all stages but the last, whatever their names; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm.bpe import encode
from phrasewell.llm.common import drop_scratch, materialize, owned_by, shared_dir
from phrasewell.llm.jaccard_join import near_duplicates
from phrasewell.llm.line_dedup import dedup_lines, dedup_passages
from phrasewell.llm.mixing import mixed_documents
from phrasewell.llm.quality_rules import apply_rules
from phrasewell.llm.queries import vocabulary

#: Near duplicates: words in a shingle, and the least similarity as a fraction.
SHINGLE, SIMILARITY = 5, (8, 10)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (4) keep.  Null and empty texts go, as they have fewer than 20 words; repeated rows share a verdict."""
    return apply_rules(docs, as_="__quality").where("__quality.kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines (8), then without later repeated passages within lines; a document that loses its last word goes.

    Null texts stay as they are.  The copy that stays is the first by doc_id (null last), text hash and line; rows equal in doc_id and text stay alike.
    """
    out = dedup_passages(materialize(dedup_lines(docs, gone="__gone"), "line-texts"), gone="__words")
    hit = (F.size("__gone") > 0) | (F.size("__words") > 0)
    out = out.where(~hit | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.when(hit, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (7): of the smallest doc_id (null last), then text hash.

    Each distinct pair of doc_id and text is judged by itself, whether its id is null or stands with other texts as well; repeats
    of a pair are one row, the least by its columns.  Pairs are told apart by a 64-bit hash.  Texts without words are near nothing.
    """
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__row", row)
    found = near_duplicates(rows.select("__row", "text"), SHINGLE, *SIMILARITY, doc_id="__row").select(F.col("doc_id").alias("r"), "component_id").distinct()
    named = rows.groupBy(F.col("__row").alias("row")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = materialize(found.join(named, F.col("r") == F.col("row")).select("row", "id", "n", "component_id"), "copies")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = found.groupBy(F.col("component_id").alias("c")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    gone = found.join(first, F.col("component_id") == F.col("c")).where("row <> first.row").select(F.col("row").alias("__gone"))
    kept = rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    again = found.where("n > 1").select(F.col("row").alias("__again"))
    at = F.col("__row") == F.col("__again")
    once = kept.join(again, at, "left_anti").select(*docs.columns)
    repeated = kept.join(again, at, "left_semi").groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("d")).select("d.*")
    return once.unionByName(repeated)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target sizes (1): a document stands as often as it is taken.  A null source is one of its own; ties go by row hash."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids (9) of each text: count, base64 of little-endian uint32 ids, and their hash.  Null and empty texts have no ids; repeated rows repeat."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), ids="ids", n_tokens="n_tokens")
    return out.select("doc_id", "lang", "source", "n_tokens", F.replace(F.base64("ids"), F.lit("\r\n"), F.lit("")).alias("ids"), F.sha2("ids", 256).alias("ids_sha256"))


def _tidy(name: str, stage: Callable) -> Callable:
    """The stage, with its scratch tables marked; those of earlier stages go first, unless ``docs`` still reads them."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not any("/phrasewell-" in f for f in docs.inputFiles()):
            drop_scratch(spark, "pipeline")
        with owned_by("pipeline"):
            return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = name, stage.__doc__
    return run_stage


STAGES = [(f.__name__, _tidy(f.__name__, f)) for f in (quality, lines, near_copies, mixing, tokens)]

#: BPE and weighted sampling by Spark's hashes have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote is deleted once the next one's rows stand; the last stage's files, which the result reads, stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            gone = at(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    drop_scratch(spark, "pipeline")
    return docs
