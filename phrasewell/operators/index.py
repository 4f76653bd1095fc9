"""The phrase index: an inverted index with per-file statistics, as Parquet tables.

Phrases and paths are the durable keys; numeric ids are derived views (byte
rank), so a refresh never shifts keys.  Building reads each text once (see ``extract``); what is shuffled
is a row per (file, phrase), by phrase for document frequencies and left contexts and by file for statistics.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scoring import override_definition
from ..plans.scratch import keep, ranked
from . import lcep
from .extract import FACTS, OCC, extract

SCHEMA_VERSION = 2
#: Chunks of files that left contexts are sampled from.
CHUNKS = 8
TABLES = ("files", "occ", "phrases", "meta", "raw")


@dataclass(frozen=True)
class Index:
    """``files (file_path, content_len, digest, readable, comment_ratio, token_len, unique_def_count, total_def_count)``,
    ``occ (phrase, file_path, is_def, zone, cnt, first_line)``, ``phrases (phrase, phrase_lc, df)``, ``meta (key, value)``
    and ``raw``: occurrences as they were read, with left words, which is all that a refresh needs of unchanged files."""

    files: DataFrame
    occ: DataFrame
    phrases: DataFrame
    meta: DataFrame
    raw: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def number(self, key: str, default: float) -> float:
        """A value of ``meta``, a few rows that are read once."""
        if "_numbers" not in self.__dict__:
            object.__setattr__(self, "_numbers", {r["key"]: r["value"] for r in self.meta.collect()})
        found = self._numbers.get(key)
        return default if found is None else found

    def file_ids(self) -> DataFrame:
        return ranked(self.files.select("file_path"), "file_path", "file_id")

    def phrase_ids(self) -> DataFrame:
        return ranked(self.phrases.select("phrase"), "phrase", "phrase_id")

    def save(self, path: str) -> str:
        """A new version folder, complete before its marker appears; readers take the newest marked version.  Returns the version."""
        fs, at = _files(self.spark, path)
        # Versions sort by time; an id keeps writers of the same moment apart.
        version = f"{time.time_ns():020d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        for name in ("files", "phrases", "meta", "raw"):
            getattr(self, name).write.parquet(f"{path}/v={version}/{name}")
        self.occ.repartitionByRange("phrase").sortWithinPartitions("phrase", "file_path").write.parquet(f"{path}/v={version}/occ")
        made = at(f"{path}/v={version}/_new")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION}).encode()))
        out.close()
        fs.rename(made, at(f"{path}/v={version}/_COMPLETE"))
        return version


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(sc._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a saved index, oldest first."""
    fs, at = _files(spark, path)
    found = fs.globStatus(at(f"{path}/v=*/_COMPLETE"))
    return sorted(f.getPath().getParent().getName()[2:] for f in found or ())


def load(spark: SparkSession, path: str) -> Index:
    """The newest complete version."""
    every = versions(spark, path)
    if not every:
        raise FileNotFoundError(f"no index at {path}")
    base = f"{path}/v={every[-1]}"
    fs, at = _files(spark, path)
    held = fs.open(at(f"{base}/_COMPLETE"))
    schema = json.loads(bytes(held.readAllBytes()))["schema"]
    held.close()
    if schema != SCHEMA_VERSION:
        raise ValueError(f"index schema {schema} is not {SCHEMA_VERSION}")
    return Index(*(spark.read.parquet(f"{base}/{t}") for t in TABLES))


def open_or_build(spark: SparkSession, path: str, corpus, lcep_chunks: int = CHUNKS) -> Index:
    """The index at ``path``; if there is none yet, that of the corpus which ``corpus()`` gives is built and saved there."""
    if not versions(spark, path):
        build(corpus(), lcep_chunks).save(path)
    return load(spark, path)


def lines_of(corpus: DataFrame) -> DataFrame:
    """``file_path, line_no, line`` from 0; files without lines have no rows."""
    return corpus.select("file_path", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))


def file_facts(corpus: DataFrame) -> DataFrame:
    """Per file, as expressions: bytes, digest, comment ratio; zeros for unreadable (null) texts."""
    rows = X.lines(F.coalesce(F.col("text"), F.lit("")))
    facts = F.transform(F.array(rows), lambda r: F.struct(F.size(r).alias("n"), F.size(F.filter(r, X.is_comment)).alias("c")))[0]
    ratio = F.when(F.col("facts.n") > 0, F.col("facts.c") / F.col("facts.n")).otherwise(F.lit(0.0))
    out = corpus.select("file_path", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("content_len"), F.sha2("text", 256).alias("digest"), F.col("text").isNotNull().alias("readable"), facts.alias("facts"))
    return out.select("file_path", "content_len", "digest", "readable", ratio.alias("comment_ratio"))


def finish(files: DataFrame, raw: DataFrame, lcep_chunks: int, lcep_max_files: int | None = None) -> Index:
    """Index from per-file facts and raw occurrences: everything that depends on the whole corpus."""
    phrases = keep(raw.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).withColumn("phrase_lc", F.lower("phrase")).select("phrase", "phrase_lc", "df"), "phrases")
    rows = raw.select("phrase", "file_path", "is_def", "zone", "cnt", "first_line").join(phrases.select("phrase", "df"), "phrase")
    if lcep_chunks and (lcep_max_files is None or files.count() <= lcep_max_files):
        rows = rows.join(lcep.phrase_entropy(files, raw, lcep_chunks), "phrase", "left")
        rows = rows.withColumn("is_def", override_definition(F.col("is_def"), F.col("zone"), F.col("df"), F.col("entropy")))
    rows = keep(rows.select("phrase", "file_path", "is_def", "zone", "cnt", "first_line", "df"), "occ")
    defined = F.col("is_def") >= 1
    stats = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("token_len"), F.sum(F.when(defined & (F.col("df") == 1), 1).otherwise(0)).alias("unique_def_count"), F.sum(F.when(defined, 1).otherwise(0)).alias("total_def_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    files = keep(files.select(*FACTS).join(stats, "file_path", "left").select(*FACTS, *map(zero, ("token_len", "unique_def_count", "total_def_count"))), "files")
    facts = files.agg(F.avg(F.when(F.col("readable"), F.col("token_len"))).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    meta = [("avgdl", facts["mean"] or 0.0), ("build_time", time.time()), ("files", float(facts["n"])), ("lcep_chunks", float(lcep_chunks)), ("lcep_max_files", -1.0 if lcep_max_files is None else float(lcep_max_files))]
    return Index(files, rows.drop("df"), phrases, keep(files.sparkSession.createDataFrame(meta, "key string, value double").coalesce(1), "meta"), raw)


def build(corpus: DataFrame, lcep_chunks: int = CHUNKS, lcep_max_files: int | None = None) -> Index:
    """Full build over ``corpus (file_path, text)``.  ``lcep_chunks=0`` leaves left contexts out, and so does, if given, a corpus of more than ``lcep_max_files``."""
    read = keep(extract(corpus), "extracted")
    return finish(read.where("phrase is null").select(*FACTS), read.where("phrase is not null").select(*OCC), lcep_chunks, lcep_max_files)
