"""Corpora: tables of ``file_path, text`` from directories or Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a directory scan leaves out and takes in (names starting with a dot are left out as well).
SKIPPED_FOLDERS = "node_modules vendor dist build target __pycache__ env coverage".split()
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock go.sum Gemfile.lock poetry.lock Pipfile.lock composer.lock bun.lockb".split()
EXTENSIONS = (
    "ts tsx js jsx go py rs c h cpp hpp java kt swift rb php scala clj erl hrl ex exs zig nim nix tcl elm hs ml mli fs v purs "
    "md rst txt yaml yml toml json html css sh bash zsh fish sql graphql proto lua makefile dockerfile"
).split()
MAX_FILES = 500_000


def source_filter(path):
    """Column: whether a relative path is a source file of the scan."""
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    name = F.substring_index(path, "/", -1)
    pruned = F.exists(folders, lambda f: f.startswith(".") | f.isin(SKIPPED_FOLDERS)) | name.startswith(".") | name.isin(SKIPPED_FOLDERS)
    return ~pruned & ~name.isin(LOCK_FILES) & F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(EXTENSIONS)


def scan_directory(spark: SparkSession, root: str, limit: int = MAX_FILES) -> DataFrame:
    """``file_path, text, content_len, digest, mtime`` of the source files below ``root``; text null for invalid UTF-8.

    The first ``limit`` paths are taken when there are more (the scan's own safety stop).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    start = F.regexp_replace(F.lit(base), r"^file:/+", "/")
    path = F.replace(F.substr(full, F.length(start) + 1), F.lit("\\"), F.lit("/"))
    names = raw.select(path.alias("file_path")).where(source_filter(F.col("file_path"))).orderBy("file_path").limit(limit)
    files = raw.withColumn("file_path", path).where(source_filter(F.col("file_path"))).join(names, "file_path", "left_semi")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "utf-8"))
    return files.select("file_path", text.alias("text"), F.octet_length("content").cast("long").alias("content_len"), F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("mtime"))


def scan_times(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, mtime`` of the source files below ``root``: a listing, no file is opened."""
    return scan_directory(spark, root).select("file_path", "mtime")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files of several roles and modules; a null source, lang or doc_id stands as ``_`` in the path."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    role = F.element_at(F.array(*map(F.lit, ("src", "tests", "vendor", "scripts", "docs"))), (1 + F.coalesce("doc_id", F.lit(0)) % 5).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".ts", ".ts", ".js", ".py", ".txt"))), (1 + F.coalesce("doc_id", F.lit(0)) % 5).cast("int"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat(role, F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/doc_"), part("doc_id"), ending)
    return d.select(path.alias("file_path"), "text")


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("text"))


def pages_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages alone, as components (two of three) and their tests."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    number = F.coalesce("page_id", F.lit(0))
    stem = F.concat(F.lit("page_"), number.cast("string"))
    path = F.when(number % 3 == 1, F.concat(F.lit("tests/"), stem, F.lit(".test.tsx"))).when(number % 3 == 0, F.concat(F.lit("src/"), stem, F.lit(".tsx"))).otherwise(F.concat(F.lit("lib/"), stem, F.lit(".tsx")))
    return p.select(path.alias("file_path"), F.col("html").alias("text"))


def table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together."""
    return documents_corpus(spark, sf_dir).unionByName(pages_corpus(spark, sf_dir))
