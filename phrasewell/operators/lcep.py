"""Left-context entropy: how varied the words before a phrase are, from one sample per chunk of files.

Files in path order form ``chunks`` contiguous chunks.  In each chunk, a
lower-cased phrase takes its first occurrence that has a left word and is among the first five
occurrences of its exact spelling.  All of it comes from the left words that ``extract`` keeps with each
(file, phrase), so texts are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import ranked
from .extract import SAMPLES


def contexts(files: DataFrame, raw: DataFrame, chunks: int, word: Column | str = "word") -> DataFrame:
    """``chunk, phrase_lc, word``: the accepted samples of ``raw`` occurrences, over all ``files``; ``word`` may be a hash of the word."""
    ids = ranked(files.select("file_path"), "file_path", "file_id")
    size = F.greatest(F.lit(1), F.floor(F.lit(files.count()) / chunks))
    ids = ids.select("file_path", "file_id", F.floor((F.col("file_id") - 1) / size).alias("chunk"))
    rows = raw.withColumn("word", word if isinstance(word, Column) else F.col(word)).select("phrase", "file_path", "cnt", "word", "spot", "nth").join(ids, "file_path").drop("file_path")
    in_order = Window.partitionBy("chunk", "phrase").orderBy("file_id")
    # A limit per group: each task keeps five files of a phrase before the shuffle, as every file has one occurrence at least.
    early = rows.withColumn("k", F.row_number().over(in_order)).where(F.col("k") <= SAMPLES)
    before = F.sum("cnt").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    seen = early.withColumn("before", before).where((F.col("nth") > 0) & (F.col("before") + F.col("nth") <= SAMPLES))
    least = F.min(F.struct("file_id", "spot", "word"))
    return seen.groupBy("chunk", F.lower("phrase").alias("phrase_lc")).agg(least.alias("first")).select("chunk", "phrase_lc", F.col("first.word").alias("word"))


def entropy(samples: DataFrame) -> DataFrame:
    """``phrase_lc, entropy`` in bits, for phrases with three samples or more."""
    words = samples.groupBy("phrase_lc", "word").agg(F.count(F.lit(1)).alias("n"))
    total = words.groupBy("phrase_lc").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.where("t >= 3").select("phrase_lc", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def phrase_entropy(files: DataFrame, raw: DataFrame, chunks: int) -> DataFrame:
    """``phrase, entropy``: only all-lower-case phrases have one, as samples are keyed by lower case."""
    return entropy(contexts(files, raw, chunks, F.xxhash64("word"))).withColumnRenamed("phrase_lc", "phrase")
