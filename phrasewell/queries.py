"""Registered queries over the whole documents and pages tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as X
from .operators import bodies, index as I, lcep, risk
from .operators import search as R
from .plans import answers
from .plans.scratch import keep
from .sources.corpus import documents_corpus, pages_as_sources, pages_corpus, table_corpus
from .streaming import refresh

CHUNKS = I.CHUNKS
QUERY = "token Licensed mails_example ther"
NAME = "token"
TASK = "token Licensed the example"

_built: dict[tuple[str, str], I.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of a folder of tables, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = I.build(table_corpus(spark, sf_dir), CHUNKS)
    return _built[key]


def target(index: I.Index) -> str:
    """A file to analyse: the one that defines most phrases of two or three files; ties by path."""
    rows = index.occ.where("is_def >= 1").join(index.phrases.where("df between 2 and 3").select("phrase"), "phrase", "left_semi")
    found = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").first()
    return found["file_path"] if found else ""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lines_of(table_corpus(spark, sf_dir))


def lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def identifiers(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("file_path", X.identifiers(F.col("line")).alias("ids"))
    return rows.groupBy("file_path").agg(F.sum(F.size("ids")).alias("n_tokens"), F.sum(F.aggregate("ids", F.lit(0), lambda a, x: a + F.length(x))).alias("n_chars"))


def line_zone(spark, sf_dir):
    return _lines(spark, sf_dir).select("file_path", "line_no", X.line_zone(F.col("line")).alias("zone"))


def comment_ratio(spark, sf_dir):
    return rounded(I.file_facts(table_corpus(spark, sf_dir)).select("file_path", "content_len", "comment_ratio"), "comment_ratio")


def definition_hits(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("file_path", F.explode(X.definitions(F.col("line"))).alias("phrase"))
    return rows.groupBy("file_path", "phrase").agg(F.count(F.lit(1)).alias("hits"))


def left_context(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return lcep.contexts(i.files, i.raw, CHUNKS)


def entropy(spark, sf_dir):
    return rounded(lcep.entropy(left_context(spark, sf_dir)), "entropy")


def digest(spark, sf_dir):
    return refresh.manifest(table_corpus(spark, sf_dir))


def file_map(spark, sf_dir):
    return index_of(spark, sf_dir).file_ids()


def phrases(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return i.phrase_ids().join(i.phrases, "phrase").select("phrase_id", "phrase", "phrase_lc", "df")


def occ(spark, sf_dir):
    return index_of(spark, sf_dir).occ


def overflow(spark, sf_dir):
    return index_of(spark, sf_dir).occ.where("cnt > 30").select("phrase", "file_path", F.col("cnt").alias("count"))


def pack_flags(spark, sf_dir):
    packed = index_of(spark, sf_dir).occ.select("phrase", "file_path", X.pack_flags(F.col("is_def"), F.col("zone"), F.col("cnt")).alias("flags"), X.pack_line(F.col("first_line")).alias("line_no"))
    back = X.unpack_flags(F.col("flags"))
    return packed.select("phrase", "file_path", "flags", "line_no", back["is_def"].alias("is_def"), back["zone"].alias("zone"), back["count"].alias("count"))


def file_stats(spark, sf_dir):
    return rounded(index_of(spark, sf_dir).files.select("file_path", "token_len", "content_len", "unique_def_count", "total_def_count", "comment_ratio"), "comment_ratio")


def avgdl(spark, sf_dir):
    return rounded(index_of(spark, sf_dir).meta.where("key = 'avgdl'"), "value")


def lcep_override(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return i.occ.groupBy("is_def").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("phrase").alias("phrases"))


def classify_def(spark, sf_dir):
    i = index_of(spark, sf_dir)
    known = lcep.phrase_entropy(i.files, i.raw, CHUNKS)
    return i.phrases.join(known, "phrase", "left").select("phrase", "df", S.classify_definition(F.col("df"), F.col("entropy")).alias("kind"))


def bm25_idf(spark, sf_dir):
    i = index_of(spark, sf_dir)
    n = F.lit(i.number("files", 1.0))
    return rounded(i.phrases.select("phrase", "df", S.bm25_idf(n, F.col("df")).alias("idf")), "idf")


def _tier(spark, sf_dir, tier: int) -> DataFrame:
    i = index_of(spark, sf_dir)
    raw = R.identifier_list(QUERY)
    df = R.frequencies(i, [t for t, _ in R.candidates(raw)])
    terms = R.expand(raw, lambda t: df.get(t, 0) > 0)
    n = i.number("files", 1.0)
    idf = {t: R.idf_of(n, max(df.get(t, 0), 0.5)) for t in terms}
    rows = R.contributions(i, R.tier_hits(i, idf, (tier,)), i.number("avgdl", 100.0))
    return rounded(rows.groupBy("file_path", "term").agg(F.max("score").alias("score")), "score")


def bm25_exact(spark, sf_dir):
    return _tier(spark, sf_dir, 1)


def tier_prefix(spark, sf_dir):
    return _tier(spark, sf_dir, 2)


def tier_substring(spark, sf_dir):
    return _tier(spark, sf_dir, 3)


def search_terms(spark, sf_dir):
    i, raw = index_of(spark, sf_dir), R.identifier_list(QUERY)
    df = R.frequencies(i, [t for t, _ in R.candidates(raw)])
    terms = R.expand(raw, lambda t: df.get(t, 0) > 0)
    return spark.createDataFrame([(t, df.get(t, 0)) for t in terms], "term string, df long")


def search_full(spark, sf_dir):
    return rounded(R.search_core(index_of(spark, sf_dir), QUERY, 20), "score")


def search_requery(spark, sf_dir):
    return rounded(R.search(index_of(spark, sf_dir), QUERY, 10), "score")


def path_role(spark, sf_dir):
    return table_corpus(spark, sf_dir).select("file_path", S.path_role(F.col("file_path")).alias("role"))


def filename_coverage(spark, sf_dir):
    return rounded(table_corpus(spark, sf_dir).select("file_path", S.filename_coverage(F.col("file_path"), ["src1", "doc_7", "html", "html"]).alias("coverage")), "coverage")


def file_module(spark, sf_dir):
    return table_corpus(spark, sf_dir).groupBy(X.module(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("files"))


def _line_sets(spark, sf_dir):
    rows = index_of(spark, sf_dir).occ.where(F.col("phrase").isin("token", "the", "and", "example", "href") & (F.col("first_line") > 0))
    return rows.groupBy("file_path").agg(F.collect_list("first_line").alias("lines"))


def proximity(spark, sf_dir):
    return rounded(_line_sets(spark, sf_dir).select("file_path", S.proximity(F.col("lines")).alias("weight")), "weight")


def proximity_bonus(spark, sf_dir):
    sets = F.transform(F.col("lines"), lambda x: F.array(x))
    return rounded(_line_sets(spark, sf_dir).select("file_path", S.proximity_bonus(sets).alias("bonus")), "bonus")


def who_calls(spark, sf_dir):
    return risk.who_calls(index_of(spark, sf_dir), NAME)


def trace_callers(spark, sf_dir):
    return risk.trace_callers(index_of(spark, sf_dir), NAME, 3)


def latent_deps(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return risk.latent_deps(i, target(i))


def blast_radius(spark, sf_dir):
    i = index_of(spark, sf_dir)
    page = i.files.where(F.col("file_path").startswith("pages/")).agg(F.min("file_path")).first()[0]
    return risk.blast_radius(i, page or "")


def verify_candidates(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return risk.find_verify_candidates(i, target(i))


def fixtures(spark, sf_dir):
    """On pages as components and tests: the test that mentions most capitalised phrases defined in another file, against the first component."""
    key = (spark.sparkContext.applicationId, sf_dir + "#pages")
    if key not in _built:
        _built[key] = I.build(pages_as_sources(spark, sf_dir), CHUNKS)
    i = _built[key]
    homes = i.occ.where(F.col("phrase").rlike("^[A-Z]") & (F.length("phrase") > 3) & (F.col("is_def") >= 1)).groupBy("phrase").agg(F.min("file_path").alias("home"))
    tests = i.occ.where(F.col("file_path").startswith("tests/")).join(homes, "phrase").where("file_path <> home")
    test = tests.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").first()
    source = i.files.where(F.col("file_path").startswith("src/")).agg(F.min("file_path")).first()[0]
    return risk.find_fixtures(i, source or "", test["file_path"] if test else "")


def plan_scores(spark, sf_dir):
    return rounded(risk.plan_scores(index_of(spark, sf_dir), QUERY), "score")


def _answer(spark, answer: dict) -> DataFrame:
    """One row: lists joined by commas."""
    row = {k: v if isinstance(v, str) else ",".join(v) for k, v in answer.items()}
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))


def edit_plan(spark, sf_dir):
    return _answer(spark, risk.edit_plan(index_of(spark, sf_dir), TASK))


def orient(spark, sf_dir):
    return answers.languages(index_of(spark, sf_dir))


def health(spark, sf_dir):
    return rounded(answers.health(index_of(spark, sf_dir)).select("files", "phrases", "occurrences", "avgdl"), "avgdl")


def code_search(spark, sf_dir):
    return _answer(spark, answers.code_answer(index_of(spark, sf_dir), TASK, True, True, deadline=None))


def changed_files(spark, sf_dir):
    """Documents against documents and pages, with every third document's text cut off its last character."""
    old = refresh.manifest(documents_corpus(spark, sf_dir))
    new = table_corpus(spark, sf_dir)
    edited = new.withColumn("text", F.when(F.length("file_path") % 3 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    return refresh.changes(old, refresh.manifest(edited))


def incremental(spark, sf_dir):
    """Occurrences per file after pages are added to an index of documents: those of a full build."""
    now, _ = refresh.refresh(_documents_index(spark, sf_dir), table_corpus(spark, sf_dir))
    return now.files.select("file_path", "token_len", "unique_def_count", "total_def_count")


def _documents_index(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir + "#documents")
    if key not in _built:
        _built[key] = I.build(documents_corpus(spark, sf_dir), CHUNKS)
    return _built[key]


def _bodies(spark, sf_dir) -> DataFrame:
    """Pages as a body store: hash of the text, path as name."""
    return pages_corpus(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), F.col("file_path").alias("name"), F.col("text").alias("body"))


def find_hash(spark, sf_dir):
    store = keep(_bodies(spark, sf_dir), "bodies")
    first = store.agg(F.min("hash")).first()[0]
    return bodies.by_hash(store, first).select("hash", "name", F.octet_length("body").alias("bytes"))


def find_name(spark, sf_dir):
    return bodies.by_name(_bodies(spark, sf_dir), "S/1")


NAMES = (
    "lines identifiers line_zone comment_ratio definition_hits left_context entropy digest file_map phrases occ overflow pack_flags file_stats avgdl "
    "lcep_override classify_def bm25_idf bm25_exact tier_prefix tier_substring search_terms search_full search_requery path_role filename_coverage file_module proximity "
    "proximity_bonus who_calls trace_callers latent_deps blast_radius verify_candidates fixtures plan_scores edit_plan orient health code_search changed_files incremental find_hash find_name"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
