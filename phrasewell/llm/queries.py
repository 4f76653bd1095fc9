"""Registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license")
    places, matches = F.col("license.places"), F.col("license.matches")
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "license.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places["start"]).alias("first_word"), F.array_max(places["start"]).alias("last_word"),
        joined(places["label"]).alias("base_labels"), joined(F.concat(places["label"], matches["label"])).alias("labels"), F.col("license.score").alias("score"), F.size(matches).cast("long").alias("n_matches"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data

    found = find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    q = apply_rules(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality")
    m = F.col("quality.metrics")
    return q.select("doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), F.col("quality.base_failed").alias("base_failed"), F.col("quality.kept").alias("kept"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit, score

    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import near_embeddings

    return near_embeddings(_read(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


#: Place of the vocabulary files; a parameter of the BPE queries.
def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    tokens = encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded="decoded")
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_read(spark, sf_dir, "documents"), SHARD_BYTES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_licenses, op3_pii, op4_quality_rules, op5_quality_model, op6_multi_index, op7_jaccard_join, op8_line_dedup, op9_bpe, op10_sharding]
    return {f.__name__: f for f in own}


#: Links to their smallest reachable id, in SQL.
REACH = """near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS n, a AS r FROM near UNION SELECT reach.n, near.b FROM reach JOIN near ON reach.r = near.a),
smallest AS (SELECT n, min(r) AS c FROM reach GROUP BY n)"""


def quality_sql() -> str:
    from .quality_rules import RULES, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        t = " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None))
        tests.append(f"({t} OR n_words < {r.from_words})" if r.from_words else f"({t})")
    return f"""WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n_repeat_words FROM twice GROUP BY doc_id),
facts AS (SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines, len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_distinct,
    length(text) - length(replace(text, '!', '')) AS exclaims, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS stops, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base b LEFT JOIN rep r ON b.doc_id = r.doc_id),
ratios AS (SELECT *, (n_lines - n_distinct)::BIGINT AS n_dup_lines, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(exclaims / nullif(n_words, 0), 0) AS exclaimed_words,
    coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce((n_lines - n_distinct) / nullif(n_lines, 0), 0) AS dup_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM ratios"""


def line_sql(least: int) -> str:
    return f"""WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS k FROM cut),
units AS (SELECT doc_id, k, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x, n, row_number() OVER w AS u, sum(n) OVER w AS upto FROM (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines) WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
spans AS (SELECT a.doc_id, a.u AS s, min(b.u) AS e FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.u >= a.u AND b.upto - a.upto + a.n >= {least} GROUP BY ALL
  UNION SELECT b.doc_id, max(a.u), b.u FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.u >= a.u AND b.upto - a.upto + a.n >= {least} GROUP BY b.doc_id, b.u),
wins AS (SELECT p.doc_id, s, e, min(k) AS k0, string_agg(x, chr(10) ORDER BY u) AS key FROM spans p JOIN units v ON p.doc_id = v.doc_id AND u BETWEEN s AND e GROUP BY ALL),
later AS (SELECT doc_id, s, e FROM wins QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, k0) > 1),
gone AS (SELECT DISTINCT v.doc_id, k FROM later l JOIN units v ON l.doc_id = v.doc_id AND u BETWEEN s AND e),
listed AS (SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS text FROM lines WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM gone) GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed_lines, sha256(coalesce(s.text, '')) AS text_sha256 FROM cut c LEFT JOIN listed USING (doc_id) LEFT JOIN stay s USING (doc_id)"""


SQL = {
    "op4_quality_rules": quality_sql,
    "op6_multi_index": lambda: f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93), {REACH}
SELECT vec_id, (SELECT count(*) FROM near WHERE a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN smallest ON n = vec_id""",
    "op7_jaccard_join": lambda: f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.c + q.c - i)), {REACH}
SELECT w.doc_id, coalesce(c0.c, 0) AS n_shingles, coalesce(s.c, w.doc_id) AS component_id, (SELECT count(*) FROM near WHERE a = w.doc_id) AS n_links FROM w LEFT JOIN n c0 ON c0.doc_id = w.doc_id LEFT JOIN smallest s ON s.n = w.doc_id""",
    "op8_line_dedup": lambda: line_sql(30),
    "op10_sharding": lambda: f"""WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || left(md5(doc_id || chr(31) || md5(coalesce(text, ''))), 15))::BIGINT AS h FROM documents),
d AS (SELECT doc_id, bytes, h, d, h >> (60 - d) AS p FROM h, range(0, 31) r(d)),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY d, p)::BIGINT AS shard_bytes FROM d),
f AS (SELECT * FROM s WHERE shard_bytes <= {SHARD_BYTES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(to_base(p, 2), d::INT, '0') END AS shard, d::INT AS depth, shard_bytes FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return {k: v() for k, v in SQL.items()}
