"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from .functions.text import identifier_list
from .operators.search import candidates
from .queries import CHUNKS, NAME, QUERY, TASK

ID = "[A-Za-z_][A-Za-z0-9_]{2,}"

DOCS = "SELECT ['src','tests','vendor','scripts','docs'][1 + doc_id % 5] || '/' || source || '/' || lang || '/doc_' || doc_id || ['.ts','.ts','.js','.py','.txt'][1 + doc_id % 5] AS file_path, text FROM documents"
PAGES = "SELECT 'pages/' || page_id || '.html' AS file_path, html AS text FROM pages"

CORPUS = f"corpus AS MATERIALIZED ({DOCS} UNION ALL {PAGES})"
LINES = r"""cut AS (SELECT file_path, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') AS ls FROM corpus WHERE length(text) > 0),
lines AS MATERIALIZED (SELECT file_path, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM cut)"""


STRUCT = r"[{}()\[\]<>;:=|&!@#$%^*\-+/?\\]"


def _n(pattern: str) -> str:
    return f"(length(s) - length(regexp_replace(s, '{pattern}', '', 'g')))"


ZONE = rf"""sized AS (SELECT *, greatest(strlen(s), 1) AS size, {_n('[a-z]')} AS lower_n, {_n(STRUCT)} AS struct_n,
    len(regexp_extract_all(s, '{ID}')) AS names, strlen(regexp_replace(s, '\s', '', 'g')) / greatest(len(regexp_extract_all(s, '\S+')), 1) AS word_bytes
  FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines)),
zoned AS MATERIALIZED (SELECT file_path, line_no, line, s, CASE
    WHEN s = '' OR s LIKE '//%' OR s LIKE '/*%' THEN 1
    WHEN s LIKE '#%' THEN CASE WHEN substr(s, 2, 1) = '!' OR (strlen(s) > 2 AND substr(s, 2, 2) IN ('in','de','if','en','pr','er','wa')) THEN 0 ELSE 1 END
    WHEN s LIKE '*%' OR s LIKE '<!--%' OR s LIKE '>%' THEN 1
    WHEN lower_n / size > 0.65 AND struct_n / size < 0.08 AND names < 3 THEN 1
    WHEN names = 0 THEN 1
    WHEN lower_n / size > 0.5 AND word_bytes < 6 AND struct_n / size < 0.05 AND names < 2 THEN 1
    ELSE 0 END AS zone FROM sized)"""
TOKENS = rf"""pieces AS (SELECT file_path, line_no, line, zone, unnest(ps) AS p, generate_subscripts(ps, 1) AS k
  FROM (SELECT *, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+') AS ps FROM zoned)),
placed AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY file_path, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces),
tokens AS MATERIALIZED (SELECT file_path, line_no, line, zone, k, start, p AS phrase,
    (NOT regexp_matches(substr(line, greatest(start, 1), CASE WHEN start > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9_.]')
     AND regexp_matches(substr(line, start + length(p) + 1), '^[ \t]*[A-Za-z0-9_]*[ \t]*([(<\[=:{{]|->)')) AS def_here
  FROM placed WHERE regexp_full_match(p, '{ID}'))"""
RAW = """raw_occ AS MATERIALIZED (SELECT phrase, file_path, max(CASE WHEN zone = 0 AND def_here THEN 1 ELSE 0 END) AS is_def, min(zone) AS zone, count(*) AS cnt, min(line_no) AS first_line FROM tokens GROUP BY ALL),
phrases AS MATERIALIZED (SELECT phrase, lower(phrase) AS phrase_lc, count(*) AS df FROM raw_occ GROUP BY ALL)"""
LCEP = rf"""ids AS (SELECT file_path, row_number() OVER (ORDER BY file_path) AS file_id, count(*) OVER () AS n FROM corpus),
early AS (SELECT * FROM (SELECT t.*, file_id, floor((file_id - 1) / greatest(1, floor(n / {CHUNKS})))::BIGINT AS chunk FROM tokens t JOIN ids USING (file_path))
  QUALIFY row_number() OVER (PARTITION BY chunk, phrase ORDER BY file_id, line_no, k) <= 5),
samples AS MATERIALIZED (SELECT chunk, lower(phrase) AS phrase_lc, word FROM (SELECT *, lower(left(regexp_extract(substr(line, 1, start), '(\S+)\s*$', 1), 30)) AS word FROM early) WHERE word <> ''
  QUALIFY row_number() OVER (PARTITION BY chunk, lower(phrase) ORDER BY file_id, line_no, k) = 1),
entropy AS MATERIALIZED (SELECT phrase_lc, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM (SELECT phrase_lc, word, count(*) AS n FROM samples GROUP BY ALL) GROUP BY phrase_lc HAVING sum(n) >= 3)"""
INDEX = """occ AS MATERIALIZED (SELECT phrase, file_path, CASE WHEN zone = 0 AND df < 20 AND entropy < 1 THEN 2 WHEN zone = 0 AND df < 20 AND entropy < 2 THEN greatest(is_def, 1)
    WHEN zone = 0 AND df >= 20 AND entropy > 2.5 THEN 0 ELSE is_def END AS is_def, zone, cnt, first_line, df
  FROM raw_occ JOIN phrases USING (phrase) LEFT JOIN (SELECT phrase_lc AS phrase, entropy FROM entropy) USING (phrase)),
facts AS (SELECT file_path, coalesce(strlen(text), 0) AS content_len FROM corpus),
ratio AS (SELECT file_path, avg(CASE WHEN regexp_matches(s, '^(#|//|/\\*|\\*|<!--|>)') THEN 1.0 ELSE 0.0 END) AS comment_ratio FROM zoned GROUP BY file_path),
stats AS (SELECT file_path, count(*) AS token_len, sum(CASE WHEN is_def >= 1 AND df = 1 THEN 1 ELSE 0 END) AS unique_def_count, sum(CASE WHEN is_def >= 1 THEN 1 ELSE 0 END) AS total_def_count FROM occ GROUP BY file_path),
files AS MATERIALIZED (SELECT file_path, content_len, coalesce(comment_ratio, 0) AS comment_ratio, coalesce(token_len, 0)::BIGINT AS token_len, coalesce(unique_def_count, 0)::BIGINT AS unique_def_count, coalesce(total_def_count, 0)::BIGINT AS total_def_count
  FROM facts LEFT JOIN ratio USING (file_path) LEFT JOIN stats USING (file_path)),
nums AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(token_len) AS avgdl FROM files)"""

TEXT = f"WITH {CORPUS}, {LINES}"
ZONED = f"{TEXT}, {ZONE}"
TOKEN = f"{ZONED}, {TOKENS}"
FULL = f"{TOKEN}, {RAW}, {LCEP}, {INDEX}"

TARGET = "target AS (SELECT file_path AS t FROM occ WHERE is_def >= 1 AND df BETWEEN 2 AND 3 GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)"
PAGE = "target AS (SELECT min(file_path) AS t FROM files WHERE file_path LIKE 'pages/%')"
MODULE = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def term_ctes(query: str) -> str:
    raw = identifier_list(query)
    last = {t.lower(): t for t in raw}
    rows = ", ".join(f"({i}, {quoted(t)}, {quoted(last[g]) if g else 'NULL'})" for i, (t, g) in enumerate(candidates(raw)))
    return f"""cand(ord, term, gate) AS (VALUES {rows}),
terms AS MATERIALIZED (SELECT term, coalesce(any_value(df), 0) AS df FROM cand LEFT JOIN phrases ON phrase = term WHERE gate IS NULL OR gate NOT IN (SELECT phrase FROM phrases) GROUP BY term),
weighed AS MATERIALIZED (SELECT term, ln((n - greatest(df, 0.5) + 0.5) / (greatest(df, 0.5) + 0.5) + 1) AS idf FROM terms, nums)"""


def tier_cte() -> str:
    return """hits AS (SELECT phrase, term, idf, CASE WHEN phrase = term THEN 1 WHEN phrase ILIKE term || '%' THEN 2 ELSE 3 END AS tier FROM phrases, weighed
  WHERE phrase = term OR phrase ILIKE term || '%' OR (strlen(term) >= 4 AND phrase ILIKE '%' || term || '%')),
found AS (SELECT * FROM occ JOIN hits USING (phrase) QUALIFY tier = 1 OR row_number() OVER (PARTITION BY term, tier ORDER BY phrase, file_path) <= 5000),
scored AS MATERIALIZED (SELECT file_path, term, tier, idf, CASE WHEN tier = 1 THEN first_line END AS first_line,
    idf * ln(1 + tf) * 2.2 / (ln(1 + tf) + 1.2 * (0.25 + 0.75 * token_len / avgdl)) * CASE WHEN zone = 0 THEN 2.0 ELSE 0.25 END
    * CASE is_def WHEN 2 THEN 8.0 WHEN 1 THEN 5.0 WHEN -1 THEN 2.0 ELSE 1.0 END * greatest(1 - 0.5 * comment_ratio, 0.5)
    * CASE WHEN tier < 3 AND total_def_count > 0 AND unique_def_count > 0 THEN 1 + unique_def_count / total_def_count * 0.5 ELSE 1.0 END
    * CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN pow(idf, 1.5) * 0.3 ELSE pow(idf, 1.5) * 0.15 END AS score
  FROM (SELECT *, CASE WHEN tier = 1 THEN cnt ELSE 1 END AS tf FROM found) JOIN files USING (file_path), nums),
best AS (SELECT file_path, term, tier, max(score) AS score, any_value(idf) AS idf, max(first_line) AS first_line FROM scored GROUP BY ALL)"""


PATH_ROLE = """CASE WHEN contains(file_path, '/src/') OR file_path LIKE 'src/%' THEN 2.0 WHEN contains(file_path, '/test') OR contains(file_path, '/spec') OR file_path LIKE 'test%' OR file_path LIKE 'spec%' THEN 0.6
  WHEN contains(file_path, '/deps/') OR contains(file_path, '/vendor/') OR file_path LIKE 'vendor/%' OR file_path LIKE 'deps/%' THEN 0.3
  WHEN contains(file_path, '/scripts/') OR file_path LIKE 'scripts/%' THEN 0.6 WHEN regexp_matches(file_path, '\\.(md|rst|txt)$') THEN 0.25 ELSE 1.0 END"""


def coverage(raw: list[str]) -> str:
    one = lambda t: "CASE WHEN " + " OR ".join(f"contains(lower(file_path), {quoted(x)})" for x in (t, t.replace("_", "-"), t.replace("-", "_"))) + " THEN 1 ELSE 0 END"
    return "1 + (" + " + ".join(one(t.lower()) for t in raw) + f") / {len(raw)}.0"


def core(query: str, top_n: int, tag: str = "") -> str:
    """CTEs up to ``result`` (file_path, score), the core search."""
    raw = identifier_list(query)
    out = f"""{term_ctes(query)}, {tier_cte()},
total AS (SELECT sum(idf) AS t, count(*) AS k FROM weighed),
base AS (SELECT file_path, sum(score) * CASE WHEN any_value(k) > 1 THEN 1 + pow(least(sum(idf), any_value(t)) / any_value(t), 2) ELSE 1 END AS base, list_sort(list(first_line) FILTER (first_line > 0)) AS ls FROM best, total GROUP BY file_path),
top AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(base, 6) DESC, file_path) AS place, {MODULE.format('file_path')} AS module FROM base QUALIFY place <= {5 * top_n}),
near AS (SELECT *, coalesce(sum(CASE WHEN place <= 20 THEN base END) OVER (PARTITION BY module), 0) AS m, list_min(list_transform(ls[2:], lambda x, i: x - ls[i])) AS d FROM top),
result AS MATERIALIZED (SELECT file_path, base * {PATH_ROLE} * ({coverage(raw)}) * (1 + least(m / n, 0.1)) * CASE WHEN len(ls) >= 2 AND d <= 10 THEN 1 + (11 - d) / 10.0 * 0.5 ELSE 1 END AS score FROM near, nums
  QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, file_path) <= {top_n})"""
    if tag:
        for name in ("cand", "terms", "weighed", "hits", "found", "scored", "best", "total", "base", "top", "near", "result"):
            import re

            out = re.sub(rf"(?<![\w.'/]){name}(?= AS \(| AS MATERIALIZED|\(ord)|(?<=FROM ){name}\b|(?<=JOIN ){name}\b|(?<=, ){name}(?= WHERE| GROUP| QUALIFY|\n)", f"{name}_{tag}", out)
    return out


def requery(query: str, top_n: int, start: str = "") -> str:
    """CTEs and the final SELECT of a search with its second try; with ``start``, a query of its own."""
    raw = identifier_list(query)
    path = "lower(file_path)"
    all_in = " AND ".join(f"contains({path}, {quoted(t.lower())})" for t in raw)
    parts = [core(query, top_n, "a")]
    for i, t in enumerate(raw):
        parts.append(core(t, 5 * top_n, f"b{i}"))
    weigh = " UNION ALL ".join(f"SELECT {i} AS i, coalesce((SELECT ln((n - df + 0.5) / (df + 0.5) + 1) FROM phrases WHERE phrase = {quoted(t)}), 10.0) AS w FROM nums" for i, t in enumerate(raw))
    second = " UNION ALL ".join(
        f"SELECT {i} AS i, file_path, score * (1 + (1 + " + (" + ".join(f"CASE WHEN contains({path}, {quoted(u.lower())}) THEN 1 ELSE 0 END" for j, u in enumerate(raw) if j != i) or "0") + f") / {len(raw)}.0) AS score FROM result_b{i}" for i in range(len(raw))
    )
    return f"""{start}{', '.join(parts)}, choice AS (SELECT i FROM ({weigh}) ORDER BY w DESC, i DESC LIMIT 1),
second AS MATERIALIZED (SELECT file_path, score FROM ({second}) WHERE i = (SELECT i FROM choice) QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, file_path) <= {top_n}),
top_a1 AS (SELECT file_path FROM result_a ORDER BY round(score, 6) DESC, file_path LIMIT 1), top_s AS (SELECT file_path FROM second ORDER BY round(score, 6) DESC, file_path LIMIT 1),
stay AS (SELECT coalesce((SELECT {all_in} FROM top_a1), false) OR (SELECT file_path FROM top_a1) IS NOT DISTINCT FROM (SELECT file_path FROM top_s) AS s)
SELECT file_path, round(score, 6) AS score FROM result_a WHERE (SELECT s FROM stay) UNION ALL SELECT file_path, round(score, 6) FROM second WHERE NOT (SELECT s FROM stay)"""


def tier(k: int) -> str:
    return f"{FULL}, {term_ctes(QUERY)}, {tier_cte()} SELECT file_path, term, round(max(score), 6) AS score FROM scored WHERE tier = {k} GROUP BY ALL"


WEIGHT = "CASE WHEN cnt > 30 THEN cnt ELSE 1 END"
LATENT = """latent AS (SELECT origin, file_path, count(*)::DOUBLE AS score FROM (
    SELECT origin, o.phrase, o.file_path FROM occ o JOIN (SELECT file_path AS origin, phrase, is_def FROM occ WHERE df <= 3 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY phrase) <= 50) m ON o.phrase = m.phrase AND m.is_def >= 1 AND o.file_path <> origin
    QUALIFY row_number() OVER (PARTITION BY origin, o.phrase ORDER BY o.file_path) <= 10)
  WHERE regexp_extract(file_path, '^(.*)/[^/]*$', 1) <> regexp_extract(origin, '^(.*)/[^/]*$', 1) GROUP BY origin, file_path QUALIFY row_number() OVER (PARTITION BY origin ORDER BY score DESC, file_path) <= 20)"""
CALLS = f"""home AS (SELECT file_path AS h FROM (SELECT * FROM occ WHERE phrase = {quoted(NAME)} ORDER BY file_path LIMIT 5) WHERE is_def >= 1 ORDER BY file_path LIMIT 1),
calls AS (SELECT file_path, ({WEIGHT})::DOUBLE AS score FROM occ, home WHERE phrase = {quoted(NAME)} AND file_path <> h ORDER BY file_path LIMIT 20)"""
SETS = "sets AS (SELECT file_path, list_sort(list(first_line)) AS ls FROM occ WHERE phrase IN ('token', 'the', 'and', 'example', 'href') AND first_line > 0 GROUP BY file_path)"


def plan_sql(task: str = QUERY) -> str:
    terms = [t.lower() for t in identifier_list(task)]
    rows = ", ".join(f"({quoted(t)}, {terms.count(t)})" for t in dict.fromkeys(terms))
    return f"""plan AS MATERIALIZED (SELECT file_path, sum(ln((n - 4.5) / 5.5 + 1) * ln(1 + tf) * 2.2 / (ln(1 + tf) + 1.2 * (0.25 + 0.75 * token_len / avgdl)) * CASE WHEN is_def > 0 THEN 5.0 ELSE 1.0 END * k) AS score
  FROM (SELECT *, CASE WHEN cnt > 30 THEN 1 ELSE cnt END AS tf FROM occ JOIN (VALUES {rows}) v(phrase, k) USING (phrase) QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY file_path) <= 50) JOIN files USING (file_path), nums
  GROUP BY file_path ORDER BY round(sum(ln((n - 4.5) / 5.5 + 1) * ln(1 + tf) * 2.2 / (ln(1 + tf) + 1.2 * (0.25 + 0.75 * token_len / avgdl)) * CASE WHEN is_def > 0 THEN 5.0 ELSE 1.0 END * k), 6) DESC, file_path LIMIT 10)"""


NOT_FIXTURES = r"(\.(md|json|yml|yaml|toml|txt|html|css)$)|^artifacts/|^node_modules/|web/templates|BACKLOG|CRITICAL"
ROLES = "SELECT CASE page_id % 3 WHEN 1 THEN 'tests/page_' || page_id || '.test.tsx' WHEN 0 THEN 'src/page_' || page_id || '.tsx' ELSE 'lib/page_' || page_id || '.tsx' END AS file_path, html AS text FROM pages"
HOME_SQL = """homes AS (SELECT phrase, min(file_path) AS home FROM occ WHERE regexp_matches(phrase, '^[A-Z]') AND length(phrase) > 3 AND is_def >= 1 GROUP BY phrase),
target AS (SELECT min(file_path) AS t FROM files WHERE file_path LIKE 'src/%'),
tested AS (SELECT file_path AS test FROM occ JOIN homes USING (phrase) WHERE file_path LIKE 'tests/%' AND file_path <> home GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1),
fix AS (SELECT phrase, min(file_path) AS file_path FROM occ, target, tested
  WHERE is_def >= 1 AND file_path NOT IN (t, test) AND phrase IN (SELECT phrase FROM occ WHERE file_path = (SELECT test FROM tested) AND regexp_matches(phrase, '^[A-Z]') AND length(phrase) > 3)
  GROUP BY phrase ORDER BY phrase LIMIT 20)"""


def hop_sql(depth: int) -> str:
    """CTEs ``hop1`` to ``hop<depth>`` (file_path, score, place): files that the hop before leads to, by its first file that does, unseen ones only."""
    out = [f"{CALLS}, hop1 AS (SELECT file_path, score, row_number() OVER (ORDER BY file_path) AS place FROM calls)"]
    for d in range(2, depth + 1):
        seen = " UNION ALL ".join(f"SELECT file_path FROM hop{k}" for k in range(1, d))
        out.append(f"""hop{d} AS (SELECT file_path, score * {0.5 ** (depth - 1)} AS score, row_number() OVER (ORDER BY place, s, file_path) AS place FROM (
  SELECT l.file_path, l.score, h.place, -l.score AS s FROM latent l JOIN hop{d - 1} h ON l.origin = h.file_path QUALIFY row_number() OVER (PARTITION BY l.file_path ORDER BY h.place, l.score DESC) = 1)
  WHERE file_path NOT IN ({seen}))""")
    return ", ".join(out)


def answer_sql() -> str:
    """CTE ``answer``: the edit plan of TASK, lists joined by commas."""
    some = lambda where: f"(SELECT coalesce(string_agg(file_path, ',' ORDER BY r), '') FROM best10 WHERE {where})"
    return f"""{plan_sql(TASK)}, best10 AS MATERIALIZED (SELECT file_path, score, row_number() OVER (ORDER BY round(score, 6) DESC, file_path) AS r FROM plan),
verified AS MATERIALIZED (SELECT file_path, row_number() OVER (ORDER BY r) AS v, r FROM best10 WHERE contains(file_path, 'test') ORDER BY r LIMIT 3),
helped AS (SELECT v, o.phrase, min(o.file_path) AS file_path FROM verified t JOIN occ m ON m.file_path = t.file_path JOIN occ o ON o.phrase = m.phrase
  WHERE v <= 2 AND regexp_matches(m.phrase, '^[A-Z]') AND length(m.phrase) > 3 AND o.is_def >= 1 AND o.file_path <> t.file_path AND o.file_path <> (SELECT file_path FROM best10 WHERE r = 1)
  GROUP BY v, o.phrase QUALIFY row_number() OVER (PARTITION BY v ORDER BY o.phrase) <= 20),
answer AS MATERIALIZED (SELECT {some('r = 1')} AS edit, {some('r <= 3')} AS read_first, {some('r BETWEEN 2 AND 5')} AS coupled,
  (SELECT coalesce(string_agg(file_path, ',' ORDER BY r), '') FROM verified) AS verify,
  (SELECT coalesce(string_agg(phrase || ': ' || file_path, ',' ORDER BY v, phrase), '') FROM helped WHERE NOT regexp_matches(file_path, '{NOT_FIXTURES}')) AS fixtures,
  CASE WHEN NOT EXISTS (FROM best10) THEN 'unknown' WHEN (SELECT score FROM best10 WHERE r = 1) > 10 THEN 'low' ELSE 'moderate' END AS risk)"""


def callers_sql() -> str:
    """CTE ``all_calls`` (file_path, score): callers of the first ten identifiers of TASK, repeats counted."""
    raw = identifier_list(TASK)[:10]
    rows = ", ".join(f"({quoted(t)}, {raw.count(t)})" for t in dict.fromkeys(raw))
    return f"""asked(name, k) AS (VALUES {rows}),
homed AS (SELECT name, file_path AS h FROM (SELECT name, file_path, is_def FROM occ JOIN asked ON phrase = name QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path) <= 5) WHERE is_def >= 1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path) = 1),
all_calls AS (SELECT file_path, sum(w * k)::DOUBLE AS score FROM (SELECT name, file_path, {WEIGHT} AS w, k FROM occ JOIN homed ON phrase = name JOIN asked USING (name) WHERE file_path <> h QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path) <= 20) GROUP BY file_path)"""


def oracle_sql() -> dict[str, str]:
    return {
        "lines": f"{TEXT} SELECT file_path, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY file_path",
        "identifiers": f"{TEXT} SELECT file_path, sum(len(ids))::BIGINT AS n_tokens, sum(length(array_to_string(ids, '')))::BIGINT AS n_chars FROM (SELECT file_path, regexp_extract_all(line, '{ID}') AS ids FROM lines) GROUP BY file_path",
        "line_zone": f"{ZONED} SELECT file_path, line_no, zone FROM zoned",
        "comment_ratio": ZONED + r""" SELECT c.file_path, coalesce(strlen(text), 0) AS content_len, round(coalesce(r, 0), 6) AS comment_ratio FROM corpus c
            LEFT JOIN (SELECT file_path, avg(CASE WHEN regexp_matches(s, '^(#|//|/\*|\*|<!--|>)') THEN 1.0 ELSE 0.0 END) AS r FROM zoned GROUP BY file_path) USING (file_path)""",
        "definition_hits": f"{TOKEN} SELECT file_path, phrase, count(*) AS hits FROM tokens WHERE def_here GROUP BY ALL",
        "left_context": f"{TOKEN}, {LCEP} SELECT chunk, phrase_lc, word FROM samples",
        "entropy": f"{TOKEN}, {LCEP} SELECT phrase_lc, round(entropy, 6) AS entropy FROM entropy",
        "digest": f"WITH {CORPUS} SELECT file_path, sha256(text) AS digest FROM corpus",
        "file_map": f"WITH {CORPUS} SELECT file_path, row_number() OVER (ORDER BY file_path) AS file_id FROM corpus",
        "phrases": f"{TOKEN}, {RAW} SELECT row_number() OVER (ORDER BY phrase) AS phrase_id, phrase, phrase_lc, df FROM phrases",
        "occ": f"{FULL} SELECT phrase, file_path, is_def, zone, cnt, first_line FROM occ",
        "overflow": f"{FULL} SELECT phrase, file_path, cnt AS count FROM occ WHERE cnt > 30",
        "pack_flags": f"{FULL} SELECT phrase, file_path, (is_def + 1) + 4 * zone + 8 * least(cnt, 31) AS flags, first_line % 65536 AS line_no, is_def, zone, least(cnt, 31) AS count FROM occ",
        "file_stats": f"{FULL} SELECT file_path, token_len, content_len, unique_def_count, total_def_count, round(comment_ratio, 6) AS comment_ratio FROM files",
        "avgdl": f"{FULL} SELECT 'avgdl' AS key, round(avgdl, 6) AS value FROM nums",
        "lcep_override": f"{FULL} SELECT is_def, count(*) AS rows, count(DISTINCT phrase) AS phrases FROM occ GROUP BY is_def",
        "classify_def": f"""{FULL} SELECT phrase, df, CASE WHEN df < 20 AND entropy < 1 THEN 2 WHEN df < 20 AND entropy < 2 THEN 1 WHEN df >= 20 AND entropy > 2.5 THEN 0 WHEN entropy IS NOT NULL THEN 1 WHEN df < 10 THEN -1 ELSE 0 END AS kind
            FROM phrases LEFT JOIN (SELECT phrase_lc AS phrase, entropy FROM entropy) USING (phrase)""",
        "bm25_idf": f"{FULL} SELECT phrase, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM phrases, nums",
        "bm25_exact": tier(1),
        "tier_prefix": tier(2),
        "tier_substring": tier(3),
        "search_terms": f"{FULL}, {term_ctes(QUERY)} SELECT term, df FROM terms",
        "search_full": f"{FULL}, {core(QUERY, 20)} SELECT file_path, round(score, 6) AS score FROM result",
        "search_requery": f"{FULL}, {requery(QUERY, 10)}",
        "path_role": f"WITH {CORPUS} SELECT file_path, {PATH_ROLE} AS role FROM corpus",
        "filename_coverage": f"WITH {CORPUS} SELECT file_path, round({coverage(['src1', 'doc_7', 'html', 'html'])}, 6) AS coverage FROM corpus",
        "file_module": f"WITH {CORPUS} SELECT {MODULE.format('file_path')} AS module, count(*) AS files FROM corpus GROUP BY ALL",
        "proximity": f"{FULL}, {SETS} SELECT file_path, round(CASE WHEN len(ls) >= 2 AND d <= 10 THEN 1 + (11 - d) / 10.0 * 0.5 ELSE 1 END, 6) AS weight FROM (SELECT *, list_min(list_transform(ls[2:], lambda x, i: x - ls[i])) AS d FROM sets)",
        "proximity_bonus": f"""{FULL}, {SETS}, each AS (SELECT file_path, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM sets)
            SELECT file_path, round(coalesce(avg(CASE WHEN abs(a.x - b.x) <= 10 THEN (11 - abs(a.x - b.x)) / 10.0 ELSE 0 END) * 0.5, 0), 6) AS bonus FROM sets LEFT JOIN each a USING (file_path) LEFT JOIN each b ON a.file_path = b.file_path AND a.i < b.i WHERE b.i IS NOT NULL OR len(ls) < 2 GROUP BY file_path""",
        "who_calls": f"{FULL}, {CALLS} SELECT file_path, score FROM calls",
        "trace_callers": f"{FULL}, {LATENT}, {hop_sql(3)} SELECT file_path, score, 1 AS hop FROM hop1 UNION ALL SELECT file_path, score, 2 FROM hop2 UNION ALL SELECT file_path, score, 3 FROM hop3",
        "latent_deps": f"{FULL}, {TARGET}, {LATENT} SELECT file_path, score FROM latent, target WHERE origin = t",
        "blast_radius": f"""{FULL}, {PAGE}, mine AS (SELECT phrase, {WEIGHT} AS w FROM (SELECT occ.* FROM occ, target WHERE file_path = t ORDER BY phrase LIMIT 50) WHERE is_def > 0)
            SELECT file_path, sum(w)::DOUBLE AS score FROM (SELECT o.file_path, w FROM occ o JOIN mine USING (phrase), target WHERE file_path <> t QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY file_path) <= 10) GROUP BY file_path ORDER BY score DESC, file_path LIMIT 20""",
        "verify_candidates": f"""{FULL}, {TARGET} SELECT file_path, count(*)::DOUBLE AS score FROM (SELECT o.* FROM occ o, target WHERE o.file_path <> t AND (o.file_path ILIKE '%test%' OR o.file_path ILIKE '%spec%')
            AND phrase IN (SELECT phrase FROM occ, target WHERE file_path = t) ORDER BY phrase, o.file_path LIMIT 500) WHERE is_def > 0 GROUP BY file_path ORDER BY score DESC, file_path LIMIT 10""",
        "fixtures": f"{FULL.replace(CORPUS, f'corpus AS MATERIALIZED ({ROLES})')}, {HOME_SQL} SELECT phrase, file_path FROM fix WHERE NOT regexp_matches(file_path, '{NOT_FIXTURES}')",
        "plan_scores": f"{FULL}, {plan_sql()} SELECT file_path, round(score, 6) AS score FROM plan",
        "edit_plan": f"{FULL}, {answer_sql()} SELECT * FROM answer",
        "code_search": f"""{FULL}, {answer_sql()}, {callers_sql()}, {LATENT},
            files15 AS (SELECT * FROM ({requery(TASK, 15, 'WITH ')}))
            SELECT (SELECT coalesce(string_agg(file_path, ',' ORDER BY score DESC, file_path), '') FROM files15) AS files, edit, verify, risk, read_first AS read_order, coupled, fixtures,
              (SELECT coalesce(string_agg(file_path, ',' ORDER BY score DESC, file_path), '') FROM all_calls) AS who_calls,
              (SELECT coalesce(string_agg(file_path, ',' ORDER BY score DESC, file_path), '') FROM latent WHERE origin = edit) AS hidden_deps FROM answer""",
        "orient": f"""WITH {CORPUS} SELECT ext, count(*) AS files FROM (SELECT regexp_extract(file_path, '([^.]*)$', 1) AS ext FROM corpus) WHERE strlen(ext) <= 6 GROUP BY ext ORDER BY files DESC, ext LIMIT 8""",
        "health": f"{FULL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM phrases) AS phrases, (SELECT count(*) FROM occ) AS occurrences, round(avgdl, 6) AS avgdl FROM nums",
        "changed_files": f"""WITH old AS ({DOCS}), new AS (SELECT file_path, CASE WHEN length(file_path) % 3 = 0 THEN left(text, length(text) - 1) ELSE text END AS text FROM ({DOCS} UNION ALL {PAGES}))
            SELECT * FROM (SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'changed' END AS change FROM old o FULL JOIN new n USING (file_path)) WHERE change IS NOT NULL""",
        "incremental": f"{FULL} SELECT file_path, token_len, unique_def_count, total_def_count FROM files",
        "find_hash": "SELECT sha256(html) AS hash, 'pages/' || page_id || '.html' AS name, least(strlen(html), 51216) AS bytes FROM pages WHERE sha256(html) = (SELECT min(sha256(html)) FROM pages)",
        "find_name": "SELECT sha256(html) AS hash, 'pages/' || page_id || '.html' AS name FROM pages WHERE 'pages/' || page_id || '.html' ILIKE '%S/1%' ORDER BY name, hash LIMIT 20",
    }
