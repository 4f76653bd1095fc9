"""Quality rules (operator 4): a threshold table compiled into one projection.

No user function runs: every metric is a column expression over the whole
text, and the rules become one boolean column.  There is no shuffle.

Null or empty text has no words and fails the base rule.  Very long texts are measured whole.  Rows are
independent, so repeated rows share a verdict, and a value on a threshold passes.  Extra columns are kept; all
that is added lies in one struct, and an existing column of its name is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as by be this are at or an was from which have not "
    "de la le les et des un une du en que qui dans pour par sur au est il elle ou "
    "der die das und zu den von mit ist im ein eine auf dem für nicht sich auch es "
    "el los las y una por con se su para lo como al del"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; documents with fewer than ``from_words`` words are not judged by it."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table: word length, symbols, stop words and lines.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbols_per_word", high=0.20),
    Rule("exclaimed_words", high=0.50),
    Rule("stop_word_ratio", low=0.02, from_words=60),
    Rule("dup_line_ratio", high=0.60),
    Rule("longest_word", high=200),
)


def _repeated(w: Column, n: Column, window: int) -> Column:
    """Words covered by windows of ``window`` words (a power of two) that occur twice or more in the array ``w``.

    Windows are compared by 64-bit hash within one text; the hash of 2k words
    is made from those of its two halves, so each doubling is one pass.
    """

    def doubled(size: int) -> Column:
        if size == 1:
            return F.transform(w, lambda x: F.xxhash64(x))
        half = size // 2
        return let(doubled(half), lambda h: F.zip_with(F.slice(h, 1, F.size(h) - half), F.slice(h, half + 1, F.size(h) - half), lambda x, y: F.xxhash64(x, y)))

    none = F.array().cast("array<bigint>")
    half = window // 2
    #: A repeated window repeats its first half: if no half does, the full windows are not hashed.
    hashes = F.when(n >= window, let(doubled(half), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.zip_with(F.slice(h, 1, F.size(h) - half), F.slice(h, half + 1, F.size(h) - half), lambda x, y: F.xxhash64(x, y))))).otherwise(none)

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def total(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(pairs, total))

    return let(hashes, covered)


def metrics(text: Column, window: int = 8) -> Column:
    """Struct of counts and ratios of a text; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.size(w)
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        counts = F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated(w, n, window).alias("n_repeat_words"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("exclaims"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stops"),
            F.array_max(F.transform(w, lambda x: F.length(x))).alias("longest"),
        )

        def ratios(c: Column) -> Column:
            per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
            return F.struct(
                *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")),
                c["lines"]["dup"].alias("n_dup_lines"),
                per(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
                per(c["n_symbols"], c["n_words"]).alias("symbols_per_word"),
                per(c["exclaims"], c["n_words"]).alias("exclaimed_words"),
                per(c["stops"], c["n_words"]).alias("stop_word_ratio"),
                per(c["lines"]["dup"], c["lines"]["all"]).alias("dup_line_ratio"),
                F.coalesce(c["longest"], F.lit(0)).alias("longest_word"),
            )

        return let(counts, ratios)

    return let(words_of(text), of)


def compile_rules(rules: Sequence[Rule], m: Column) -> Column:
    """One boolean: every rule of the table holds for the metrics struct ``m``."""

    def holds(r: Rule) -> Column:
        v, ok = m[r.metric], F.lit(True)
        if r.low is not None:
            ok = ok & (v >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (v <= F.lit(r.high))
        return ok | (m["n_words"] < r.from_words) if r.from_words else ok

    return reduce(lambda a, b: a & b, map(holds, rules), F.lit(True))


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, as_: str = "quality") -> DataFrame:
    """Add the struct column ``as_``: the metrics, ``base_failed`` and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated
    8-word windows.  ``kept``: not base_failed and every rule holds.
    """
    base = lambda m: (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    full = let(metrics(docs[text]), lambda m: F.struct(m.alias("metrics"), base(m).alias("base_failed"), (~base(m) & compile_rules(rules, m)).alias("kept")))
    return docs.withColumn(as_, full)
