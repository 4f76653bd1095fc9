"""Line dedup by winnowing over line hashes (operator 8), in DataFrame expressions only.

A run is a stretch of consecutive lines (blank lines aside) with at least
``min_words`` words.  Every line that lies in a run which also stands, line for
line, at an earlier place is deleted; places are ordered by doc_id (null last),
text hash and line.  The first copy of a run always stays.

1. Winnowing.  A window is a stretch of lines with ``min_words`` words from which neither end line can be spared.
   The least line hash of each window is selected as its fingerprint (the first one of equals), so a repeated
   run, which holds a window, always shares a fingerprint with its earlier copy.
2. Positions are joined: only fingerprints found at two places are followed, and a
   window there matches if its lines also stand at an earlier place.
3. Matches are extended both ways, line by line, as long as the longer run
   stands at an earlier place too, up to where the next window takes over.
   Later runs go: the lines of matched windows and of their extensions.

Lines, windows and extended runs are compared by 128-bit hash.  Hot fingerprints and windows are reduced to their first and last place by
partial aggregation before any shuffle, so no task collects their places, and no pairs are made.

Null text counts as empty.  Rows equal in doc_id and text are one document and
stay alike.  Texts with fewer than ``min_words`` words are unchanged; very long texts are cut whole.  Ties: places are
ordered by doc_id, text hash and line.  An empty table gives an
empty result.  Other columns, null or not, pass through; one named like the result's is replaced.

Passages that start or end within a line are a second pass, :func:`dedup_passages`: runs of words, whatever their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, sieved

MIN_WORDS = 30
#: Words of a passage within lines, at least.
PASSAGE_WORDS = 50
#: Hashes below this are an eighth of all.
LOW = -(6 << 60)


def _reach(n: Column, least: int) -> Column:
    """``sum, len``: the fewest leading elements of the array ``n`` that sum up to ``least``, or all."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len"))
    return F.aggregate(n, start, lambda a, x: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["len"] + 1).alias("len"))))


def _room(n: Column, spent: Column, most: int) -> Column:
    """How many leading elements of the array ``n`` can follow ``spent`` with a sum below ``most``."""
    start = F.struct(spent.cast("int").alias("sum"), F.lit(0).alias("len"))
    return F.aggregate(n, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when(a["sum"] + x < most, a["len"] + 1).otherwise(a["len"]).alias("len")), lambda a: a["len"])


def windows(text: Column, min_words: int) -> Column:
    """Array of the windows of a text: ``fp``, ``at`` (line of the fingerprint), and the line numbers ``lines`` and line hashes ``h1``, ``h2``
    of the window's ``size`` lines with the ``before`` lines ahead of them and the lines behind them that an extension may reach."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    unit = lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("x"))
    units = F.filter(F.transform(lines, unit), lambda u: u["n"] > 0)
    hashed = lambda us: F.struct(us["i"].alias("i"), us["n"].alias("n"), F.transform(us, lambda u: F.xxhash64(u["x"])).alias("h1"), F.transform(us, lambda u: F.xxhash64(F.lit(7), u["x"])).alias("h2"))
    w = min_words

    def cut(u: Column) -> Column:
        n = u["n"]
        first = F.transform(n, lambda x, s: F.struct(s.alias("s"), x.alias("x"), _reach(F.slice(n, s + 1, w), w).alias("r")))
        whole = F.filter(first, lambda f: (f["r"]["sum"] >= w) & (f["r"]["sum"] - f["x"] < w))

        def made(f: Column) -> Column:
            s, size, total = f["s"], f["r"]["len"], f["r"]["sum"]
            ahead = F.reverse(F.slice(n, F.greatest(F.lit(1), s + 1 - w), F.least(F.lit(w), s)))
            before = _room(ahead, total - F.get(n, s + size - 1), w)
            behind = _room(F.slice(n, s + size + 1, w), total - f["x"], w)
            return F.struct(s.alias("s"), size.alias("size"), before.alias("before"), (before + size + behind).alias("all"))

        def named(x: Column) -> Column:
            own = F.slice(u["h1"], x["s"] + 1, x["size"])
            least = F.array_min(own)
            part = lambda c: F.slice(u[c], x["s"] - x["before"] + 1, x["all"])
            at = F.get(u["i"], (x["s"] + F.array_position(own, least) - 1).cast("int"))
            return F.struct(least.alias("fp"), at.alias("at"), x["before"].alias("before"), x["size"].alias("size"), part("i").alias("lines"), part("h1").alias("h1"), part("h2").alias("h2"))

        return F.transform(F.transform(whole, made), named)

    return let(let(units, hashed), cut)


def _keys(start: Column, size: Column) -> tuple[Column, Column]:
    """128-bit hash, in two columns, of ``size`` lines of a window's row from place ``start`` on."""
    return F.xxhash64(F.slice("h1", start + 1, size)), F.xxhash64(F.slice("h2", start + 1, size))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", extend: bool = True) -> DataFrame:
    """``id, th, gone``: for each document that loses lines, their numbers from 0, ascending (``th``: hash of the text).

    ``extend=False`` leaves out step 3, for comparison.
    """
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    found = materialize(docs.select(docs[doc_id].alias("id"), th.alias("th"), F.inline(windows(docs[text], min_words))), "line-windows")

    def place(line: Column) -> Column:
        return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), line.alias("line"))

    def firsts(rows: DataFrame, at: Column, *keys: str) -> DataFrame:
        """First places of keys that stand at two places or more."""
        seen = rows.groupBy(*keys).agg(F.min(place(at)).alias("first"), F.max(place(at)).alias("last"))
        return seen.where(~F.col("first").eqNullSafe(F.col("last"))).select(*keys, "first")

    spread = materialize(firsts(found, F.col("at"), "fp").select("fp"), "line-fingerprints")
    k1, k2 = _keys(F.col("before"), F.col("size"))
    followed = found.join(spread, "fp", "left_semi").withColumns({"k1": k1, "k2": k2}).drop("fp", "at")
    followed = materialize(followed, "line-positions")

    start = F.get("lines", F.col("before"))
    matched = materialize(firsts(followed, start, "k1", "k2"), "line-matches")
    seeds = materialize(followed.join(matched, ["k1", "k2"]), "line-seeds")
    later = seeds.where(~place(start).eqNullSafe(F.col("first")))
    gone = later.select("id", "th", F.explode(F.slice("lines", F.col("before") + 1, F.col("size"))).alias("line"))
    if extend:
        before, behind = F.col("before"), F.size("lines") - F.col("before") - F.col("size")
        none = F.array().cast("array<int>")
        # Each step is the run from the window to the step's line, the line it adds, and the run's first line.
        left = F.transform(F.when(before > 0, F.sequence(F.lit(1), before)).otherwise(none), lambda j: _step(before - j, F.col("size") + j, before - j))
        right = F.transform(F.when(behind > 0, F.sequence(F.lit(1), behind)).otherwise(none), lambda j: _step(before, F.col("size") + j, before + F.col("size") + j - 1))
        steps = materialize(seeds.select("id", "th", F.inline(F.concat(left, right))), "line-steps")
        again = materialize(firsts(steps, F.col("start"), "k1", "k2"), "line-step-matches")
        further = steps.join(again, ["k1", "k2"]).where(~place(F.col("start")).eqNullSafe(F.col("first")))
        gone = gone.unionByName(further.select("id", "th", "line"))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _step(start: Column, size: Column, line: Column) -> Column:
    k1, k2 = _keys(start, size)
    return F.struct(k1.alias("k1"), k2.alias("k2"), F.get("lines", start).alias("start"), F.get("lines", line).alias("line"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", gone: str = "removed_lines") -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and the array column ``gone`` of the deleted line numbers."""
    names = [c for c in docs.columns if c != gone]
    hits = materialize(repeated_lines(docs, min_words, doc_id, text), "line-gone")
    lines = F.split(docs[text], "\n")
    stay = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__cut")), lambda i: F.get(ls, i)), "\n")
    return _changed(docs.select(*names), hits, doc_id, text, gone, let(lines, stay))


def _changed(docs: DataFrame, hits: DataFrame, doc_id: str, text: str, gone: str, new: Column) -> DataFrame:
    """``docs`` with ``new`` (of the array ``__cut``) for the texts of ``hits (id, th, gone)``, and the array column ``gone``.

    Only texts that change move: a sieve keeps the others in place.  Those and the hits are the same documents, so both sides of the join are shuffled.
    """
    names = docs.columns
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    marked = sieved(docs.withColumn("__h", th), F.xxhash64(F.col(doc_id), F.col("__h")), hits, "id", "th")
    hits = hits.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__cut"))
    moved = marked.where("__maybe").join(hits.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    none = F.array().cast("array<int>")
    moved = moved.select(*(F.when(F.col("__cut").isNull(), F.col(c)).otherwise(new).alias(c) if c == text else F.col(c) for c in names), F.coalesce(F.col("__cut"), none).alias(gone))
    return marked.where(~F.col("__maybe")).select(*names, none.alias(gone)).unionByName(moved)


def _words(text: Column) -> Column:
    """Words of a text, each with the white space after it; what stands before the first is left out."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))


def _hashes(words: Column, seed: int) -> Column:
    return F.transform(words, lambda x: F.xxhash64(F.lit(seed), F.rtrim(x, F.lit(" \t\n\r\x0b\x0c"))))


def anchors(text: Column, size: int) -> Column:
    """Array of ``fp``, ``lo``, ``hi``: each window of ``size`` words (``lo`` to ``hi`` are first words) under the fingerprint of its anchor.

    The anchor is the first word of least hash, so equal windows have it at the same place; it counts
    with the half window before it if that lies in the window, else with the one after it.
    Low hashes and stretches of a window or more without any decide which words can be anchors.
    """
    side = (size + 1) // 2

    def made(h: Column) -> Column:
        n = F.size(h)
        low = F.filter(F.transform(h, lambda x, i: F.when(x < LOW, i)), lambda i: i.isNotNull())

        def with_gaps(p: Column) -> Column:
            ends = F.concat(F.array(F.lit(-1)), p, F.array(n))
            gap = lambda a, i: F.when(F.get(ends, i + 1) - a > size, F.sequence(a + 1, F.get(ends, i + 1) - 1)).otherwise(F.array().cast("array<int>"))
            return F.array_sort(F.concat(p, F.flatten(F.transform(F.slice(ends, 1, F.size(p) + 1), gap))))

        places = let(let(low, with_gaps), lambda c: F.transform(c, lambda i: F.struct(i.alias("p"), F.get(h, i).alias("h"))))

        def spans(c: Column) -> Column:
            def near(x: Column, j: Column) -> Column:
                few, many = F.lit(12), F.lit(size)
                back = F.when((j < few) | (F.get(c, j - few)["p"] <= x["p"] - size), few).otherwise(many)
                left = F.slice(c, F.greatest(F.lit(1), j - back + 1), F.least(back, j))
                right = F.slice(c, j + 2, F.when(F.coalesce(F.get(c, j + few)["p"], n + size) >= x["p"] + size, few).otherwise(many))
                q = F.aggregate(left, F.lit(-1), lambda a, y: F.when(y["h"] <= x["h"], y["p"]).otherwise(a))
                r = F.aggregate(right, n, lambda a, y: F.when((y["h"] < x["h"]) & (y["p"] < a), y["p"]).otherwise(a))
                return F.struct(x["p"].alias("p"), F.greatest(q + 1, x["p"] - size + 1).alias("lo"), F.least(x["p"], r - size).alias("hi"))

            def sides(x: Column) -> Column:
                mid = x["p"] - side + 1
                part = lambda at, lo, hi, seed: F.struct(F.xxhash64(F.lit(seed), F.slice(h, F.greatest(at, F.lit(0)) + 1, side)).alias("fp"), x["p"].alias("at"), lo.alias("lo"), hi.alias("hi"))
                return F.filter(F.array(part(mid, x["lo"], F.least(x["hi"], mid), 1), part(x["p"], F.greatest(x["lo"], mid + 1), x["hi"], 2)), lambda y: y["lo"] <= y["hi"])

            return F.flatten(F.transform(F.filter(F.transform(c, near), lambda x: x["lo"] <= x["hi"]), sides))

        return let(places, spans)

    kind = "array<struct<fp:bigint,at:int,lo:int,hi:int>>"
    return let(_words(text), lambda w: F.when(F.size(w) >= size, let(_hashes(w, 1), made)).otherwise(F.array().cast(kind)))


def repeated_passages(docs: DataFrame, size: int = PASSAGE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, th, gone``: for each document with a passage of ``size`` words or more that stands at an earlier place, the words that go, from 0.

    Places are ordered as for lines.  Within a text only a copy that does not overlap the first counts, so that the first stays whole.
    """
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    found = materialize(docs.select(docs[doc_id].alias("id"), th.alias("th"), F.inline(anchors(docs[text], size))), "anchors")

    def place(at: Column) -> Column:
        return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), at.alias("at"))

    spread = found.groupBy("fp").agg(F.min(place(F.col("at"))).alias("first"), F.max(place(F.col("at"))).alias("last"))
    spread = materialize(spread.where(~F.col("first").eqNullSafe(F.col("last"))).select("fp"), "anchor-fingerprints")
    seats = found.join(spread, "fp", "left_semi").groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("lo", "hi")).alias("__seats"))
    seats = materialize(seats, "anchor-seats")

    marked = sieved(docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), th.alias("th")), F.xxhash64("id", "th"), seats, "__id", "__th")
    both = marked.where("__maybe").join(seats.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))

    def keys(w: Column) -> Column:
        pair = F.struct(_hashes(w, 1).alias("a"), _hashes(w, 7).alias("b"))
        each = lambda h: F.transform(F.flatten(F.transform("__seats", lambda s: F.sequence(s["lo"], s["hi"]))), lambda s: F.struct(s.alias("at"), F.xxhash64(F.slice(h["a"], s + 1, size)).alias("k1"), F.xxhash64(F.slice(h["b"], s + 1, size)).alias("k2")))
        return let(pair, each)

    windows_ = both.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.inline(let(_words(F.col("text")), keys)))
    windows_ = materialize(windows_, "passage-windows")
    here = place(F.col("at"))
    first = windows_.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    first = materialize(first.where(~F.col("first").eqNullSafe(F.col("last"))).select("k1", "k2", "first"), "passage-firsts")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = windows_.join(first, ["k1", "k2"]).where(~same | (F.col("at") >= F.col("first.at") + size))
    words = F.flatten(F.transform(F.collect_set("at"), lambda s: F.sequence(s, s + size - 1)))
    return later.groupBy("id", "th").agg(words.alias("gone")).select("id", "th", F.array_sort(F.array_distinct("gone")).alias("gone"))


def dedup_passages(docs: DataFrame, size: int = PASSAGE_WORDS, doc_id: str = "doc_id", text: str = "text", gone: str = "removed_words") -> DataFrame:
    """``docs`` with later repeated passages deleted from ``text``, and the array column ``gone`` of the deleted words' numbers.

    A line that ends with a deleted passage keeps its end.
    """
    names = [c for c in docs.columns if c != gone]
    hits = materialize(repeated_passages(docs, size, doc_id, text), "passage-gone")

    def stay(w: Column) -> Column:
        numbers = F.col("__cut")
        # Ends of deleted runs that end a line.
        last = F.transform(numbers, lambda x, k: F.when((F.coalesce(F.get(numbers, k + 1), F.lit(-1)) != x + 1) & F.contains(F.get(w, x), F.lit("\n")), x))
        kept = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), numbers)
        parts = F.concat(F.transform(kept, lambda i: F.struct(i.alias("i"), F.get(w, i).alias("x"))), F.transform(F.filter(last, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("i"), F.lit("\n").alias("x"))))
        return F.array_join(F.array_sort(parts)["x"], "")

    head = F.regexp_extract(docs[text], r"^[\x20\x09-\x0D]*", 0)
    return _changed(docs.select(*names), hits, doc_id, text, gone, F.concat(head, let(_words(docs[text]), stay)))
