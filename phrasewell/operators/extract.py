"""One pass over each file: its facts and its phrases, aggregated where the text is.

The rules are those of ``functions.text``.  As expressions they take an exploded row per token and a shuffle
to bring a file's tokens together again, with several regular expressions per line; here a file's
tokens are counted as they are read, in Arrow batches, so a build shuffles one row per (file, phrase) and no text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as X

IDENTIFIER = re.compile(X.IDENTIFIER)
DEFINITION = re.compile(X.DEFINITION)
OPENER = re.compile(r"[(<\[=:{]|->")
STRUCTURAL = re.compile(X.STRUCTURAL)
LOWER = re.compile("[a-z]")
MARKS = ("#", "//", "/*", "*", "<!--", ">")
SPACES = re.compile(f"[{X.WHITE_SPACE}]+")
RUN = re.compile(f"[^{X.WHITE_SPACE}]+")

#: Occurrences of a phrase that samples look at: of a file, the first of these with a left word is kept.
SAMPLES = 5
#: Rows of a batch, about.
ROWS = 100_000

SCHEMA = (
    "file_path string, phrase string, is_def int, zone int, cnt long, first_line int, word string, spot long, nth int, "
    "content_len long, digest string, readable boolean, comment_ratio double"
)
#: What a row of a phrase, and the one row of a file (phrase null), hold.
OCC = ("phrase", "file_path", "is_def", "zone", "cnt", "first_line", "word", "spot", "nth")
FACTS = ("file_path", "content_len", "digest", "readable", "comment_ratio")


def lines(text: str) -> list[str]:
    if not text:
        return []
    if text.endswith("\n"):
        text = text[:-2] if text.endswith("\r\n") else text[:-1]
    return text.replace("\r\n", "\n").split("\n")


def zone(s: str, names: int) -> int:
    """0 for code, 1 for prose, of a line without outer white space that holds ``names`` identifiers."""
    if not s or s.startswith(("//", "/*")):
        return 1
    if s[0] == "#":
        return 0 if s[1:2] == "!" or (len(s.encode()) > 2 and s[1:3] in X.DIRECTIVES) else 1
    if s.startswith(("*", "<!--", ">")):
        return 1
    if names >= 3:
        return 0
    if not names:
        return 1
    size = len(s.encode())
    lower, structural = len(LOWER.findall(s)) / size, len(STRUCTURAL.findall(s)) / size
    if lower > 0.65 and structural < 0.08:
        return 1
    if names < 2 and lower > 0.5 and structural < 0.05:
        words = SPACES.split(s)
        return int(sum(len(w.encode()) for w in words) / len(words) < 6)
    return 0


def left_word(line: str, starts: list[int], ends: list[int], at: int) -> str:
    """Last word of what stands before place ``at``, within its run without white space or the run before: 30 characters at most, lower case.

    ``starts, ends``: all runs of the line, found once for all of its identifiers, so that long lines take linear time.
    """
    k = bisect_right(starts, at) - 1
    end = at
    if starts[k] == at:
        if not k:
            return ""
        k -= 1
        end = ends[k]
    return line[starts[k] : min(end, starts[k] + 30)].lower()


def phrases(text: str) -> tuple[dict[str, list], int, int]:
    """``phrase: [is_def, zone, cnt, first_line, word, spot, nth]`` of a text, and its lines and comment lines.

    ``word``: left word of the ``nth`` occurrence, at ``spot`` (line and place in it); none: "" and ``nth`` 0.
    """
    found: dict[str, list] = {}
    comments, every = 0, lines(text)
    for n, line in enumerate(every):
        s = line.strip(X.WHITE_SPACE)
        comments += s.startswith(MARKS)
        hits = [(m.group(), m.start()) for m in IDENTIFIER.finditer(line)]
        if not hits:
            continue
        z = zone(s, len(hits))
        starts: list[int] = []
        for p, at in hits:
            if (e := found.get(p)) is None:
                e = found[p] = [0, z, 0, n, "", 0, 0]
            e[2] += 1
            if z < e[1]:
                e[1] = z
            if not e[6] and e[2] <= SAMPLES:
                if not starts:
                    starts, ends = map(list, zip(*(m.span() for m in RUN.finditer(line)), strict=True))
                if w := left_word(line, starts, ends, at):
                    e[4:] = w, n << 32 | at, e[2]
        if not z and OPENER.search(line):
            for m in DEFINITION.finditer(line):
                found[m.group()][0] = 1
    return found, len(every), comments


def extract(corpus: DataFrame) -> DataFrame:
    """Rows of ``corpus (file_path, text)``: one per phrase of each file, and one per file with a null phrase.  Null text: unreadable, no phrases."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, n, comments = phrases(text or "")
                raw = None if text is None else text.encode()
                rows.extend((path, p, *e, None, None, None, None) for p, e in found.items())
                rows.append((path, *[None] * 8, len(raw or b""), None if raw is None else hashlib.sha256(raw).hexdigest(), raw is not None, comments / n if n else 0.0))
                if len(rows) >= ROWS:
                    yield packed()
        if rows:
            yield packed()

    return spread(corpus.select("file_path", "text")).mapInArrow(run, SCHEMA)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores: a table in fewer files than there are cores is dealt out anew, larger ones stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
