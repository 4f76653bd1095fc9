"""Personal data by weak-supervision aggregation (operator 3).

1. Base spans: e-mail, IP, card and phone patterns, leftmost and non-overlapping per kind, with their checks.
2. Candidates: every token with a digit or an at-sign, account and identity numbers written in groups, and
   capitalised names after a word that announces one.  Labelers vote on each:
   patterns, a gazetteer of words that announce personal data or other numbers, and the context.
3. The votes of all candidates of all documents are counted by pattern, at most ``3 ** len(LABELERS)``
   of them.  Expectation maximisation on the counts estimates each labeler's reliability and each pattern's probability.
4. Those probabilities, summed by feature pattern (at most ``2 ** len(FEATURES)``), train the final span classifier, a logistic regression
   on shape and context features.
5. Candidates it accepts and no base span overlaps are added; base spans always stay.

Every scan is linear in the text, so very long texts and runs of digits or letters are searched whole.
Offsets are code points, end exclusive.  Null text counts as empty and has no
spans.  Rows are independent once the model is fitted, so repeated rows have equal spans; ties between kinds at one start go by
kind as listed, base kinds first.  An empty table or one
without candidates keeps base spans only.  Existing columns of the result's name are replaced; others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

# The base patterns, in forms that never look twice at a run of characters.  What may come before an
# at-sign is looked for from there backwards; a dotted number starts where a run of digits does.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

DIGIT = re.compile(r"[0-9@]+")
TOKEN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+@-")
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: Numbers written in groups.
GROUPED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?|[0-9]{3}[ .][0-9]{2}[ .][0-9]{4})(?![A-Za-z0-9])")
#: Ends of the words that announce a name: a text without any is not searched for one.
NAME_WORDS = ("ame is", "ame:", "ame :", "tact is", "tact:", "tact :", "ient is", "ient:", "ient :", "omer is", "omer:", "omer :", "oyee is", "oyee:", "oyee :", "gned is", "gned:", "gned :", "ttn is", "ttn:", "ttn :")
#: A capitalised name of two or three words after a word that announces one.
NAMED = re.compile(r"(?<![A-Za-z])(?:[Nn]ame|[Cc]ontact|[Pp]atient|[Cc]ustomer|[Ee]mployee|[Cc]lient|[Ss]igned|[Aa]ttn)(?: ?: ?| is )((?:[A-Z][a-z'-]{1,30} ){1,2}[A-Z][a-z'-]{1,30})(?![A-Za-z])")
NUMBER = re.compile(r"[0-9]{1,4}(\.[0-9]{1,3})?")

#: Patterns that a task holds before it passes them on.
MOST_HELD = 100_000

# Words that announce personal data, and words that announce other numbers.
ANNOUNCE = frozenset("token key secret password passwd pwd apikey bearer auth login user account iban ssn passport id email mail e-mail tel telephone phone mobile call fax contact card visa iban address".split())
PLAIN = frozenset("version v page pages chapter section figure table year line lines no number vol volume edition step item part by-nc by".split())
LABELERS = ("base", "hex", "national", "iban", "announced", "assigned", "number", "plain", "short", "name")
FEATURES = ("digits6", "digits9", "letters", "hex_run", "at", "dots", "dashes", "assigned", "announced", "plain", "long", "quoted", "name")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Start and end of each match of ``[A-Za-z0-9._%+-]+@`` and a dotted domain, leftmost first, none overlapping."""
    out, done, k = [], 0, t.find("@")
    while k >= 0:
        a = k
        while a > done and t[a - 1] in LOCAL:
            a -= 1
        if a < k and (m := DOMAIN.match(t, k + 1)):
            out.append((a, m.end()))
            done = m.end()
        k = t.find("@", max(k + 1, done))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(t)]
    if not DIGIT.search(t):
        return out
    for m in IP.finditer(t):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def grouped(t: str) -> list[tuple[int, int]]:
    """Candidates of more than one token, none overlapping."""
    out = [m.span() for m in GROUPED.finditer(t)] if DIGIT.search(t) else []
    if any(w in t for w in NAME_WORDS):
        out = sorted(out + [m.span(1) for m in NAMED.finditer(t)])
    return [s for k, s in enumerate(out) if not k or s[0] >= out[k - 1][1]]


def silent(t: str | None) -> bool:
    """Whether a text can hold neither base spans nor candidates."""
    return not t or (not DIGIT.search(t) and not any(w in t for w in NAME_WORDS))


def tokens(t: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at-sign, without the marks around them, and the stretches ``taken``; by start."""
    done, k, n = 0, 0, len(t)
    for m in DIGIT.finditer(t):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and t[a - 1] in TOKEN:
            a -= 1
        while b < n and t[b] in TOKEN:
            b += 1
        done = b
        while b > a and t[b - 1] in ".-+%@_":
            b -= 1
        while a < b and t[a] in ".-%@_":
            a += 1
        while k < len(taken) and taken[k][1] <= a:
            yield taken[k]
            k += 1
        if a < b and not (k < len(taken) and taken[k][0] < b):
            yield a, b
    yield from taken[k:]


def candidates(t: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, int, int, bool]]:
    """(start, end, kind, votes, features, overlaps a base span) of each candidate."""
    k = 0
    for a, b in tokens(t, grouped(t)):
        while k < len(base) and base[k][2] <= a:
            k += 1
        covered = any(s < b and a < e for s, _, e in base[max(0, k - 4) : k + 4])
        s = t[a:b]
        joined = s.replace(" ", "").replace("-", "") if " " in s or s[:2].isupper() else s
        before = t[max(0, a - 24) : a]
        words = re.findall(r"[a-z-]+", before.lower())
        last = words[-1] if words else ""
        quoted = before[-1:] in ("'", '"')
        assigned = before.rstrip("'\" ")[-1:] in ("=", ":")
        digits = sum("0" <= c <= "9" for c in s)
        name = not digits and "@" not in s
        hexed = bool(HEX.fullmatch(s)) and digits > 0
        announced, plain = name or last in ANNOUNCE, last in PLAIN
        national = bool(NATIONAL.fullmatch(s.replace(" ", "-").replace(".", "-")))
        number, iban = bool(NUMBER.fullmatch(s)), bool(IBAN.fullmatch(joined)) and digits > 4
        # Each labeler: 0 silent, 1 personal, 2 not.
        votes = (int(covered), int(hexed and not s.isdigit()), int(national), int(iban), int(announced), int(assigned and digits > 3), 2 * number, 2 * plain, 2 * (digits < 4 and "@" not in s and not name), int(name))
        feats = (digits >= 6, digits >= 9, any(c.isalpha() for c in s), hexed, "@" in s, s.count(".") >= 2, s.count("-") >= 2, assigned, announced, plain, len(s) >= 16, quoted, name)
        kind = "name" if name else "secret" if hexed and not s.isdigit() else "iban" if iban else "national_id" if national else "contact" if "@" in s else "number"
        v = 0
        for x in votes:
            v = v * 3 + x
        f = 0
        for x in feats:
            f = f * 2 + int(x)
        yield a, b, kind, v, f, covered


def unpack(code: np.ndarray, base: int, n: int) -> np.ndarray:
    out = np.zeros((len(code), n), np.int64)
    for j in range(n - 1, -1, -1):
        out[:, j], code = code % base, code // base
    return out


def aggregate_votes(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(personal) of each vote pattern by expectation maximisation; labelers are independent given the truth."""
    n, m = votes.shape
    for_, against = (votes == 1).sum(1), (votes == 2).sum(1)
    p = (for_ + 0.3) / (for_ + against + 1.0)
    weight = count / max(count.sum(), 1)
    for _ in range(rounds):
        like = np.zeros((n, 2))
        for y, q in ((1, p), (0, 1 - p)):
            mass = (weight * q).sum()
            like[:, y] = np.log(mass + 1e-9)
            for j in range(m):
                seen = np.array([(weight * q)[votes[:, j] == v].sum() for v in range(3)])
                rate = (seen + 1e-3) / (mass + 3e-3)
                like[:, y] += np.log(rate)[votes[:, j]]
        p = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -30, 30)))
        # A pattern with votes on one side only keeps that side; EM can't flip meanings.
        p = np.where((for_ > 0) & (against == 0), np.maximum(p, 0.5), p)
        p = np.where((for_ == 0) & (against > 0), np.minimum(p, 0.5), p)
    return p


def fit_classifier(x: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w, c = np.zeros(x.shape[1]), count / max(count.sum(), 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (q - p)) + 1e-3 * w
        h = (x * (c * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, text: str = "text") -> dict:
    """The span classifier, and the labelers' votes it came from, fitted on all candidates of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if not silent(t):
                    for *_, v, f, _ in candidates(t, base_spans(t)):
                        seen[v, f] = seen.get((v, f), 0) + 1
            if len(seen) > MOST_HELD:
                yield packed(seen)
                seen = {}
        yield packed(seen)

    def packed(seen: dict[tuple[int, int], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"v": pa.array([k[0] for k in seen], pa.int64()), "f": pa.array([k[1] for k in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    votes = materialize(docs.select(text).mapInArrow(count, "v long, f long, n long").groupBy("v", "f").agg(F.sum("n").alias("n")), "votes")
    # At most 3 ** len(LABELERS) rows.
    by_vote = sorted(votes.groupBy("v").agg(F.sum("n").alias("n")).collect())
    if not by_vote:
        return {"weights": None}
    v, n = (np.array([r[k] for r in by_vote], np.int64) for k in ("v", "n"))
    p = aggregate_votes(unpack(v, 3, len(LABELERS)), n)
    # Probabilities in millionths, so that sums are exact in any order.
    known = docs.sparkSession.createDataFrame(list(zip(v.tolist(), np.round(p * 1e6).astype(int).tolist(), strict=True)), "v long, p long")
    # At most 2 ** len(FEATURES) rows.
    by_feature = sorted(votes.join(F.broadcast(known), "v").groupBy("f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p")).collect())
    f, m, q = (np.array([r[k] for r in by_feature], float) for k in ("f", "n", "p"))
    return {"weights": fit_classifier(unpack(f.astype(np.int64), 2, len(FEATURES)), q / m / 1e6, m), "votes": list(zip(v.tolist(), n.tolist(), p.tolist(), strict=True))}


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_personal_data(docs: DataFrame, text: str = "text", as_: str = "spans", model: dict | None = None) -> DataFrame:
    """``docs`` with the array ``as_`` of spans ``(kind, start, end, base)`` by start, then kind."""
    weights = (fit(docs, text) if model is None else model)["weights"]
    docs = docs.drop(*({as_} & set(docs.columns)))
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def spans(t: str | None, known: dict[int, bool]) -> list[dict]:
        if silent(t):
            return []
        base = base_spans(t)
        out = [(s, k, e, KINDS[k]) for s, k, e in base]
        if weights is not None:
            for a, b, kind, _, f, covered in candidates(t, base):
                if not covered:
                    if f not in known:
                        known[f] = bool(unpack(np.array([f]), 2, len(FEATURES))[0] @ weights[:-1] + weights[-1] > 0)
                    if known[f]:
                        out.append((a, len(KINDS), b, kind))
        out.sort()
        return [{"kind": name, "start": s, "end": e, "base": k < len(KINDS)} for s, k, e, name in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}
        for b in batches:
            found = [spans(t, known) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind_type)], names=[*b.schema.names, as_])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(as_, SPAN)]))


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets (overlaps: the first span wins)."""

    def step(a, s):
        start = F.greatest(s["start"], a["at"])
        kept = F.struct(F.concat(a["out"], F.substr(docs[text], (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(start == s["start"], kept).otherwise(a)

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    new = F.aggregate(docs[spans], first, step, lambda a: F.concat(a["out"], F.substr(docs[text], (a["at"] + 1).cast("int"))))
    return docs.withColumn(text, F.when(docs[text].isNotNull(), new))
