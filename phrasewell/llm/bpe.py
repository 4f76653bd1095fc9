"""BPE encoding and decoding with a public vocabulary file (operator 9).

Texts are split into words by the file's rules; the distinct words of a batch
that are not in the worker's cache are encoded together: their symbols lie in
one flat array, and each round finds every word's lowest-rank pair by binary
search over the sorted pair keys and merges it, until no pair is left.

``encode`` adds little-endian unsigned 32-bit ids and their count; ``decode``
turns ids into the text that the tokenizers library gives (tokens joined by
one space, as the file has no decoder).  The vocabulary is sent once per
executor; its size is that of the file, whatever the corpus.

Null and empty texts have no ids and decode to "".  Rows are independent, so
ties, repeats and empty tables need no care.  A very long text is a block of its own, split at once; what a
worker keeps beyond that is bounded in bytes.  Existing columns of the same name are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words and ids kept per worker, with an allowance for each entry; the cache starts anew when full.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 200
#: A longer word is not kept.
LONGEST_KEPT = 256
#: Characters handled at once.
BLOCK_CHARS = 500_000


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level byte BPE read from a tokenizers JSON file with an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.check(spec)
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.splits = regex.compile("|".join(regex.escape(c) for c in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    @staticmethod
    def check(spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError("unsupported kind of vocabulary file")

    @staticmethod
    def normalize(text: str) -> str:
        """NFC and lower case character by character; white space is dropped by the word pattern anyway."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pieces(self, text: str) -> Iterator[str]:
        """Words, and special tokens where their strings stand in the raw text."""
        if self.splits is None or "<|" not in text:
            return iter(self.words.findall(self.normalize(text)))
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += self.words.findall(self.normalize(text[at : m.start()]))
            out.append(m.group())
            at = m.end()
        return iter(out + self.words.findall(self.normalize(text[at:])))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for pairs that never merge."""
        key = left * self.base + right
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return np.where(self.keys[place] == key, self.rank[place], len(self.keys))

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, by merge rounds over one flat array of all the words' symbols."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        ends = np.cumsum(size)
        symbol[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        never = len(self.keys)
        # rank[i] is that of symbols i and i + 1; the last symbol of a word has none.
        rank = np.append(self.ranks(symbol[:-1], symbol[1:]), never)
        rank[ends - 1] = never
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbol.size:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.append(start, symbol.size))
            least = np.minimum.reduceat(rank, start)
            if (least == never).any():  # these words are complete
                over = np.repeat(least == never, length)
                done.append((word[over], symbol[over]))
                symbol, word, rank = symbol[~over], word[~over], rank[~over]
                open_ = least < never
                length, least = length[open_], least[open_]
                if not symbol.size:
                    break
            # In a run of overlapping equal pairs every second one merges, from the left.
            at = np.flatnonzero(rank == np.repeat(least, length))
            if at.size > 1 and (np.diff(at) == 1).any():
                i = np.arange(at.size)
                first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], i, 0))
                at = at[(i - first) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            last = word[np.minimum(at + 2, word.size - 1)] != word[at]
            last |= at + 2 >= word.size
            keep = np.ones(symbol.size, bool)
            keep[at + 1] = False
            rank[at] = -1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            now = np.flatnonzero(rank == -1)
            rank[now] = never
            more = now[~last]
            rank[more] = self.ranks(symbol[more], symbol[more + 1])
            before = now[(now > 0)]
            before = before[word[before - 1] == word[before]] - 1
            rank[before] = self.ranks(symbol[before], symbol[before + 1])
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        packed = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        cuts = np.append(0, 4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [list(self.pieces(t)) for t in texts]
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        cache = self.cache
        if not cache:
            cache.update({c: np.array([i], "<u4").tobytes() for c, i in self.special.items()})
        new = [w for w in {w for s in split for w in s} if w not in cache]
        if new:
            cache.update(zip(new, self.merge(new), strict=True))
            self.cached += sum(len(w) + len(cache[w]) for w in new) + ENTRY_BYTES * len(new)
        out = [b"".join(map(cache.__getitem__, s)) for s in split]
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            self.cached -= len(w) + len(cache.pop(w)) + ENTRY_BYTES
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blocks(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``most`` bytes, "" for nulls; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield ["" if t is None else t for t in texts.slice(at, to - at).to_pylist()]
        at = to


def _loaded(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """``docs`` with columns ``ids`` (binary, little-endian uint32) and ``n_tokens`` (long); with ``decoded``, also that column, decoded in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(_loaded(vocabulary))
    added = [ids, n_tokens] + [decoded] * bool(decoded)
    docs = docs.drop(*(set(added) & set(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(shared.value)
        for b in batches:
            at = 0
            for texts in _blocks(b.column(b.schema.get_field_index(text)), BLOCK_CHARS):
                out = model.encode(texts)
                more = [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())] + [pa.array(map(model.decode, out), pa.string())] * bool(decoded)
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns, *more], names=[*b.schema.names, *added])
                at += len(texts)

    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``text`` decoded from the binary column ``ids``; null ids decode to ""."""
    shared = tokens.sparkSession.sparkContext.broadcast(_loaded(vocabulary))
    tokens = tokens.drop(*({text} & set(tokens.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(shared.value)
        for b in batches:
            out = [model.decode(x or b"") for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())]))


def unpack(ids):
    """Column: array<long> of the ids in a binary column of little-endian uint32."""
    n = (F.octet_length(ids) / 4).cast("int")
    byte = lambda i, k: F.conv(F.hex(ids.substr(i * 4 + (k + 1), F.lit(1))), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)).otherwise(F.array().cast("array<bigint>"))
