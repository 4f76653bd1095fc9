"""N-gram Jaccard join by grouped prefixes (operator 7).

Documents are sets of shingle hashes.  Two sets link when
``den * |A and B| >= num * |A or B|``.

1. Order.  A counting pass over all shingles fills a sketch that grows with the input up to 2^23 cells;
   shingles whose cell is far above the mean come last in the global order, the rest
   are ordered by hash.  Any fixed order is exact; this one keeps common passages out of prefixes.
2. Prefixes.  Linked sets share a shingle among the first
   ``n - ceil(t * n) + 1`` of each.  Sets with identical prefix and size collapse into one group
   (equal sets first of all, which collapse to one node).
3. Group pairs.  Each prefix shingle of two groups or more picks one of its
   groups as hub, and a group joins the cluster of each of its hubs: every pair
   that shares a prefix shingle meets in a cluster, without a pair row.  Within blocks of a
   cluster, pairs of groups are filtered by size and by how much of their prefixes they share:
   beyond the shorter reach nothing but the rest of the set can be common.
4. Expand and verify.  Members of the groups that are left are expanded and their whole sets compared in blocks of
   ``BLOCK``; large clusters are cut into pairs of blocks, so no task holds one.
   A block returns a spanning forest of its links and link counts per node: linear rows, no link between components lost.
5. Components of the links, then membership for every document.

Shingles are compared by 64-bit hash, sets by size and 128-bit hash.

Every row is a document of its own: rows that repeat an id, or have none, are
compared by their own texts and get a result each.  A class is named by the smallest doc_id in it
(null if no row of it has an id).  Null, empty or blank texts have no set and link with
nothing.  Texts shorter than a shingle count as one shingle; long texts are hashed whole, however long a
word is.  doc_id is an integer.  Ties need no order: classes and link counts depend on the sets alone.
An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_groups, joined, materialize, sieved
from .components import components

#: Bits of a cell's number in the counting sketch: it grows with the input between these, a cell for every KB of files.
CELL_BITS = (20, 23)
#: Pieces that the sketch is summed in.
PIECES = 64
#: Sets compared at once, and columns of the incidence matrix at once.
BLOCK = 512
#: Shingles of a block of sets, about.
BLOCK_SHINGLES = 1 << 22
COLUMNS = 1 << 14
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Bytes of a word under one polynomial.
PIECE = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set of hashes, as two signed longs."""
    a, b = mixed(s + np.uint64(1)).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts: A-Z lower-cased, words of characters other than ASCII white space."""

    def __init__(self, k: int):
        self.k = k
        rng = np.random.default_rng(20240607)
        table = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        for b in range(65, 91):
            table[b] = table[b + 32]
        self.table = table
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.base = 0x9E3779B97F4A7C15 | 1

        self.powers = np.ones(PIECE, np.uint64)
        for j in range(1, PIECE):
            self.powers[j] = np.uint64(int(self.powers[j - 1]) * self.base & 0xFFFFFFFFFFFFFFFF)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of the bytes.

        A polynomial covers ``PIECE`` bytes at most; the pieces of longer words are mixed with their number
        before they are added, as polynomials of any length modulo 2 ** 64 collide on words that can be written down.
        """
        word = ~self.space[data]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        length = end - start
        stop = np.cumsum(length)
        inside = np.arange(stop[-1] if stop.size else 0) - np.repeat(stop - length, length)
        value = self.table[data[word]] * self.powers[inside % PIECE]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        if length.max(initial=0) <= PIECE:
            return mixed(total[stop] - total[stop - length] + length.astype(np.uint64)), start
        head = np.flatnonzero(inside % PIECE == 0)
        part = total[np.append(head[1:], inside.size)] - total[head]
        first = inside[head] == 0
        part = np.where(first, part, mixed(part ^ mixed((inside[head] // PIECE).astype(np.uint64))))
        return mixed(np.add.reduceat(part, np.flatnonzero(first)) + length.astype(np.uint64)), start

    def block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        h, start = self.words(data)
        at = np.searchsorted(start, np.append(begin, data.size + 1))
        n = h.size
        s = np.zeros(n, np.uint64)
        for j in range(self.k):
            shifted = np.zeros(n, np.uint64)
            shifted[: max(n - j, 0)] = h[j:]
            s = mixed(s * np.uint64(0xD6E8FEB86659FD93) + shifted + np.uint64(j + 1))
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= self.k:
                out.append(np.unique(s[a : b - self.k + 1]))
            elif b > a:  # the whole sequence as one shingle
                v = np.uint64(b - a)
                for x in h[a:b]:
                    v = mixed(np.array([v ^ x]))[0]
                out.append(np.array([v], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def __call__(self, texts: list) -> Iterator[np.ndarray]:
        run, size = [], 0
        for t in texts:
            raw = (t or "").encode()
            run.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield from self.block(run)
                run, size = [], 0
        if run:
            yield from self.block(run)


def cell_bits(docs: DataFrame) -> int:
    """Bits for the sketch's cells by the size that the plan states of its input; the least number if it states none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return CELL_BITS[0] if size >= 1 << 60 else min(max(CELL_BITS[0], (size >> 10).bit_length()), CELL_BITS[1])


def hot_cells(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bitmap of the sketch's cells whose count over all documents is far above the mean."""
    cells_, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells, held, waiting = Shingler(k), np.zeros(cells_, np.int64), [], 0

        def add() -> None:
            np.add(cells, np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=cells_), out=cells)
            held.clear()

        for b in batches:
            for s in shingler(b.column(0).to_pylist()):
                held.append(s)
                if (waiting := waiting + s.size) >= cells_:
                    add()
                    waiting = 0
        if held:
            add()
        if cells.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "counts": [x.tobytes() for x in cells.astype("<i8").reshape(PIECES, -1)]})

    def total(key, batches: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "counts": [np.sum([np.frombuffer(x, "<i8") for x in batches["counts"]], axis=0).tobytes()]})

    parts = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInPandas(total, "piece int, counts binary")
    cells = np.zeros((PIECES, cells_ // PIECES), np.int64)
    for r in parts.collect():  # PIECES rows of fixed size
        cells[r["piece"]] = np.frombuffer(r["counts"], "<i8")
    cells = cells.ravel()
    mean = cells.mean()
    return np.packbits(cells > mean + 6 * np.sqrt(mean) + 8)


def overlaps(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets; with ``left``, of the first ``left`` with the others."""
    n = len(sets)
    if n == 2 and left in (None, 1):
        both = np.concatenate(sets)
        both.sort()
        inter = int(np.count_nonzero(both[1:] == both[:-1]))
        return np.array([[inter]]) if left else np.array([[sets[0].size, inter], [inter, sets[1].size]])
    size = np.array([s.size for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(flat.size, bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if flat.size else new
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    split = n if left is None else left
    inter = np.zeros((split, n if left is None else n - left), np.float32)
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if col.size else 0) + COLUMNS, COLUMNS))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            m = np.zeros((n, min(COLUMNS, int(col[b - 1]) % COLUMNS + 1)), np.float32)
            m[row[a:b], col[a:b] % COLUMNS] = 1
            inter += m @ m.T if left is None else m[:left] @ m[left:].T
    return inter.astype(np.int64)


def possible(sizes: np.ndarray, prefixes: list[np.ndarray], ends: np.ndarray, num: int, den: int, left: int | None = None) -> np.ndarray:
    """Which sets may link with another one of the block, by size and shared prefix.

    ``ends``: places of the prefixes' last shingles in the global order.  The prefix that ends
    first holds all common shingles up to its end, so the intersection is at most the
    prefixes' overlap and that set's rest.
    """
    n = len(prefixes)
    rest = sizes - np.array([p.size for p in prefixes], np.int64)
    split, off = (n, 0) if left is None else (left, left)
    shorter = ends[:split, None] <= ends[None, off:]
    # Hashes that collide within a prefix count once in the overlap; allow for each.
    lost = np.array([p.size - np.unique(p).size for p in prefixes], np.int64)
    most = overlaps(prefixes, left) + lost[:split, None] + lost[None, off:] + np.where(shorter, rest[:split, None], rest[None, off:])
    a, b = sizes[:split, None], sizes[None, off:]
    ok = (most * (num + den) >= num * (a + b)) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
    if left is None:
        np.fill_diagonal(ok, False)
        return ok.any(axis=1)
    return np.concatenate((ok.any(axis=1), ok.any(axis=0)))


def linked_pairs(sets: list[np.ndarray], num: int, den: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs among the sets, each once; with ``left``, only of those between the first ``left`` and the others."""
    size = np.array([s.size for s in sets], np.int64)
    inter = overlaps(sets, left)
    split, off = (len(sets), 0) if left is None else (left, left)
    link = (den * inter >= num * (size[:split, None] + size[None, off:] - inter)) & (inter > 0)
    i, j = np.nonzero(np.triu(link, 1) if left is None else link)
    return i, j + off


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links between places ``i`` and ``j``."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(p), root(q)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(nodes[p]), int(nodes[q])))
    return out


def counted_here(here: int, hubs: list[tuple[int, ...]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs cluster ``here`` counts: a pair that meets in several clusters counts in the smallest.  ``hubs``: all of a member's, () for this one only."""
    if not any(hubs):
        return np.ones(i.size, bool)
    kinds = {h: n for n, h in enumerate(dict.fromkeys(hubs))}
    kind, names = np.array([kinds[h] for h in hubs]), list(kinds)
    pairs, back = np.unique(kind[i] * len(names) + kind[j], return_inverse=True)
    first = [not names[a] or not names[b] or min(set(names[a]) & set(names[b])) == here for a, b in (divmod(int(x), len(names)) for x in pairs)]
    return np.array(first, bool)[back]


def undominated(seats: DataFrame) -> DataFrame:
    """``seats (hub, group)`` without clusters that lie wholly inside another one, whose pairs meet there anyway.

    Each cluster is held against one other: the smallest hub that its own hub sits with.  That hub is smaller,
    so a cluster that is dropped for one that is dropped itself lies inside what that one lies inside.
    """
    above = seats.where("hub < group").groupBy(F.col("group").alias("h")).agg(F.min("hub").alias("over"))
    asked = seats.join(above, F.col("hub") == F.col("h")).select("hub", "group", "over")
    there = seats.select(F.col("hub").alias("o"), F.col("group").alias("g"))
    inside = asked.join(there, (F.col("over") == F.col("o")) & (F.col("group") == F.col("g")), "left_semi").groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    size = seats.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    gone = size.join(inside, "hub").where("n = m").select(F.col("hub").alias("gone"))
    return seats.join(gone, F.col("hub") == F.col("gone"), "left_anti")


def dealt(seats: DataFrame, who: str, size: str | None = None) -> DataFrame:
    """``hub, who, own, i, j``: seats of each cluster dealt into pairs of blocks of about ``BLOCK``; with ``size``, of about ``BLOCK_SHINGLES`` shingles at most."""
    least = F.count(F.lit(1)) / BLOCK
    if size:
        least = F.greatest(least, F.sum(size) / BLOCK_SHINGLES)
    blocks = materialize(seats.groupBy("hub").agg(F.ceil(least).cast("int").alias("blocks")), "blocks")
    out = seats.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64(who), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    return out.select("hub", who, "own", F.inline(pairs))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row: classes and numbers of links under Jaccard >= num / den of k-word shingles."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), docs[text].alias("text"))
    sc = docs.sparkSession.sparkContext
    bits = cell_bits(docs)
    shift = np.uint64(64 - bits)
    hot = sc.broadcast(hot_cells(docs, k, bits))  # an eighth of a byte per cell

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, late = Shingler(k), np.unpackbits(hot.value).astype(bool)
        kind = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("prefix", pa.list_(pa.int64()))])
        for b in batches:
            rows: dict[str, list] = {c: [] for c in kind.names[2:]}
            for s in shingler(b.column(2).to_pylist()):
                n = s.size
                is_late = late[(s >> shift).astype(np.int64)]
                p = n - -(-num * n // den) + 1 if n else 0
                first = s[~is_late][:p]
                if first.size < p:
                    first = np.concatenate((first, s[is_late][: p - first.size]))
                for c, v in zip(rows, (n, *digest(s), *digest(first), first.view(np.int64)), strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "t": b.column(1), **rows}, schema=kind)

    every = materialize(docs.mapInArrow(prefixes, "doc_id long, t long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>"), "prefixes")
    # Equal sets are one node; the row of smallest doc_id, then text hash, lends its text.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    sets = every.where("n > 0").groupBy("n", "s1", "s2", "p1", "p2").agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "p1", "p2", "copies", "rep.doc_id", "rep.t"), "sets")

    # Groups of identical prefix and size, labelled by a one-to-one hash of a number: a spread-out but fixed
    # priority keeps hubs few, as the same group tends to lead all shingles of a cluster.
    group = every.where("n > 0").groupBy("n", "p1", "p2").agg(F.first("prefix").alias("prefix"))
    group = materialize(group.select(F.xxhash64(F.monotonically_increasing_id()).alias("group"), "n", "p1", "p2", "prefix"), "groups")
    ids = materialize(every.select("doc_id", "n", "s1", "s2"), "rows")
    discard(every)
    heads = group.select("group", F.explode("prefix").alias("shingle"))
    hubs = heads.groupBy("shingle").agg(F.min("group").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hubs = materialize(hubs.select("shingle", "hub"), "hubs")
    seated = materialize(heads.join(hubs.hint("merge"), "shingle").select("hub", "group").distinct(), "clusters")
    clusters = materialize(undominated(seated), "clusters")
    discard(hubs, seated)

    # Filter pairs of groups by what sizes and prefixes allow.
    # Half of each hash will do here: what collides can only let a pair pass.
    halves = F.transform("prefix", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    facts = group.select("group", "n", F.element_at("prefix", -1).alias("final"), halves.alias("prefix"))
    seated = dealt(clusters, "group").join(facts.hint("merge"), "group")

    def sift(b: pa.RecordBatch) -> dict | None:
        field = lambda c: b.column(b.schema.get_field_index(c))
        if b.num_rows < 2:
            return None
        i, j = field("i")[0].as_py(), field("j")[0].as_py()
        lists = field("prefix")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        made = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        final = field("final").to_numpy().view(np.uint64)
        # Late shingles follow all others in the global order: half the range each keeps order and fits.
        ends = (final >> np.uint64(1)) + (late_bits()[(final >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(63))
        n_left = None if i == j else int(np.count_nonzero(field("own").to_numpy() == i))
        if n_left is not None and not 0 < n_left < b.num_rows:
            return None
        ok = possible(field("n").to_numpy(), made, ends, num, den, n_left)
        return {"hub": field("hub").to_numpy()[ok], "group": field("group").to_numpy()[ok]} if ok.any() else None

    def late_bits() -> np.ndarray:
        if not cached:
            cached.append(np.unpackbits(hot.value).astype(bool))
        return cached[0]

    cached: list[np.ndarray] = []
    left = in_groups(seated.select("hub", "i", "j", "own", "group", "n", "final", "prefix"), ["hub", "i", "j"], ["own", "group"], sift, "hub long, group long").distinct()
    sifted = materialize(left, "sifted")
    left = materialize(undominated(sifted), "sifted")
    # Members of one group are a pair as well.
    named = materialize(sets.join(group.select("n", "p1", "p2", "group"), ["n", "p1", "p2"]).select("group", "node", "n"), "named")
    discard(clusters, sifted, group)
    own = named.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("group").alias("hub"), "group")
    members = materialize(left.unionByName(own).distinct().join(named, "group").select("hub", "node", "n").distinct(), "seats")

    seats = dealt(members, "node", "n").withColumnRenamed("node", "d").groupBy("d").agg(F.collect_list(F.struct("hub", "own", "i", "j")).alias("seats"))
    rep = sets.select("node", "s1", "s2", "copies", F.col("doc_id").alias("rep_id"), F.col("t").alias("rep_t"))
    seats = materialize(seats.join(rep, F.col("d") == F.col("node")).drop("d"), "dealt")
    # Only one text of each node with a seat goes on, and a sieve keeps the others in place; both sides are the same documents.
    marked = sieved(docs, F.xxhash64("doc_id", "t"), seats, "rep_id", "rep_t").where("__maybe")
    texts = marked.join(seats.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("t") == F.col("rep_t"))).select("text", "node", "s1", "s2", "copies", "seats")

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text once a task, however often its row is repeated."""
        seen = set()
        for b in batches:
            new = [not (x in seen or seen.add(x)) for x in zip(b.column(1).to_pylist(), map(hash, b.column(0).to_pylist()), strict=True)]
            yield b.filter(pa.array(new, pa.bool_()))

    # Texts travel, not their sets: compressed, they are a fraction of the size.
    kept = texts.mapInArrow(lent, "text string, node long, s1 long, s2 long, copies long, seats array<struct<hub:long,own:int,i:int,j:int>>")
    several = F.array_sort(F.array_distinct(F.transform("seats", lambda s: s["hub"])))
    kept = kept.withColumn("hubs", F.when(F.size(several) > 1, several).otherwise(F.array().cast("array<bigint>"))).select("text", "node", "s1", "s2", "copies", "hubs", F.inline("seats"))

    def compare(b: pa.RecordBatch) -> dict | None:
        field = lambda c: b.column(b.schema.get_field_index(c))
        if b.num_rows < 2:
            return None
        # The rows that bring their node's set; of repeated ones the first.
        every, own = list(shingler(field("text").to_pylist())), field("own").to_numpy()
        mine = np.array([digest(x) == (y, z) for x, y, z in zip(every, field("s1").to_pylist(), field("s2").to_pylist(), strict=True)])
        at = np.flatnonzero(mine)
        nodes = field("node").to_numpy()[at]
        at = at[np.append(True, (nodes[1:] != nodes[:-1]) | (own[at][1:] != own[at][:-1]))[: at.size]]
        nodes, own, copies, made = field("node").to_numpy()[at], own[at], field("copies").to_numpy()[at], [every[x] for x in at]
        i, j = field("i")[0].as_py(), field("j")[0].as_py()
        n_left = None if i == j else int(np.count_nonzero(own == i))
        if len(made) < 2 or (n_left is not None and not 0 < n_left < len(made)):
            return None
        p, q = linked_pairs(made, num, den, n_left)
        if not p.size:
            return None
        ties = forest(nodes, p, q)
        hubs = [tuple(h) for h in field("hubs").take(pa.array(at)).to_pylist()]
        mine = counted_here(field("hub")[0].as_py(), hubs, p, q)
        n = np.zeros(nodes.size, np.int64)
        np.add.at(n, p[mine], copies[q[mine]])
        np.add.at(n, q[mine], copies[p[mine]])
        some = np.flatnonzero(n)
        return {"a": [t[0] for t in ties] + nodes[some].tolist(), "b": [t[1] for t in ties] + nodes[some].tolist(), "n": [0] * len(ties) + n[some].tolist()}

    shingler = Shingler(k)
    found = in_groups(kept.select("hub", "i", "j", "own", "node", "copies", "s1", "s2", "hubs", "text"), ["hub", "i", "j"], ["own", "node"], compare, "a long, b long, n long")
    found = materialize(found, "found")
    linked = materialize(components(found.where("n = 0").select("a", "b")), "components")
    classes = linked.join(sets.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = linked.join(classes, "component").select(F.col("node").alias("c"), "least")
    links = found.where("n > 0").groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("links"))
    facts = sets.join(named, F.col("node") == F.col("c"), "left").join(links, F.col("node") == F.col("l"), "left")
    facts = facts.select("n", "s1", "s2", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = ids.join(materialize(facts, "classes"), ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
