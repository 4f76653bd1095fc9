"""Embedding near-dedup with an inverted multi-index (operator 6).

Equal vectors of a label are one node.  Nodes are scaled to length 1 and cut into halves; each half has a codebook
fitted by k-means on a sample of at most ``SAMPLE`` nodes, and the pair of
nearest codewords is a node's cell in the product grid.  The codebooks grow with the root of the number of nodes, so a cell holds about
``CELL_LOAD`` of them at any size; as they start from sampled vectors, dense regions get more codewords.  Every node is
filed under its cell, and visits the nearest cells in multi-sequence order (by the sum
of squared distances to both codewords).  The number of cells to visit is
set by measuring, for up to ``PROBES`` sampled nodes against all of their label, at which
visit each true neighbour would be found, until the recall of all links and the mean recall of
the probes both meet ``recall`` (a group of thousands of near copies can't outvote the rest).  If ``MAX_VISITS`` are not enough, more
are measured, up to the whole grid, which finds all.  Where no probe has a neighbour, made-up
neighbours right at the threshold are measured instead.

Pairs that meet in a cell are verified by cosine in double precision, so no
link is below the threshold.  Vectors are scaled by a power of two first, so neither tiny nor huge components
leave the range.  Cells are compared in blocks of at most about ``BLOCK``
residents by ``2 * BLOCK`` others; a hot cell is cut into many blocks.  Blocks return
link counts and a spanning forest, never pairs.

Only vectors of equal length with equal, non-null labels are compared; a length with fewer than ``LEAST_FIT``
vectors in the sample has one cell, compared whole.  Null, empty and zero vectors and those with null or non-finite
components link with nothing.  Every row gets a result: rows that repeat an id, or have none, count as vectors of their own, and
a class is named by its smallest vec_id (null if none has one).  Ties at the threshold count as links; repeated rows link with each other.
Labels and equal vectors are told apart by 128-bit hashes.  Very long vectors are compared whole.
An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_groups, materialize
from .components import components

SAMPLE = 16_384
PROBES = 2048
BLOCK = 1024
#: Nodes a cell holds on average, and the fewest codewords of a half.
CELL_LOAD = 64
LEAST_CODEWORDS = 8
MAX_VISITS = 64
LEAST_VISITS = 4
#: Least visits if no probe has a neighbour.
SAFE_VISITS = 16
#: Sampled vectors of a length from which it has codebooks of its own.
LEAST_FIT = 64

Books = tuple[np.ndarray, np.ndarray]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component to [0.5, 1): exact, but for parts too small to matter."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of the rows of ``x``; starts from evenly spaced rows, so reruns agree."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def visits(x: np.ndarray, books: Books, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first (multi-sequence order; ties by cell).

    Cell (i, j) by rank in both sorted lists can only be among the first n if (i + 1) * (j + 1) <= n,
    so only that corner of the grid is traversed.
    """
    half = len(books[0][0])
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    corner = [(i, j) for i in range(min(n, d1.shape[1])) for j in range(min(n // (i + 1), d2.shape[1]))]
    i, j = np.array([c[0] for c in corner]), np.array([c[1] for c in corner])
    a, b = o1[:, i], o2[:, j]
    total = np.take_along_axis(d1, a, 1) + np.take_along_axis(d2, b, 1)
    best = np.argsort(total, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(a * len(books[1]) + b, best, 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


class Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def codewords_for(nodes: int, sampled: int) -> int:
    """Codewords of a half: a grid of ``nodes / CELL_LOAD`` cells, as far as the sample can tell codewords apart."""
    return min(max(LEAST_CODEWORDS, int(np.ceil(np.sqrt(nodes / CELL_LOAD)))), max(1, sampled // 4))


def fitted(nodes: DataFrame, threshold: float, recall: float, codewords: int | None) -> dict[int, tuple[Books, int]]:
    """Codebooks, and the number of visits that meets ``recall``, of each length of vectors that the sample knows well enough."""
    # At most SAMPLE rows, whatever the table's size.
    sample = nodes.select("node", "l1", "x", "k1").orderBy("k1", "node").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["x"]), []).append(r)
    known = {n: rows for n, rows in by_length.items() if n > 1 and len(rows) >= LEAST_FIT}
    counts = {r["n"]: r["m"] for r in nodes.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("m")).where(F.col("n").isin(list(known))).collect()} if known else {}
    out = {}
    for n, rows in known.items():  # SAMPLE / LEAST_FIT lengths at most; one as a rule
        x = unit(np.array([r["x"] for r in rows]))
        k = codewords or codewords_for(counts[n], len(rows))
        books = k_means(x[:, : n // 2], k), k_means(x[:, n // 2 :], k)
        probes = [(r["l1"], r["node"]) for r in rows[:PROBES]]
        out[n] = books, calibrate(nodes.where(F.size("x") == n), probes, x[:PROBES], books, threshold, recall)
    return out


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", codewords: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    x, size = vectors[embedding].cast("array<double>"), F.size(vectors[embedding])
    key = lambda seed, *c: F.xxhash64(F.lit(seed), *c)
    good = usable(F.col("x")) & F.col("labelled")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), x.alias("x"), vectors[label].isNotNull().alias("labelled"), key(1, vectors[label], size).alias("l1"), key(2, vectors[label], size).alias("l2"), key(1, x).alias("k1"), key(2, x).alias("k2"))
    slim = materialize(rows.select("vec_id", "l1", "l2", "k1", "k2", F.coalesce(good, F.lit(False)).alias("good")), "vectors")
    nodes = rows.where(good).groupBy("l1", "l2", "k1", "k2").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "l1", "l2", "k1", "k2", "copies", "least", "x"), "nodes")
    sent = vectors.sparkSession.sparkContext.broadcast(fitted(nodes, threshold, recall, codewords))  # bounded by SAMPLE

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            at = lists.offsets.to_numpy()
            flat, length = np.asarray(lists.values), np.diff(at)
            cells: list = [[0]] * b.num_rows
            packed: list = [b""] * b.num_rows
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                v = scaled(flat[at[own][:, None] + np.arange(n)])
                for r, p in zip(own.tolist(), v.astype("<f8"), strict=True):
                    packed[r] = p.tobytes()
                if n in sent.value:
                    books, needed = sent.value[n]
                    for r, c in zip(own.tolist(), visits(unit(v), books, needed).tolist(), strict=True):
                        cells[r] = c
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(packed, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["node", "l1", "l2", "copies", "x", "visits"])

    filed = nodes.select("node", "l1", "l2", "copies", "x").mapInArrow(file, "node long, l1 long, l2 long, copies long, x binary, visits array<int>")
    filed = materialize(filed, "filed")
    places = filed.select("node", "l1", "l2", F.posexplode("visits").alias("visit", "cell"))
    # Residents and guests of each cell are dealt into blocks; a block pair has at most about BLOCK and 2 * BLOCK of them.
    size = places.groupBy("l1", "l2", "cell").agg(F.sum(F.when(F.col("visit") == 0, 1).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("m")).where("n > 0 and m > 1")
    size = size.select("l1", "l2", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / (2 * BLOCK)).cast("int").alias("cols"))
    size = materialize(size, "cells")
    cell = filed.select("node", "l1", "l2", "copies", "x", "visits", F.posexplode("visits").alias("visit", "cell")).join(size, ["l1", "l2", "cell"])
    h = F.xxhash64("node")
    as_row = F.when(F.col("visit") == 0, F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct(F.pmod(h, F.col("rows")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("home"))))
    as_col = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.pmod(h, F.col("cols")).cast("int").alias("j"), F.lit(False).alias("home")))
    dealt = cell.select("node", "copies", "x", "l1", "l2", "cell", "visits", F.inline(F.concat(F.coalesce(as_row, F.array().cast("array<struct<i:int,j:int,home:boolean>>")), as_col)))

    def compare(b: pa.RecordBatch) -> dict | None:
        field = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        home = field("home").astype(bool)
        a, g = np.flatnonzero(home), np.flatnonzero(~home)
        if not a.size or not g.size:
            return None
        node, copies, here = field("node"), field("copies"), int(field("cell")[0])
        x = np.frombuffer(b"".join(field("x")), "<f8").reshape(b.num_rows, -1)
        lists = b.column(b.schema.get_field_index("visits"))
        path = np.asarray(lists.flatten()).reshape(b.num_rows, -1)
        norm = np.sqrt((x * x).sum(axis=1))
        cos = (x[a] @ x[g].T) / (norm[a][:, None] * norm[g][None, :])
        p, q = np.nonzero(cos >= threshold)
        p, q = a[p], g[q]
        # A pair counts once: within the cell by id; across cells in the lower one, or here if the resident doesn't visit the guest's.
        lives = path[q, 0]
        keep = np.where(lives == here, node[p] < node[q], here < lives)
        late = np.flatnonzero((lives != here) & ~keep)
        keep[late] = ~(path[p[late]] == lives[late][:, None]).any(axis=1)
        p, q = p[keep], q[keep]
        if not p.size:
            return None
        n: dict[int, int] = {}
        for own, other in ((p, q), (q, p)):
            ids, back = np.unique(node[own], return_inverse=True)
            for v, c in zip(ids.tolist(), np.bincount(back, copies[other]).astype(np.int64).tolist(), strict=True):
                n[v] = n.get(v, 0) + c
        forest = Forest()
        ties = [(u, v) for u, v in zip(node[p].tolist(), node[q].tolist(), strict=True) if forest.tie(u, v)]
        return {"a": [*n, *(t[0] for t in ties)], "b": [*n, *(t[1] for t in ties)], "n": [*n.values(), *([0] * len(ties))]}

    found = materialize(in_groups(dealt, ["l1", "l2", "cell", "i", "j"], ["node", "home"], compare, "a long, b long, n long"), "verified")
    links = found.where("n > 0").groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("links"))
    linked = materialize(components(found.where("n = 0").select("a", "b")), "components")
    classes = linked.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    named = linked.join(classes, "component").select(F.col("node").alias("c"), "smallest")
    facts = nodes.join(named, F.col("node") == F.col("c"), "left").join(links, F.col("node") == F.col("l"), "left")
    facts = facts.select("l1", "l2", "k1", "k2", F.lit(True).alias("good"), F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = slim.join(materialize(facts, "classes"), ["l1", "l2", "k1", "k2", "good"], "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def calibrate(nodes: DataFrame, probes: list[tuple], x: np.ndarray, books: Books, threshold: float, recall: float) -> int:
    """Visits at which the probes' true neighbours among all nodes are found to the wanted recall; pairs also meet from the other side, so real recall is higher."""
    cells = len(books[0]) * len(books[1])
    most = min(MAX_VISITS, cells)
    while not (needed := measured(nodes, probes, x, books, threshold, recall, most)) and most < cells:
        most = min(4 * most, cells)
    return needed or cells


def made_up(x: np.ndarray, threshold: float) -> np.ndarray:
    """A vector at cosine ``threshold`` to each row of ``x``, in a random direction; reruns agree."""
    aside = np.random.default_rng(20240607).normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return threshold * x + np.sqrt(1 - threshold * threshold) * aside


def measured(nodes: DataFrame, probes: list[tuple], x: np.ndarray, books: Books, threshold: float, recall: float, most: int) -> int:
    """Visits that reach ``recall`` within the nearest ``most`` cells; 0 if none do.  ``nodes``: columns ``node, l1, x``, one length."""
    sent = nodes.sparkSession.sparkContext.broadcast((probes, x, visits(x, books, most), books))
    dim = x.shape[1]
    cells = len(books[0]) * len(books[1])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, q, path, book = sent.value
        label, own = np.array([p[0] for p in named]), np.array([p[1] for p in named])
        of = {t: np.flatnonzero(label == t) for t in set(label.tolist())}
        seen = np.zeros((len(named), most + 1), np.int64)
        for b in batches:
            for part in (b.slice(k, 8192) for k in range(0, b.num_rows, 8192)):
                node, theirs = np.asarray(part.column(0)), np.asarray(part.column(1))
                v = np.asarray(part.column(2).flatten()).reshape(-1, dim)
                # Only probes of the same label are compared.
                for t in np.unique(theirs).tolist():
                    if t not in of:
                        continue
                    rows = np.flatnonzero(theirs == t)
                    u = unit(v[rows])
                    p, r = np.nonzero((q[of[t]] @ u.T >= threshold) & (own[of[t]][:, None] != node[rows][None, :]))
                    if p.size:
                        p, met, back = of[t][p], *np.unique(r, return_inverse=True)
                        match = path[p] == visits(u[met], book, 1)[back]
                        np.add.at(seen, (p, np.where(match.any(axis=1), match.argmax(axis=1), most)), 1)
        p, k = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"probe": pa.array(p, pa.int64()), "visit": pa.array(k, pa.int64()), "n": pa.array(seen[p, k], pa.int64())})

    # At most PROBES x (most + 1) rows.
    rows = nodes.select("node", "l1", "x").mapInArrow(rank, "probe long, visit long, n long").groupBy("probe", "visit").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((len(probes), most + 1))
    for r in rows:
        seen[r["probe"], r["visit"]] = r["n"]
    if not rows:
        match = visits(x, books, most) == visits(made_up(x, threshold), books, 1)
        seen[np.arange(len(x)), np.where(match.any(axis=1), match.argmax(axis=1), most)] = 1
    reached = np.cumsum(seen, axis=1)
    every, each = reached.sum(axis=0), reached[reached[:, -1] > 0]
    enough = np.minimum(every / every[-1], (each / each[:, -1:]).mean(axis=0))[:most] >= recall
    if not enough.any():
        return 0
    return int(min(max(np.argmax(enough) + 1, LEAST_VISITS if rows else SAFE_VISITS), cells))
