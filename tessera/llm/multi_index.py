"""Approximate nearest neighbours by an inverted multi-index.

1.  Vectors are cut in halves and each half is quantised on its own, by centroids
    fitted on a bounded sample.  Every row is indexed under its cell, the pair of
    its halves' centroids.
2.  A query goes through the pairs by rising sum of the two squared distances: a
    heap holds, for each first centroid, the next second one.  It stops once the
    cells hold ``visits`` vectors, of which at least ``k``.
3.  The vectors of the cells it went through are reranked by exact inner products.

How many vectors a query has to visit is measured when the index is built: for a
bounded sample of queries, the exact neighbours among all rows and how far the
heap has to go for them.  ``visits`` is what finds the share ``recall`` of them.

Cells are dealt to blocks of at most ``block`` rows, a larger cell to several, and
the queries of a block to groups, so neither a cell with a third of all rows nor
one that all queries ask for is one task's.  Of equal vectors, which score alike,
only the k + 1 of smallest ids can be in a result and are listed in their cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import batch, grouped, stage, unstage
from .topk_search import _matrix, _packed

_HITS = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
_HITS_SQL = "asked long, query_id long, vec_id long, row long, score double"
_CELL = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("cell", pa.int32())])
_SENT = pa.schema([("block", pa.int32()), ("group", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("cells", pa.binary())])
_SENT_SQL = "block int, group int, row long, vec_id long, v binary, cell int, cells binary"


def centroids(x: np.ndarray, n: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """``n`` centroids (fewer where there are fewer different rows) by Lloyd's rounds from rows drawn at random."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 8192):
        out[lo : lo + 8192] = ((c * c).sum(1) - 2 * x[lo : lo + 8192] @ c.T).argmin(1)
    return out


class Codebook:
    """The centroids of both halves of vectors of one dimension."""

    def __init__(self, sample: np.ndarray, n: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = centroids(sample[:, : self.half], n), centroids(sample[:, self.half :], n)
        self.cells = len(self.first) * len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def visited(self, q: np.ndarray, count: np.ndarray, most: float) -> list[int]:
        """Cells with rows by rising summed distance, until they hold ``most`` rows."""
        one, two = ((q[: self.half] - self.first) ** 2).sum(1), ((q[self.half :] - self.second) ** 2).sum(1)
        order = np.argsort(two, kind="stable").tolist()
        two, n, size = two[order].tolist(), len(order), count.tolist()
        heap = [(d + two[0], i, 0, d) for i, d in enumerate(one.tolist())]
        heapq.heapify(heap)
        found, held = [], 0
        while heap and held < most:
            _, i, j, d = heap[0]
            here = i * n + order[j]
            if size[here]:
                found.append(here)
                held += size[here]
            if j + 1 < n:
                heapq.heapreplace(heap, (d + two[j + 1], i, j + 1, d))
            else:
                heapq.heappop(heap)
        return found


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first part to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest and of all that rounding could make as large."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = np.partition(score, len(score) - k)[len(score) - k]
    return np.flatnonzero(score >= kth - 1e-9 * (1 + abs(kth)))


def _celled(batches, books: dict[int, Codebook], base: dict[int, int]):
    for b in batches:
        dim, out = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int32)
        for d in np.unique(dim).tolist():
            at = np.flatnonzero(dim == d)
            out[at] = base[d] + (books[d].cell(_matrix(b.column(3).take(pa.array(at)))) if d in books else 0)
        yield batch(_CELL, [*b.columns[:4], out])


def _tried(batches, dim: int, sample: np.ndarray, rows: np.ndarray, k: int):
    """The k best rows of each batch for each sampled query: (asked, its cell, score)."""
    schema = pa.schema([("asked", pa.int64()), ("cell", pa.int32()), ("score", pa.float64())])
    for b in batches:
        at = np.flatnonzero(b.column(2).to_numpy() == dim)
        if not len(at):
            continue
        x, row, cell = _matrix(b.column(3).take(pa.array(at))), b.column(0).to_numpy()[at], b.column(4).to_numpy()[at]
        score = np.where(rows[:, None] == row[None, :], -np.inf, sample @ x.T)
        pick = np.argpartition(-score, min(k, len(at)) - 1, axis=1)[:, :k]
        asked = np.repeat(np.arange(len(sample)), pick.shape[1])
        yield batch(schema, [asked, cell[pick].ravel(), np.take_along_axis(score, pick, 1).ravel()])


def _asked(batches, books, base, counts, visits, block_of: np.ndarray, parts: np.ndarray, groups: int):
    """Each query once for each block that holds cells it goes through, with these cells."""
    for b in batches:
        made: list[tuple] = []
        dims, cells = b.column(2).to_numpy(), b.column(4).to_numpy()
        for i, (d, v) in enumerate(zip(dims.tolist(), b.column(3))):
            if d in books:
                own = np.array(books[d].visited(np.frombuffer(v.as_buffer(), np.float64), counts[d], visits[d]), np.int64) + base[d]
            else:
                own = cells[i : i + 1].astype(np.int64)
            to = np.repeat(block_of[own], parts[own])
            to = to + (np.arange(len(to)) - np.repeat(np.cumsum(parts[own]) - parts[own], parts[own]))
            own = np.repeat(own, parts[own])
            by = np.argsort(to, kind="stable")
            to, own = to[by], own[by]
            lead = np.flatnonzero(np.append([True], to[1:] != to[:-1])) if len(to) else []
            for a, z in zip(lead, np.append(lead[1:], len(to))):
                made.append((int(to[a]), i, np.sort(own[a:z]).astype(np.int32).tobytes()))
            if len(made) >= 4096 or i == len(dims) - 1:
                rows = [m[1] for m in made]
                part = b.take(pa.array(rows, pa.int64()))
                group = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)
                yield batch(_SENT, [[m[0] for m in made], group.astype(np.int32), part.column(0), part.column(1), part.column(3), np.zeros(len(rows), np.int32), [m[2] for m in made]])
                made = []


def rerank(rows, ids, x, cell, own, q, cells: list[np.ndarray], k: int):
    """(query, row, score) of each query's k best rows in the cells that it names.

    ``rows`` and ``own`` number rows and queries; a query does not find itself.
    """
    by = np.argsort(cell, kind="stable")
    rows, ids, x, cell = rows[by], ids[by], x[by], cell[by]
    names, begin = np.unique(cell, return_index=True)
    ends = np.append(begin[1:], len(cell))
    asking = np.repeat(np.arange(len(q)), [len(c) for c in cells])
    named = np.concatenate(cells) if cells else np.zeros(0, np.int32)
    order = np.argsort(named, kind="stable")
    asking, named = asking[order], named[order]
    lo, hi = np.searchsorted(named, names), np.searchsorted(named, names, side="right")
    score = np.full((len(q), len(rows)), -np.inf)
    for a, z, s, e in zip(lo.tolist(), hi.tolist(), begin.tolist(), ends.tolist()):
        if z > a:
            score[asking[a:z], s:e] = q[asking[a:z]] @ x[s:e].T
    out: list[tuple] = []
    for i in range(len(q)):
        at = np.flatnonzero((score[i] > -np.inf) & (rows != own[i]))
        at = at[_best(score[i, at], k)]
        s = _products(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
        pick = np.lexsort((rows[at], ids[at], -s))[:k]
        out.append((np.full(len(pick), i), at[pick], s[pick]))
    i, at, s = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ())))
    return i.astype(np.int64), rows[at.astype(np.int64)], ids[at.astype(np.int64)], s


def _reranked(key, table, k: int):
    asks = np.array([c.is_valid for c in table["cells"]], bool)
    number, ids, x = table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"])
    wanted = [np.frombuffer(c.as_buffer(), np.int32) for c in table["cells"] if c.is_valid]
    number, ids, x, own, own_id, q = number[~asks], ids[~asks], x[~asks], number[asks], ids[asks], x[asks]
    cell, out = table["cell"].to_numpy()[~asks], []
    for lo in range(0, len(q), 512):  # as many scores are held at once
        part = slice(lo, lo + 512)
        i, row, vec, score = rerank(number, ids, x, cell, own[part], q[part], wanted[part], k)
        out.append(batch(_HITS, [own[part][i], own_id[part][i], vec, row, score.astype(np.float64)]))
    return pa.Table.from_batches(out, schema=_HITS)


class MultiIndex:
    """Every row of a table of vectors under its cell.

    ``table`` is the staged index (row, vec_id, dim, v, cell, copy); ``visits``
    how many vectors of a dimension a query goes through.  The driver holds the
    centroids, a count for each cell (at most ``most`` squared for a dimension)
    and a sample of ``sample`` rows and ``tried`` queries for each dimension.
    Vectors of a dimension that the sample lacks are in one cell.
    """

    def __init__(self, vectors: DataFrame, k: int = 20, recall: float = 0.96, sample: int = 16384, tried: int = 256, most: int = 256, a_cell: int = 16):
        fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda e: e != 0)
        fine &= F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        rows = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v")
        packed = stage(rows.mapInArrow(_packed, "row long, vec_id long, dim int, v binary, length double").drop("length"), "vectors")
        self.k, self.spark = k, vectors.sparkSession
        size = {r.dim: r.n for r in packed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        drawn: dict[int, list] = {}
        for r in packed.orderBy(F.xxhash64("v"), "row").limit(sample).select("dim", "row", "v").collect():
            drawn.setdefault(r.dim, []).append((r.row, np.frombuffer(r.v, np.float64)))
        self.books, self.base, cells = {}, {}, 0
        for d in sorted(size):
            self.base[d] = cells
            if d in drawn:
                n = 1 << max(0, round(0.5 * np.log2(max(1, size[d] / a_cell))))
                self.books[d] = Codebook(np.stack([v for _, v in drawn[d]]), min(n, most))
            cells += self.books[d].cells if d in self.books else 1
        books, base = self.books, self.base
        celled = packed.mapInArrow(lambda it: _celled(it, books, base), "row long, vec_id long, dim int, v binary, cell int")
        copy = F.row_number().over(W.partitionBy("dim", "v").orderBy("vec_id", "row"))
        listed = celled.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
        self.table = stage(listed, "cells")
        self.all = stage(celled, "indexed")
        unstage(packed)
        self.count = np.zeros(cells, np.int64)
        for r in self.table.groupBy("cell").agg(F.count("*").alias("n")).collect():
            self.count[r.cell] = r.n
        self.counts = {d: self.count[base[d] : base[d] + b.cells] for d, b in books.items()}
        self.visits = {d: self._measured(d, drawn[d][:tried], recall) for d in books}

    def _measured(self, dim: int, drawn: list, recall: float) -> int:
        """How many vectors queries have to go through to find the share ``recall`` of their neighbours."""
        rows, sample, k = np.array([r for r, _ in drawn]), np.stack([v for _, v in drawn]), self.k
        tried = self.table.mapInArrow(lambda it: _tried(it, dim, sample, rows, k), "asked long, cell int, score double").where(F.col("score") > float("-inf"))
        place = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "cell"))
        true: dict[int, list[int]] = {}
        for r in tried.withColumn("rank", place).where(F.col("rank") <= k).collect():
            true.setdefault(r.asked, []).append(r.cell - self.base[dim])
        need: list[np.ndarray] = []
        for i, cells in true.items():
            path = self.books[dim].visited(sample[i], self.counts[dim], float("inf"))
            upto = np.zeros(len(self.counts[dim]), np.int64)
            upto[path] = np.cumsum(self.counts[dim][path])
            need.append(upto[cells])
        need = np.sort(np.concatenate(need)) if need else np.zeros(1, np.int64)
        return max(k + 1, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]))

    def search(self, queries, block: int = 8192, query_block: int = 8192) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest found for each row that meets the condition ``queries``."""
        count = self.count
        parts = np.maximum(1, -(-count // block))
        block_of, at, held, firsts = np.zeros(len(count), np.int64), -1, block, set(self.base.values())
        for c in range(len(count)):
            if c in firsts:
                held = block  # vectors of one dimension alone are in a block
            if not count[c]:
                continue
            if parts[c] > 1 or held + count[c] > block:
                at, held = at + 1, 0
            block_of[c] = at
            held += count[c]
            if parts[c] > 1:
                at, held = at + int(parts[c]) - 1, block
        asked = self.all.where(queries)
        n = asked.count()
        if not n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        groups, k = -(-n // query_block), self.k
        books, base, counts, visits = self.books, self.base, self.counts, self.visits
        here = self.table.mapInArrow(lambda it: _blocked(it, block_of, parts), "row long, vec_id long, v binary, cell int, block int")
        each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))) if groups > 1 else F.lit(0)
        here = here.select("block", each.alias("group"), "row", "vec_id", "v", "cell", F.lit(None).cast("binary").alias("cells"))
        sent = asked.mapInArrow(lambda it: _asked(it, books, base, counts, visits, block_of, parts, groups), _SENT_SQL)
        hits = here.unionByName(sent).groupBy("block", "group").applyInArrow(grouped(_reranked, k=k), _HITS_SQL)
        place = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))
        return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocked(batches, block_of: np.ndarray, parts: np.ndarray):
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("block", pa.int32())])
    for b in batches:
        row, cell = b.column(0).to_numpy(), b.column(4).to_numpy()
        part = (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % parts[cell].astype(np.uint64)
        yield batch(schema, [b.column(0), b.column(1), b.column(3), b.column(4), (block_of[cell] + part.astype(np.int64)).astype(np.int32)])


def near_vectors(vectors: DataFrame, queries, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by inner product.

    ``vectors`` has vec_id and v, an array of doubles; ``queries`` is a condition
    on vec_id that picks the queries among the rows.  Nearest first, ties to the
    smaller vec_id.  A row is no candidate for itself; other rows of its vec_id
    are, and each of several rows that share a query's vec_id is asked.  Products
    are defined within one dimension.  Rows with a null id or vector, with null,
    NaN or infinite parts, or of zeros alone take no part.  An empty table gives
    none.
    """
    return MultiIndex(vectors, k).search(queries)
