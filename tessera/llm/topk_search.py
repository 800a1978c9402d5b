"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut to blocks, longest first, and these to
buckets.  Of equal vectors, which score alike, only the k + 1 with the smallest
ids can be among a query's k best, so no more go on as candidates.  A block of queries goes through the buckets of a block in that order,
and each query keeps its k best.  In a bucket a query's k-th score over the
product of lengths is its local cosine threshold: above 1 no vector of this or
any later bucket can enter.  The thresholds choose how the bucket is pruned:

low   by length: a vector shorter than score over the query's length is out;
high  by coordinates: the products over a few coordinates plus the product of
      the rests' lengths bound the score.

What is left is verified in full.

A first pass over the longest block gives each query k scores that it is sure to
reach.  Then a query is sent to the blocks whose longest vector can reach its
k-th score, and to no others: rows stay where they are, unless there are more
than ``query_block`` queries, which are then dealt to several groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import batch, grouped, stage, unstage

_HITS = "asked long, query_id long, vec_id long, row long, score long"
_SENT = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("group", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("floor", pa.float64())])
_SENT_SQL = "dim int, block int, group int, row long, vec_id long, v binary, floor double"


def _verified(q: np.ndarray, x: np.ndarray, need: np.ndarray, focus: np.ndarray) -> np.ndarray:
    """Scores of all pairs (query, row); those that the coordinates rule out are -inf."""
    rest_q = np.sqrt(np.maximum(0.0, (q * q).sum(1) - (q[:, focus] ** 2).sum(1)))
    rest_x = np.sqrt(np.maximum(0.0, (x * x).sum(1) - (x[:, focus] ** 2).sum(1)))
    bound = q[:, focus] @ x[:, focus].T + rest_q[:, None] * rest_x
    a, b = np.nonzero(bound >= (need - 1e-6 * (1 + np.abs(need)))[:, None])
    if 4 * len(a) > bound.size:  # too many are left to be worth a product each
        return q @ x.T
    score = np.full(bound.shape, -np.inf)
    for lo in range(0, len(a), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        score[a[part], b[part]] = np.einsum("ij,ij->i", q[a[part]], x[b[part]])
    return score


def search(own, q, floor, rows, ids, x, k: int, bucket: int = 1024, focus: int = 16, high: float = 0.6):
    """(index of the query, index of the row, score) of each query's k best of the rows that reach its floor.

    ``own`` and ``rows`` number queries and rows; a row is no candidate for the
    query of its number.  ``floor`` holds a score that k rows are known to reach
    (or -inf); lower scores are left out, equal ones stay for the tie rule.
    """
    length = np.sqrt((x * x).sum(1))
    order = np.lexsort((rows, ids, -length))
    size = np.sqrt((q * q).sum(1))
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
    kth = floor.astype(np.float64).copy()
    chosen = np.argsort(-(q * q).sum(0), kind="stable")[: min(focus, q.shape[1])] if len(q) else None
    for lo in range(0, len(order), bucket):
        at = order[lo : lo + bucket]
        slack = np.where(np.isfinite(kth), 1e-9 * (1 + np.abs(kth)), 0.0)
        live = np.flatnonzero(kth - slack <= size * length[at[0]])
        if not len(live):
            break  # the cosines would have to pass 1, here and further on
        need, part = kth[live], x[at]
        reach = size[live] * length[at[0]]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, need / reach, 0.0)
        if np.median(cosine) >= high:
            score = _verified(q[live], part, need, chosen)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((need > 0) & (size[live] > 0), (need - slack[live]) / size[live], -1.0)
            tall = int(np.searchsorted(-length[at], -least.min(), side="right"))  # rows that some query can still use
            at, part = at[:tall], part[:tall]
            score = q[live] @ part.T
        good = (score >= need[:, None]) & (rows[at][None, :] != own[live][:, None])
        for i in np.flatnonzero(good.any(1)).tolist():
            n, hit = int(live[i]), np.flatnonzero(good[i])
            s, r = np.concatenate([best[n][0], score[i, hit]]), np.concatenate([best[n][1], at[hit]])
            if len(s) > 4 * k:
                few = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                s, r = s[few], r[few]
            pick = np.lexsort((rows[r], ids[r], -s))[:k]
            best[n] = s[pick], r[pick]
            if len(pick) == k:
                kth[n] = max(kth[n], best[n][0][-1])
    count = [len(b[0]) for b in best]
    hits = [np.concatenate([b[c] for b in best]) if best else np.zeros(0, t) for c, t in ((1, np.int64), (0, np.float64))]
    return np.repeat(np.arange(len(q)), count), hits[0].astype(np.int64), hits[1].astype(np.int64)


def _matrix(column) -> np.ndarray:
    blobs = b"".join(v.as_buffer().to_pybytes() for v in column)
    return np.frombuffer(blobs, np.float64).reshape(len(column), -1) if blobs else np.zeros((len(column), 1))


def _pair(key, table, k: int):
    floor = table["floor"].to_numpy()
    asked = ~np.isnan(floor)
    number, ids, x = table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"])
    a, b, score = search(number[asked], x[asked], floor[asked], number[~asked], ids[~asked], x[~asked], k)
    columns = (number[asked][a], ids[asked][a], ids[~asked][b], number[~asked][b], score)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["asked", "query_id", "vec_id", "row", "score"])


def _packed(batches):
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("length", pa.float64())])
    for b in batches:
        column = b.column(2)
        size = np.diff(column.offsets.to_numpy())
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        ends = np.cumsum(size)
        total = np.concatenate([[0.0], np.cumsum(flat * flat)])
        blobs = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())]
        yield batch(schema, [b.column(0), b.column(1), size.astype(np.int32), blobs, np.sqrt(total[ends] - total[ends - size])])


def _dealt(batches, blocks: dict[int, tuple[np.ndarray, np.ndarray]], first: bool):
    """Queries, once for each block that can hold one of their k best."""
    for b in batches:
        dim, length, floor = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "length", "floor"))
        rows, names = [], []
        for d in np.unique(dim).tolist():
            own = np.flatnonzero(dim == d)
            block, longest = blocks[d]
            if first:
                rows.append(own)
                names.append(np.full(len(own), block[0]))
                continue
            for name, top in zip(block[1:].tolist(), longest[1:].tolist()):
                can = own[floor[own] - 1e-9 * np.where(np.isfinite(floor[own]), 1 + np.abs(floor[own]), 0) <= length[own] * top]
                rows.append(can)
                names.append(np.full(len(can), name))
        if rows and sum(map(len, rows)):
            rows, names = np.concatenate(rows), np.concatenate(names)
            part = b.take(pa.array(rows))
            column = lambda c: part.column(part.schema.get_field_index(c))
            yield batch(_SENT, [column("dim"), names.astype(np.int32), column("group"), column("row"), column("vec_id"), column("v"), column("floor")])


def _blocks(ranges: list[tuple[int, int, float, int]], most: int):
    """[(dim, range, block)] and, by dimension, (blocks, their longest), longest first.

    Ranges of (dim, range, longest, rows) that follow each other are one block
    while they have no more rows than ``most`` together.
    """
    names, blocks, held = [], {}, 0
    for dim, name, longest, n in sorted(ranges, key=lambda r: (r[0], -r[2], r[1])):
        own = blocks.setdefault(dim, ([], []))
        if not own[0] or held + n > most:
            own[0].append(len(names))
            own[1].append(longest)
            held = 0
        held += n
        names.append((dim, name, own[0][-1]))
    return names, {d: tuple(map(np.array, b)) for d, b in blocks.items()}


def exact_top_k(vectors: DataFrame, queries, k: int = 20, block: int = 16384, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product.

    ``vectors`` has vec_id and v, an array of doubles with integer values;
    ``queries`` is a condition on vec_id that picks the queries among the rows.
    A row is no candidate for itself; other rows of its vec_id are.  Ties go to
    the smaller vec_id.  Of several rows that share a query's vec_id each is
    asked.  Products are defined between vectors of one dimension, so rows of
    another dimension are no candidates.  Rows with a null id or vector, or with
    null, NaN or infinite parts, take no part.  An empty table gives none.

    The driver holds a length for each block (n / ``block`` of them) alone.
    """
    spark = vectors.sparkSession
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    fine &= F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    packed = stage(rows.mapInArrow(_packed, "row long, vec_id long, dim int, v binary, length double"), "vectors")
    n, m = packed.count(), packed.where(queries).count()
    if not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-m // query_block)
    copy = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))
    ordered = packed.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    ordered = ordered.repartitionByRange(-(-n // block), "dim", F.desc("length"), "row").withColumn("range", F.spark_partition_id())
    ranges = stage(ordered, "ranges")
    found = ranges.groupBy("dim", "range").agg(F.max("length").alias("longest"), F.count("*").alias("n")).collect()
    names, blocks = _blocks([(r.dim, r.range, r.longest, r.n) for r in found], block)
    ordered = ranges.join(F.broadcast(spark.createDataFrame(names, "dim int, range int, block int")), ["dim", "range"])  # a row for each range
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))) if groups > 1 else F.lit(0)
    here = ordered.select("dim", "block", each.alias("group"), "row", "vec_id", "v", F.lit(float("nan")).alias("floor"))
    nothing = F.lit(float("-inf"))
    asked = packed.where(queries).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    leading = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(int(b[0])).alias("block")) for d, (b, _) in sorted(blocks.items())])
    longest = F.array_contains(leading, F.struct("dim", "block"))

    def against(part: DataFrame, queries_: DataFrame, first: bool) -> DataFrame:
        sent = queries_.mapInArrow(lambda it: _dealt(it, blocks, first), _SENT_SQL)
        return part.unionByName(sent).groupBy("dim", "block", "group").applyInArrow(grouped(_pair, k=k), _HITS)

    hits = stage(against(here.where(longest), asked.withColumn("floor", nothing), True), "hits")
    if len({(d, b) for d, _, b in names}) > len(blocks):
        floors = hits.groupBy(F.col("asked").alias("_asked")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("_floor"))
        floored = asked.join(floors, asked["row"] == floors["_asked"], "left").withColumn("floor", F.coalesce("_floor", nothing)).drop("_asked", "_floor")
        later = stage(against(here.where(~longest), floored, False), "hits")
        hits = hits.unionByName(later)
    unstage(packed, ranges)
    place = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
