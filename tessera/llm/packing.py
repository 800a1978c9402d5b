"""Best-fit packing of token pieces with swap-based local search.

Pieces of one length are alike, so the plan is made from the counts of the
lengths alone: at most ``capacity`` numbers, whatever the corpus.  A plan is a
list of patterns (the lengths in a sequence) with multiplicities.

1.  Best fit, longest first: all pieces of a length go at once to the patterns
    that they fill most, tightest first.
2.  Local search on the underfull patterns: a move, a swap of one for one or of
    two for one out of the emptiest is made if it raises the sum of squared
    fills, until sequences empty or nothing helps.  It is made on as many pairs
    of sequences at once as both patterns have.
3.  Each piece's rank among those of its length (its rank in its task plus the
    counts of earlier tasks) names its place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encode import default_path, encoder
from .shared import batch, ids_of, keyed, stage, unkeyed

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("rank", pa.int64())]
)
_PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _pieces(batches, path: str, capacity: int):
    enc, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
    end = (0).to_bytes(4, "little")
    for b in batches:
        cols = [[] for _ in _PIECES]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = enc.ids(text) + end
            n = len(ids) // 4
            lo, piece = 0, 0
            while lo < n:
                size = n - lo - (n - lo - 1) // capacity * capacity if piece == 0 else capacity
                for c, x in zip(cols, (doc, piece, lo, size, zlib.crc32(ids[4 * lo : 4 * (lo + size)]), task, seen[size])):
                    c.append(x)
                seen[size] += 1
                lo, piece = lo + size, piece + 1
        yield batch(_PIECES, cols)


def best_fit(counts: dict[int, int], capacity: int) -> list[list]:
    """[[times, pattern], ...]: a pattern is a Counter of lengths."""
    by_room: dict[int, list] = defaultdict(list)
    rooms: list[int] = []

    def put(times: int, pattern: Counter, room: int) -> None:
        if times:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append([times, pattern])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(n, capacity // length)
                put(n // each, Counter({length: each}), capacity - each * length)
                n %= each
                continue
            room = rooms[at]
            times, pattern = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = min(n, room // length)
            took = min(times, n // each)
            put(times - took, pattern, room)
            put(took, pattern + Counter({length: each}), room - each * length)
            n -= took * each
    return [x for room in by_room.values() for x in room]


@lru_cache(1 << 16)
def _of(pattern: tuple) -> tuple[int, np.ndarray]:
    """A pattern's fill, and nothing and each length that it can give back."""
    return sum(n * m for n, m in pattern), np.array([0, *(n for n, _ in pattern)])


def _exchange(from_: tuple, targets: list[tuple], times: list[int], capacity: int):
    """The move or swap out of ``from_`` that fills another pattern most, then the largest: (target, out, back), or None.

    A pattern is a rising tuple of (length, how often).  For each length that a
    target can give back (or none), the largest give that still fits is found
    among the lengths of ``from_`` and, if something comes back, their pairs.  A
    pattern has 63 different lengths at most (1 + ... + 63 is near 2048), so
    there are no more pairs than 2016.
    """
    lengths = [n for n, _ in from_]
    singles = np.array(lengths)
    pairs = sorted({a + b: (a, b) for i, (a, n) in enumerate(from_) for b in lengths[i:] if a != b or n > 1}.items())
    sums = np.array([p[0] for p in pairs], np.int64)
    fill, parts = np.array([_of(t)[0] for t in targets]), [_of(t)[1] for t in targets]
    back = np.concatenate(parts)
    target = np.repeat(np.arange(len(targets)), [len(x) for x in parts])
    most = back + capacity - fill[target]
    here = targets.index(from_)
    allowed = (target != here) | (times[here] > 1)
    own, best = int(fill[here]), None
    for gives, usable in ((singles, allowed), (sums, allowed & (back > 0))):
        at = np.searchsorted(gives, most, side="right") - 1
        gain = np.where(at >= 0, gives[np.maximum(at, 0)] - back, 0) if len(gives) else np.zeros(len(back), np.int64)
        good = np.flatnonzero(usable & (gain > 0) & (fill[target] - own + gain > 0))  # only these raise the squared fill
        if len(good):
            first = good[np.lexsort((good, -gain[good], -(fill[target] + gain)[good]))[0]]
            rank = (int(fill[target[first]] + gain[first]), int(gain[first]))
            if best is None or rank > best[0]:
                give = int(gives[at[first]])
                best = rank, int(target[first]), (give,) if gives is singles else pairs[int(at[first])][1], int(back[first])
    return best and best[1:]


def local_search(plan: list[list], capacity: int) -> list[list]:
    """Moves and swaps between underfull sequences that raise the squared fill.

    Ends when as few sequences are left as the total needs, or when no move, no
    swap of one for one or of two for one out of any sequence raises it.  It
    rises with each exchange and is bounded, so that comes.
    """
    full, loose, tried = [], Counter(), Counter()  # patterns by how often they are there
    total = 0
    for times, pattern in plan:
        fill = sum(k * v for k, v in pattern.items())
        total += times * fill
        if fill == capacity:
            full.append([times, pattern])
        else:
            loose[tuple(sorted(pattern.items()))] += times
    spare = sum(x[0] for x in full) + sum(loose.values()) - -(-total // capacity)
    changed = False
    while spare > 0:
        if not loose:
            if not changed:
                break
            loose, tried, changed = tried, Counter(), False  # what found nothing before may find something now
        from_ = min(loose, key=lambda p: (_of(p)[0], p))
        both = loose + tried
        targets = list(both)
        found = _exchange(from_, targets, [both[t] for t in targets], capacity)
        if found is None:
            tried[from_] += loose.pop(from_)
            continue
        changed = True
        to, out, back = targets[found[0]], Counter(found[1]), Counter([found[2]] if found[2] else [])
        times = both[from_] // 2 if to == from_ else min(both[from_], both[to])
        for pattern, less, more in ((from_, out, back), (to, back, out)):
            for held in (loose, tried):
                took = min(times, held[pattern]) if held is loose else times - took
                held[pattern] -= took
                if held[pattern] <= 0:
                    del held[pattern]
            new = Counter(dict(pattern)) - less + more
            fill = sum(k * v for k, v in new.items())
            if fill == capacity:
                full.append([times, new])
            elif fill:
                loose[tuple(sorted(new.items()))] += times
            else:
                spare -= times
    return full + [[n, Counter(dict(p))] for p, n in (loose + tried).items()]


def places(plan: list[list]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, each, first offset), by rank."""
    out, taken, sequence = defaultdict(list), Counter(), 0
    for times, pattern in plan:
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            out[length].append((taken[length], sequence, each, offset))
            taken[length] += times * each
            offset += length * each
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(batches, plan: dict[int, np.ndarray]):
    for b in batches:
        length, rank = ids_of(b.column(3)), ids_of(b.column(5))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            rows = plan[int(size)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            past = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + past // row[:, 2]
            offset[at] = row[:, 3] + past % row[:, 2] * size
        yield batch(_PLACED, [*[b.column(i) for i in range(5)], sequence, offset])


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row for each piece of each document, packed into few sequences.

    A document's tokens are the ids of its whole text (null: empty) and then
    id 0.  More than ``capacity`` are cut into pieces of that many, the first
    holding the rest.  Columns: doc_id, piece (from 0), start (ids of the
    document before it), length, ids_crc32 (of little-endian unsigned 32-bit
    ids), sequence_id and offset.  Sequences have no gaps and no more than
    ``capacity`` tokens.  Each row is packed, equal rows too; a null doc_id
    stays null; other columns are not read; an empty table gives no sequences.
    """
    path = path or default_path()
    pieces = keyed(docs, "text").mapInArrow(
        lambda it: _pieces(it, path, capacity), "doc_id long, piece long, start long, length long, ids_crc32 long, task long, rank long"
    )
    pieces = stage(pieces, "pieces")
    counts = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    plan = places(local_search(best_fit(lengths, capacity), capacity))
    ranked = pieces.join(counts.hint("shuffle_merge"), ["task", "length"])  # it grows with the tasks, so it is never broadcast
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(lambda it: _place(it, plan), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(unkeyed(), *out.columns[1:])
