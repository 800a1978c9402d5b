"""Exact removal of repeated byte strings with a run-length compressed index.

Any two equal strings of ``length`` bytes have equal fingerprints at equal
places: the smallest hashes of their ``GRAM``-byte grams.  So

1.  one pass keeps the grams that are smallest within some window that a string
    of ``length`` bytes spans, with a hash of the context that such strings can
    reach, and deals them by hash.  Equal contexts within a batch are repeated
    as a whole; one place of them is dealt, so copies do not pile up;
2.  a gram that occurs once ends there.  Equal contexts at two places are
    repeated as a whole.  Where contexts of one gram differ, their bytes are
    fetched, one place for each context;
3.  the contexts of a gram (joined where they overlap in a text, so that each
    place is there once) are indexed: suffixes are sorted, the Burrows-Wheeler
    transform is cut into runs, and of each run its symbol, its length and the
    suffixes at its ends are kept, with the length that each shares with its
    neighbour across the end (:class:`RunIndex`).  Inside a run that length is one
    less than at the place before, so what is kept gives the matching statistics
    of all places, which are streamed through it.  Starts of ``length`` or more
    are marked.  Equal contexts, which would only lengthen runs, are one.

Contexts of different grams use different alphabets within one index.  A gram
with more than ``block`` bytes of contexts, or more than ``hot`` in one batch,
such as one that a third of all documents hold, has no index: the strings of
``length`` bytes in its contexts are dealt by hash themselves (equal ones of a
batch as one), so its places are spread over all tasks and their number grows
with the places alone.  What a batch knows to be hot is not dealt by gram.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, buckets, grouped, ids_of, joined, keyed, split_rows, stage, unkeyed, unstage

GRAM = 64
_CELL = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("key", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("many", "u1")])
_FOUND_SQL = "bucket int, marks binary, wants binary, heavy binary"
_STRING = np.dtype([("h", "<u8"), ("key", "<i8"), ("pos", "<i4"), ("many", "u1")])
_MARK = np.dtype([("key", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_WANT = np.dtype([("key", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("h", "<u8")])
_DEALT = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), ("marks", pa.binary()), ("heavy", pa.binary())])
_DEALT_SQL = "bucket int, cells binary, marks binary, heavy binary"
#: Contexts of one gram in a batch, beyond which it is hot.
HOT = 64
#: Bits of a cell: it stands for several places; its gram is hot.
SEVERAL, HEAVY = 1, 2
_FOUND = pa.schema([("bucket", pa.int32()), ("marks", pa.binary()), ("wants", pa.binary()), ("heavy", pa.binary())])
_BYKEY = pa.schema([("key", pa.int64()), ("rows", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("wants", pa.binary()), ("bytes", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _slide(x: np.ndarray, w: int, take) -> np.ndarray:
    """``take`` over each window of w entries, by doubling."""
    size = 1
    while size * 2 <= w:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def fingerprints(raw: np.ndarray, starts: np.ndarray, length: int):
    """(row, place, bytes of context before, after, hash, hash of the context)."""
    w = length - GRAM + 1
    n = len(raw)
    if n < length:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * K._power(K._BASE, "up", n + 1)[:-1], out=total[1:])
    down = K._power(K._INVERSE, "down", n + 1)
    h = K.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = _slide(h, w, np.minimum)  # of the strings that start at 0 .. n - length
    end = np.repeat(starts[1:], np.diff(starts))
    least[np.arange(len(least)) + length > end[: len(least)]] = 0  # it would cross into the next row
    pad = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)
    p = np.flatnonzero((most == h) & (h > 0))
    row = np.searchsorted(starts, p, side="right") - 1
    lo, hi = np.maximum(starts[row], p - (w - 1)), np.minimum(starts[row + 1], p + length)
    ctx = K.spans_hash(raw, lo, hi) + (p - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return row, p - starts[row], p - lo, hi - p, h[p], K.mix(ctx)


def _deal(batches, nb: int, length: int, most: int):
    for b in batches:
        keys, made = ids_of(b.column(0)), []
        for first, raw, starts in K.slices(b.column(1), 1 << 21):
            row, pos, left, right, h, ctx = fingerprints(raw, starts, length)
            cells = np.zeros(len(row), _CELL)
            cells["h"], cells["ctx"], cells["key"], cells["pos"], cells["left"], cells["right"] = h, ctx, keys[first + row], pos, left, right
            made.append(cells)
        if not made:
            continue
        cells = np.concatenate(made)
        cells = cells[np.lexsort((cells["ctx"], cells["h"]))]
        heads = _runs(cells["h"], cells["ctx"])
        size = np.diff(np.append(heads, len(cells)))
        marks = _merge(_spans(cells[np.repeat(size > 1, size)]))
        cells = cells[heads]
        cells["many"] = SEVERAL * (size > 1)
        grams = _runs(cells["h"])
        each = np.diff(np.append(grams, len(cells)))
        hot = np.repeat(each > most, each)
        heavy = _merge(_spans(cells[hot]))
        cells["many"][hot] |= HEAVY
        hot[grams] = False  # one cell tells the others of its gram
        cells = cells[~hot]
        for key, (part,) in split_rows(((cells["h"] >> np.uint64(32)) % np.uint64(nb)).astype(np.int64), nb, cells):
            yield batch(_DEALT, [[key], [part], [None], [None]])
        for key, (part,) in split_rows(marks["key"] % nb, nb, marks):
            yield batch(_DEALT, [[key], [None], [part], [None]])
        for key, (part,) in split_rows(heavy["key"] % nb, nb, heavy):
            yield batch(_DEALT, [[key], [None], [None], [part]])


def _spans(cells: np.ndarray) -> np.ndarray:
    """The contexts of cells as marks."""
    marks = np.zeros(len(cells), _MARK)
    marks["key"], marks["lo"], marks["hi"] = cells["key"], cells["pos"] - cells["left"], cells["pos"] + cells["right"]
    return marks


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows, of sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _match(key, table, nb: int, block: int):
    cells = joined(table["cells"], _CELL)
    h = cells["h"]
    order = np.argsort(h)
    ordered = h[order]
    twin = cells["many"][order] > 0
    same = ordered[1:] == ordered[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    cells = cells[order[twin]]
    cells = cells[np.lexsort((cells["ctx"], cells["h"]))]
    out = [batch(_FOUND, [[key[0].as_py()], [x], [None], [None]]) for x in table["marks"].drop_null()]
    out += [batch(_FOUND, [[key[0].as_py()], [None], [None], [x]]) for x in table["heavy"].drop_null()]
    if len(cells):
        heads = _runs(cells["h"], cells["ctx"])
        size = np.diff(np.append(heads, len(cells)))
        bits = np.bitwise_or.reduceat(cells["many"], heads)
        often = (size > 1) | (bits & SEVERAL > 0)
        marks = _merge(_spans(cells[np.repeat(often, size)]))
        group = np.cumsum(np.isin(heads, _runs(cells["h"]))) - 1
        kinds, singles = np.bincount(group), np.bincount(group, ~often)
        hot = np.bincount(group, bits & HEAVY) > 0
        open_ = ((kinds > 1) & (singles > 0) | hot)[group]  # contexts whose places are not all known yet
        wants, heavy = _asked(cells[heads[open_]], hot[group[open_]], block)
        for to, (part,) in split_rows(marks["key"] % nb, nb, marks):
            out.append(batch(_FOUND, [[to], [part], [None], [None]]))
        for to, (part,) in split_rows(wants["key"] % nb, nb, wants):
            out.append(batch(_FOUND, [[to], [None], [part], [None]]))
        for to, (part,) in split_rows(heavy["key"] % nb, nb, heavy):
            out.append(batch(_FOUND, [[to], [None], [None], [part]]))
    return pa.Table.from_batches(out, schema=_FOUND)


def _asked(cells: np.ndarray, hot: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts to be indexed, and the spans of those of grams that are hot or have more than ``block`` bytes of them."""
    held = hot.copy()
    if len(cells):
        heads = _runs(cells["h"])
        size = np.add.reduceat(cells["left"].astype(np.int64) + cells["right"], heads)
        held |= np.repeat(size > block, np.diff(np.append(heads, len(cells))))
    wants = np.zeros(int((~held).sum()), _WANT)
    few = cells[~held]
    wants["key"], wants["lo"], wants["hi"], wants["h"] = few["key"], few["pos"] - few["left"], few["pos"] + few["right"], few["h"]
    return wants, _merge(_spans(cells[held]))


def _strings(batches, nb: int, length: int):
    """The strings of ``length`` bytes within spans of texts; equal ones of a batch are marked, and one of them dealt."""
    for b in batches:
        made = []
        for key, text, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            for lo, hi in np.frombuffer(blob.as_buffer(), _MARK)[["lo", "hi"]].tolist():
                h = K.every_hash(raw[lo:hi], length)
                cells = np.zeros(len(h), _STRING)
                cells["h"], cells["key"], cells["pos"] = h, key, np.arange(lo, lo + len(h))
                made.append(cells)
        if not made:
            continue
        cells = np.concatenate(made)
        cells = cells[np.argsort(cells["h"], kind="stable")]
        heads = _runs(cells["h"])
        size = np.diff(np.append(heads, len(cells)))
        marks = _string_marks(cells[np.repeat(size > 1, size)], length)
        cells = cells[heads]
        cells["many"] = size > 1
        for to, (part,) in split_rows(((cells["h"] >> np.uint64(32)) % np.uint64(nb)).astype(np.int64), nb, cells):
            yield batch(_DEALT, [[to], [part], [None], [None]])
        for to, (part,) in split_rows(marks["key"] % nb, nb, marks):
            yield batch(_DEALT, [[to], [None], [part], [None]])


def _string_marks(cells: np.ndarray, length: int) -> np.ndarray:
    marks = np.zeros(len(cells), _MARK)
    marks["key"], marks["lo"], marks["hi"] = cells["key"], cells["pos"], cells["pos"] + length
    return _merge(marks)


def _same(key, table, nb: int, length: int):
    """Marks of the strings that are dealt twice or stand for several."""
    cells = joined(table["cells"], _STRING)
    out = [batch(_FOUND, [[key[0].as_py()], [x], [None], [None]]) for x in table["marks"].drop_null()]
    if len(cells):
        cells = cells[np.argsort(cells["h"], kind="stable")]
        heads = _runs(cells["h"])
        size = np.diff(np.append(heads, len(cells)))
        often = (size > 1) | (np.maximum.reduceat(cells["many"], heads) > 0)
        marks = _string_marks(cells[np.repeat(often, size)], length)
        for to, (part,) in split_rows(marks["key"] % nb, nb, marks):
            out.append(batch(_FOUND, [[to], [part], [None], [None]]))
    return pa.Table.from_batches(out, schema=_FOUND)


def _merge(marks: np.ndarray) -> np.ndarray:
    """Joins the spans of a key that overlap or touch."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks["lo"], marks["key"]))]
    own = _runs(marks["key"])
    base = np.repeat(np.arange(len(own), dtype=np.int64) << 33, np.diff(np.append(own, len(marks))))
    reach = np.maximum.accumulate(base + marks["hi"])
    new = np.ones(len(marks), bool)
    new[1:] = base[1:] + marks["lo"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = marks[at].copy()
    out["hi"] = (reach - base)[np.append(at[1:], len(marks)) - 1]
    return out


def _by_key(key, table, column: str, dtype):
    rows = joined(table[column], dtype)
    rows = _merge(rows) if dtype == _MARK else rows[np.argsort(rows["key"], kind="stable")]
    heads = _runs(rows["key"])
    ends = np.append(heads[1:], len(rows))
    return pa.Table.from_batches([batch(_BYKEY, [rows["key"][heads], [rows[a:b].tobytes() for a, b in zip(heads, ends)]])])


def _send(batches, nb: int):
    for b in batches:
        rows, texts = [], []
        for text, blob in zip(b.column(0), b.column(1)):
            raw, want = (text.as_py() or "").encode(), np.frombuffer(blob.as_buffer(), _WANT)
            rows.append(want)
            texts += [raw[a:e] for a, e in zip(want["lo"].tolist(), want["hi"].tolist())]
        if not rows:
            continue
        rows = np.concatenate(rows)
        bucket = ((rows["h"] >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends, lo = np.cumsum(np.bincount(bucket, minlength=nb)), 0
        for key in range(nb):
            hi = int(ends[key])
            if hi > lo:
                yield batch(_SENT, [[key], [rows[order[lo:hi]].tobytes()], [b"".join([texts[i] for i in order[lo:hi]])]])
            lo = hi


@dataclass(frozen=True)
class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with sampled run ends."""

    heads: np.ndarray  # the symbol of each run
    lengths: np.ndarray
    first: np.ndarray  # suffixes that begin a run, rising, and what each shares with the one before the run
    first_shared: np.ndarray
    last: np.ndarray  # suffixes that end a run, and what each shares with the one after
    last_shared: np.ndarray

    @staticmethod
    def build(symbols: np.ndarray, most: int) -> RunIndex:
        """Of ``symbols``, numbers below 2**21; those that must match nothing occur once, one within every ``most`` places."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(2, symbols.dtype)]).astype(np.uint64)
        key = padded[:n] << np.uint64(42) | padded[1 : n + 1] << np.uint64(21) | padded[2 : n + 2]
        levels, size = [(1, padded[: n + 1])] * 2, 3
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n + 1, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) + 1
            rank[n] = 0
            levels.append((size, rank))
            if size > most or rank.max() == n:
                break
            ahead = rank[np.minimum(np.arange(n) + size, n)]
            key = rank[:n].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
            size *= 2
        transform = symbols[order - 1]  # the symbol before each suffix
        cut = np.flatnonzero(transform[1:] != transform[:-1]) + 1  # first of each run but the first
        x, y = order[cut - 1], order[cut]
        shared, a, b = np.zeros(len(cut), np.int64), x.copy(), y.copy()
        for size, rank in reversed(levels):
            same = rank[a] == rank[b]
            shared += size * same
            a, b = np.minimum(a + size * same, n), np.minimum(b + size * same, n)
        ends = []
        for suffix, value in ((np.append(y, order[0]), np.append(shared, 0)), (np.append(x, order[-1]), np.append(shared, 0))):
            rising = np.argsort(suffix)
            ends += [suffix[rising], value[rising]]
        bounds = np.concatenate([[0], cut])
        return RunIndex(transform[bounds], np.diff(np.append(bounds, n)), *ends)

    def statistics(self, places: np.ndarray) -> np.ndarray:
        """For each place, the longest match of what begins there with what begins at another place."""

        def of(suffix: np.ndarray, shared: np.ndarray) -> np.ndarray:
            at = np.searchsorted(suffix, places, side="right") - 1
            return np.where(at >= 0, shared[at] - (places - suffix[at]), 0)

        return np.maximum(np.maximum(of(self.first, self.first_shared), of(self.last, self.last_shared)), 0)


#: Places that go through an index at once.
STREAM = 1 << 16


def _marked(want: np.ndarray, texts: list[bytes], length: int, most: int) -> np.ndarray:
    """Marks of the contexts given, each gram's own."""
    order = np.lexsort((want["lo"], want["key"], want["h"]))
    want, texts = want[order], [texts[i] for i in order]
    _, group = np.unique(want["h"], return_inverse=True)
    parts, key, lo, own = [], [], [], []
    reach = -1
    for i, (k, a, e, g) in enumerate(zip(want["key"].tolist(), want["lo"].tolist(), want["hi"].tolist(), group.tolist())):
        if parts and g == own[-1] and k == key[-1] and a <= reach:  # overlaps the one before: each place once
            if e > reach:
                parts[-1] += texts[i][reach - a :]
                reach = e
        else:
            parts.append(texts[i])
            key.append(k)
            lo.append(a)
            own.append(g)
            reach = e
    size = np.array([len(x) for x in parts])
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    symbols = raw.astype(np.int64) + np.repeat(np.array(own) * 256 + len(parts) + 1, size + 1)
    symbols[ends] = np.arange(len(parts)) + 1
    index, found = RunIndex.build(symbols, int(size.max()) + 1), []
    for begin in range(0, len(symbols), STREAM):
        places = np.arange(begin, min(begin + STREAM, len(symbols)))
        found.append(places[index.statistics(places) >= length])
    found = np.concatenate(found)
    part = np.searchsorted(ends, found)
    marks = np.zeros(len(found), _MARK)
    marks["key"] = np.array(key)[part]
    marks["lo"] = np.array(lo)[part] + found - (ends - size)[part]
    marks["hi"] = marks["lo"] + length
    return _merge(marks)


def _index(key, table, nb: int, length: int, block: int):
    want, texts = [], []
    for w, raw in zip(table["wants"], table["bytes"]):
        rows, raw = np.frombuffer(w.as_buffer(), _WANT), raw.as_py()
        ends = np.cumsum(rows["hi"] - rows["lo"]).tolist()
        want.append(rows)
        texts += [raw[a:e] for a, e in zip([0, *ends], ends)]
    want = np.concatenate(want)
    order = np.argsort(want["h"], kind="stable")
    heads = np.append(_runs(want["h"][order]), len(want))
    size = np.add.reduceat((want["hi"] - want["lo"])[order].astype(np.int64), heads[:-1])
    marks, now, held = [], [], 0

    def index(rows) -> None:
        if len(rows):
            marks.append(_marked(want[rows], [texts[i] for i in rows], length, block))

    for g in range(len(size)):
        rows = order[heads[g] : heads[g + 1]]
        if held + size[g] > block or len(now) >= 4000:
            index(np.concatenate(now) if now else np.zeros(0, np.int64))
            now, held = [], 0
        now.append(rows)
        held += size[g]
    if now:
        index(np.concatenate(now))
    out = []
    if marks:
        marks = _merge(np.concatenate(marks))
        for to, (part,) in split_rows(marks["key"] % nb, nb, marks):
            out.append(batch(_FOUND, [[to], [part], [None], [None]]))
    return pa.Table.from_batches(out, schema=_FOUND)


def _cut(batches, keep: bool):
    for b in batches:
        cols = [[] for _ in _OUT]
        for doc, text, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            raw = (text.as_py() or "").encode()
            marks = np.frombuffer(blob.as_buffer(), _MARK) if blob.is_valid else np.zeros(0, _MARK)
            kept, at = [], 0
            for lo, hi in zip(marks["lo"].tolist(), marks["hi"].tolist()):
                kept.append(raw[at:lo])
                at = hi
            kept = b"".join([*kept, raw[at:]])
            for c, x in zip(cols, (doc, len(raw), len(raw) - len(kept), len(marks), hashlib.sha256(kept).hexdigest(), kept if keep else None)):
                c.append(x)
        yield batch(_OUT, cols)


def remove_repeats(docs: DataFrame, length: int = 200, block: int = 1_000_000, keep: bool = True, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    Texts are UTF-8 bytes; a null text is empty.  A byte goes if some string of
    ``length`` bytes that covers it also starts at another place of the table,
    in the same row or not.  Strings never cross rows and are judged on the
    input, so every copy goes, the first included; equal rows count as copies.
    n_spans counts the maximal removed runs; ``kept`` holds the bytes that are
    left, which need not be whole characters (null unless ``keep``).  A null doc_id stays null; other
    columns are not read; an empty table gives an empty result.
    """
    if not GRAM < length <= 255 or length % 8:
        raise ValueError(f"length must be a multiple of 8 from {GRAM + 8} to 248")
    nb = buckets(docs.sparkSession)
    rows = keyed(docs, "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    dealt = rows.select("key", "text").mapInArrow(lambda it: _deal(it, nb, length, hot), _DEALT_SQL)
    found = stage(dealt.groupBy("bucket").applyInArrow(grouped(_match, nb=nb, block=block), _FOUND_SQL), "found")

    def by_key(table: DataFrame, column: str, dtype) -> DataFrame:
        part = table.where(F.col(column).isNotNull()).select("bucket", column)
        return part.groupBy("bucket").applyInArrow(grouped(_by_key, column=column, dtype=dtype), "key long, rows binary")

    texts = rows.select("key", "text").join(by_key(found, "wants", _WANT), "key").dropDuplicates(["key"]).select("text", "rows")
    sent = texts.mapInArrow(lambda it: _send(it, nb), "bucket int, wants binary, bytes binary")
    more = sent.groupBy("bucket").applyInArrow(grouped(_index, nb=nb, length=length, block=block), _FOUND_SQL)
    texts = rows.select("key", "text").join(by_key(found, "heavy", _MARK), "key").dropDuplicates(["key"]).select("key", "text", "rows")
    strings = texts.mapInArrow(lambda it: _strings(it, nb, length), _DEALT_SQL)
    same = strings.groupBy("bucket").applyInArrow(grouped(_same, nb=nb, length=length), _FOUND_SQL)
    marks = stage(by_key(found.unionByName(more).unionByName(same), "marks", _MARK), "marks")
    unstage(found)
    kept = rows.join(marks, "key", "left").select("doc_id", "text", "rows")
    kept = kept.mapInArrow(lambda it: _cut(it, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return kept.select(unkeyed(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
