"""Spelling variants of the words of a corpus, by a symmetric-delete join.

1.  The runs of letters of every whole text are counted per slice of texts and
    the counts summed per word.  Words are numbered by falling count, equal
    counts in code-point order, so the smaller of two numbers is the better form.
2.  Every word emits itself and, for each of its places, the word without the
    code point there.  What is emitted is a key of 128 bits (two sums over the
    code points), so a word emits as much as it is long, however long it is.
3.  The keys are joined by equality.  Two words are at distance one exactly if

    - they have one key from the same place: one code point is replaced (they
      differ at one place, so they meet in one such group), or
    - the key of one as it is is a deletion of the other: one code point is
      inserted or deleted.  Deletions of equal code points in a row give one
      string, of which the first counts.

    So key and place verify the distance, and no pair at distance two is formed.
    A group of one key and place has a word for each letter at most (90), from
    which each gets the number of the others and the best; itself and deletions
    meet in as many rows as there are deletions.  The form that is chosen is
    verified once more, by its edit distance.
4.  A form has at least ``ratio`` times the word's count, so chains of forms are
    as long as the logarithm of the largest count, and roots are found by joining
    the table of forms with itself until nothing changes, which halves the chains.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, stage, unstage

#: Bytes of letters; those beyond ASCII are a lead byte and a second one, shown as the lead too.
_LEAD = 0xC3
_INK = np.zeros(256, dtype=bool)
_INK[65:91] = _INK[97:123] = _INK[_LEAD] = True
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_EMITTED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()), ("id", pa.int64())])
_EMITTED_SQL = "k1 long, k2 long, place int, first boolean, id long"
#: Numbers of the 256 code points, for either half of a key.
_CODES = [K.mix(np.arange(256, dtype=np.uint64) * np.uint64(step) + np.uint64(step >> 7)) for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(raw: np.ndarray, first: np.ndarray, last: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of byte spans, each going on from the crc32 ``begun`` of what is before it."""
    state, size = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), last - first
    at, j = np.flatnonzero((size > 0) & (size <= 64)), 0
    while len(at):
        state[at] = _CRC[(state[at] ^ raw[first[at] + j]) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
        j += 1
        at = at[size[at] > j]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64).tolist():
        state[i] = zlib.crc32(raw[first[i] : last[i]].tobytes(), int(begun[i]))
    return state


def _counted(batches, every: int, least: int):
    """The words of each slice of texts with their counts; ``every`` 0 leaves all runs as they are."""
    for b in batches:
        heads = [zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in b.column(0).to_pylist()]
        for at, raw, starts in K.slices(b.column(1), 8 << 20):
            lead = raw == _LEAD
            shown = raw.copy()
            shown[1:][lead[:-1]] = _LEAD
            first, last, row = K.words(shown, starts, _INK)
            leads = np.concatenate([[0], np.cumsum(lead)])
            fits = np.flatnonzero(last - first - (leads[last] - leads[first]) >= least)
            first, last, row = first[fits], last[fits], row[fits]
            low, odd = K.LOWER[raw], Counter()
            if every:
                h = crc32(low, first, last, np.array(heads[at : at + len(starts) - 1], np.uint32)[row])
                gone = h % every == 0
                for i in np.flatnonzero(gone).tolist():
                    word = low[first[i] : last[i]].tobytes().decode()
                    place = int(h[i]) % len(word)
                    if len(word) > least:
                        odd[word[:place] + word[place + 1 :]] += 1
                first, last = first[~gone], last[~gone]
            _, one, count = np.unique(K.spans_hash(low, first, last), return_index=True, return_counts=True)
            found = [low[a:z].tobytes().decode() for a, z in zip(first[one].tolist(), last[one].tolist())]
            if found or odd:
                yield batch(_COUNTED, [found + list(odd), np.concatenate([count, np.array(list(odd.values()), np.int64)])])


def word_counts(docs: DataFrame, every: int = 199, least: int = 6) -> DataFrame:
    """(word, n): the words of at least ``least`` code points of all texts, with their occurrences.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF, of which only A-Z
    are lower-cased.  With ``every`` above 0, a run whose crc32 of ``<doc_id>:<run>``
    is divisible by it loses the code point at the crc32 modulo its length; a null
    doc_id is written ``null``.  Null and empty texts have no words.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counted(it, every, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _emitted(batches):
    for b in batches:
        words = b.column(1).to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        ends = np.cumsum(size)
        begin, id_ = ends - size, np.array(b.column(0))
        own = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(codes))
        lo, hi, keys = begin[own], ends[own], []
        for table in _CODES:
            total, down = K.rolling(table[codes])
            back = down[1] if len(down) > 1 else np.uint64(1)
            whole = K.mix((total[ends] - total[begin]) * down[begin] + size.astype(np.uint64))
            less = (total[at] - total[lo]) + (total[hi] - total[at + 1]) * back
            keys.append(np.concatenate([whole, K.mix(less * down[lo] + (hi - lo - 1).astype(np.uint64))]).view(np.int64))
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (at[1:] == lo[1:])
        place = np.concatenate([np.full(len(words), -1), at - lo]).astype(np.int32)
        yield batch(_EMITTED, [*keys, place, np.concatenate([np.ones(len(words), bool), first]), np.concatenate([id_, id_[own]])])


def _neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of words at distance one and the smallest number among them."""
    emitted = words.select("id", "word").mapInArrow(_emitted, _EMITTED_SQL)
    less = emitted.where("place >= 0")
    alike = less.groupBy("k1", "k2", "place").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    one = alike.select(F.explode("ids").alias("id"), (F.size("ids") - 1).cast("long").alias("n"), "ids")
    swapped = one.select("id", "n", F.when(F.col("id") == F.col("ids")[0], F.col("ids")[1]).otherwise(F.col("ids")[0]).alias("best"))
    whole = emitted.where("place < 0").select("k1", "k2", F.col("id").alias("short"))
    pairs = less.where("first").select("k1", "k2", "id").join(whole, ["k1", "k2"])
    ends = F.explode(F.array(F.struct("id", F.col("short").alias("best")), F.struct(F.col("short").alias("id"), F.col("id").alias("best")))).alias("e")
    other = pairs.select(ends).select("e.id", F.lit(1).cast("long").alias("n"), "e.best")
    return swapped.unionByName(other).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words that have a form, from (id, root) with their forms."""
    roots = stage(forms, "roots")
    while True:
        on = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = roots.select("id", "root").join(on, "root", "left")
        after = stage(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        unstage(roots)
        roots = after
        if roots.where("went").isEmpty():
            return roots.select("id", "root")


def spelling_variants(docs: DataFrame, least: int = 6, fewest: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words with ``fewest`` occurrences or more.

    See :func:`word_counts` for what a word is.  Two words are near if they differ
    by one inserted, deleted or replaced code point.  A word's form is its near
    word of largest n (ties: the smallest in code-point order) where that n is at
    least ``ratio`` times its own, else null; its root is the last of its forms,
    or itself.  ``n_near`` counts near words, ``form_n`` is the form's n.  Rows of
    the table are occurrences each, also where ids or texts repeat; other columns
    are not read.  No words give an empty table.
    """
    counted = stage(word_counts(docs, every, least).where(F.col("n") >= fewest), "words")
    words = stage(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    unstage(counted)
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.join(_neighbours(words), "id", "left").join(best, "best", "left")
    good = (F.col("form_n") >= ratio * F.col("n")) & (F.levenshtein("word", "form", 1) == 1)
    known = stage(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms")
    roots = _roots(known.where("best is not null").select("id", F.col("best").alias("root")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("last")), "root").select("id", "last")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
