"""Token counts of sections, from one encoding of the whole document.

A document is encoded once.  Token lengths give each token's span; a sorted
interval join (binary search of span ends among section starts) finds the
sections that it touches.  A token that crosses a boundary is allocated by rule:

``start``  to the section that holds its first character;
``most``   to the section that holds most of its bytes, the earlier on a tie;
``split``  in parts, in proportion to its bytes in each section.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encode import default_path, encoder
from .shared import batch, keyed, unkeyed

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64())]
    + [("tokens_start", pa.int64()), ("tokens_most", pa.int64()), ("tokens_split", pa.float64()), ("n_crossing", pa.int64())]
)


def attribute(raw: bytes, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, most, split, crossing) of each section; ``starts`` begins with 0.

    ``sizes`` are the bytes of the tokens in turn; ``starts`` the first byte of
    each section, rising.  crossing counts the tokens that begin in a section
    and end in a later one.
    """
    m = len(starts)
    hi = np.cumsum(sizes)
    lo = hi - sizes
    a = np.searchsorted(starts, lo, side="right") - 1
    z = np.searchsorted(starts, hi - 1, side="right") - 1
    first = np.bincount(a, minlength=m)
    most, split = first.copy(), first.astype(np.float64)
    across = np.flatnonzero(a != z)
    ends = np.append(starts[1:], len(raw))
    for t in across.tolist():
        parts = range(a[t], z[t] + 1)
        held = [min(ends[s], hi[t]) - max(starts[s], lo[t]) for s in parts]
        most[a[t]] -= 1
        most[parts[int(np.argmax(held))]] += 1
        split[a[t]] -= 1
        for s, n in zip(parts, held):
            split[s] += n / sizes[t]
    return first, most, split, np.bincount(a[across], minlength=m)


def _count(batches, path: str, separator: str):
    enc, sep = encoder(path), np.frombuffer(separator.encode(), np.uint8)[0]
    for b in batches:
        cols = [[] for _ in _OUT]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            raw = text.encode()
            seen = np.frombuffer(raw, np.uint8)
            starts = np.append(0, np.flatnonzero(seen == sep) + 1)
            starts = starts[starts < max(1, len(raw))]
            sizes = enc.byte_lengths[np.frombuffer(enc.ids(text), "<u4")]
            first, most, split, across = attribute(raw, sizes, starts)
            chars = np.append(0, np.cumsum((seen & 0xC0) != 0x80))
            begin = chars[starts]
            for c, x in zip(cols, (np.full(len(starts), doc), np.arange(len(starts)), begin, np.diff(np.append(begin, chars[-1])), first, most, split, across)):
                c.append(x)
        if cols[0]:
            yield batch(_OUT, [np.concatenate(c) for c in cols])


def section_tokens(docs: DataFrame, path: str | None = None, separator: str = "\n") -> DataFrame:
    """One row for each section of each document, in the order of the text.

    Sections are the parts between separators (one ASCII character); each keeps
    the separator that ends it, so sections cover the text.  Columns: doc_id,
    section (from 0), start and n_chars (code points), tokens_start,
    tokens_most, tokens_split (the three rules) and n_crossing (tokens that
    begin here and end in a later section).  Each rule's counts add up to the
    document's tokens.  Null and empty texts have one section with no tokens.
    Rows are handled one by one, so equal rows give equal output; a null doc_id
    stays null; other columns are not read.
    """
    if len(separator.encode()) != 1:
        raise ValueError("the separator is one ASCII character")
    path = path or default_path()
    out = keyed(docs, "text").mapInArrow(
        lambda it: _count(it, path, separator),
        "doc_id long, section long, start long, n_chars long, tokens_start long, tokens_most long, tokens_split double, n_crossing long",
    )
    return out.select(unkeyed(), *out.columns[1:])
