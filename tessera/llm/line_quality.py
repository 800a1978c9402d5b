"""Line-first cleaning: judge lines, drop those that fail, then judge the text.

Words are runs outside ``\\x20 \\x09-\\x0D``; lines are parts between ``\\n``.  The
rules work on the bytes of many texts at once and count what every language
shares (separators, links, symbols, capitals, repeats, ends of sentences); the
only lists of words are those of menus and notices, in four languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .shared import batch, keyed, unkeyed

SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "||", "‖", "›", "»", "·", "•", "→", ">", ">>")
LINKS = ("http://", "https://", "www.")
ENDS = tuple(".!?…:;,\"'”’»)。！？")
#: A line of such words alone is a menu, if one of MENU is among them.
MENU = (
    "home menu login logout signin signup sign skip sitemap search subscribe contact faq help products blog news share next previous back read "
    "startseite menü suche suchen anmelden abmelden registrieren kontakt impressum datenschutz hilfe weiter zurück teilen weiterlesen nachrichten "
    "accueil recherche rechercher connexion déconnexion inscription contactez suivant précédent partager aide actualités plan connecter "
    "inicio menú buscar búsqueda contacto siguiente anterior compartir ayuda registrarse noticias suscribirse suscríbete sesión mapa volver"
).split()
BESIDE = (
    "to the main content page top more in up log out this us about our site map all and on of "
    "zum zur nach oben hauptinhalt inhalt seite mehr über uns und alle der die das "
    "au aller contenu principal page haut plus nous à propos du de le la les et site se "
    "al el la contenido página arriba más acerca de nosotros y del sitio iniciar cerrar"
).split()
#: A line that holds one of these as whole words is a notice.
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookies", "cookie policy", "enable javascript",
    "javascript is", "javascript must be", "click here", "lorem ipsum", "licensed under the", "copyright (c)", "(c) 19", "(c) 20", "(c)19", "(c)20",
    "©", "copyright 1", "copyright 2", "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "klicken sie hier",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions générales", "cliquez ici",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "términos y condiciones", "haga clic aquí",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_WORDS = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()


@dataclass(frozen=True)
class LineRules:
    """What fails a line (texts of fewer words than ``short`` are exempt from punctuation) and a text."""

    short: int = 4
    menu: int = 16  # a menu has so many words at most
    most_bars: int = 2  # words that are separators
    most_links: float = 0.5  # share of the words that are links
    most_symbols: float = 0.5  # symbols for each word
    most_shouts: float = 0.5  # share of words that end in "!!" or of words in capitals
    most_same: float = 0.5  # share of the commonest word, in lines of 10 words or more
    most_lost: float = 0.4  # share of the words in failed lines that rejects a text
    check_end: bool = True


def _names(words) -> np.ndarray:
    """The hashes that :func:`kernel.spans_hash` gives the words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return K.spans_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes in UTF-8) in small letters."""
    low = K.LOWER[raw]
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] == 0xC3
    low[second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    return low


def _within(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many places of the mask lie in each lo .. hi - 1."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[hi] - total[lo]


def _ends_with(raw: np.ndarray, first: np.ndarray, last: np.ndarray, endings: list[bytes]) -> np.ndarray:
    """Which spans end in one of the byte strings."""
    found = np.zeros(len(first), bool)
    for e in endings:
        fits = last - first >= len(e)
        for n, byte in enumerate(reversed(e)):
            fits &= raw[np.maximum(last - 1 - n, 0)] == byte
        found |= fits
    return found


def _begins_with(raw: np.ndarray, first: np.ndarray, last: np.ndarray, begin: bytes) -> np.ndarray:
    fits = last - first >= len(begin)
    for n, byte in enumerate(begin):
        fits &= raw[np.minimum(first + n, len(raw) - 1)] == byte
    return fits


def _notices(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the notices in the rows, whole words."""
    data, found, edge = low.tobytes(), [], set(starts.tolist())
    for phrase in NOTICES:
        p = phrase.encode()
        left, right = K.LETTER[p[0]] and p[0] < 128, K.LETTER[p[-1]] and p[-1] < 128 and not p[-1:].isdigit()
        at = data.find(p)
        while at >= 0:
            end = at + len(p)
            if not (left and at not in edge and K.LETTER[data[at - 1]]) and not (right and end not in edge and K.LETTER[data[end]]):
                found.append((at, end))
            at = data.find(p, at + 1)
    found = np.array(found, np.int64).reshape(-1, 2)
    row = np.searchsorted(starts, found[:, 0], side="right")
    return found[row == np.searchsorted(starts, found[:, 1], side="left"), 0]  # not across rows


def _commonest(line: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How often the commonest word of each line is there."""
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    heads = np.flatnonzero(new)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, line[heads], np.diff(np.append(heads, len(h))))
    return out


def judge(raw: np.ndarray, starts: np.ndarray, rules: LineRules):
    """(base counts and failures of each row, first and last byte, row and verdict of each line with a word)."""
    rows = len(starts) - 1
    first, last, row = K.words(raw, starts)
    low = lowered(raw)
    names = K.spans_hash(raw, first, last)
    out = {"n_words": np.bincount(row, minlength=rows)}
    chars = _within((raw & 0xC0) != 0x80, first, last)
    out["word_chars"] = np.bincount(row, chars, rows).astype(np.int64)
    symbol = _SYMBOL[raw]
    out["n_symbols"] = _within(symbol, starts[:-1], starts[1:])
    # words in 5-word windows that are there twice or more
    h, at = K.windows_hash(names, row, 5)
    order = np.lexsort((h, row[at]))
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(first) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=rows)
    # lines with a word
    begin = np.unique(np.concatenate([starts[:-1], np.flatnonzero(raw == 10) + 1]))
    begin = begin[begin < len(raw)]
    line = np.searchsorted(begin, first, side="right") - 1
    kept, line = np.unique(line, return_inverse=True)
    lo, n = begin[kept], np.bincount(line, minlength=len(kept))
    own = np.searchsorted(starts, lo, side="right") - 1
    hi = np.append(begin[1:], len(raw))[kept]
    hi = hi - ((raw[hi - 1] == 10) & (hi > lo)) if len(lo) else hi
    text = K.spans_hash(raw, lo, hi)
    order = np.lexsort((text, own))
    out["n_dup_lines"] = np.bincount(own[order][1:][(text[order][1:] == text[order][:-1]) & (own[order][1:] == own[order][:-1])], minlength=rows)
    out["n_lines"] = np.bincount(own, minlength=rows)
    count = lambda mask: np.bincount(line, mask, len(lo))  # noqa: E731  words of each line for which it holds
    failed = count(np.isin(names, _names(SEPARATORS))) > rules.most_bars
    links = np.zeros(len(first), bool)
    for begins in LINKS:
        links |= _begins_with(low, first, last, begins.encode())
    failed |= count(links) > rules.most_links * n
    failed[np.searchsorted(lo, _notices(low, starts), side="right") - 1] = True
    failed |= _within(symbol, lo, hi) > rules.most_symbols * n
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] == 0xC3
    upper = (raw >= 65) & (raw <= 90) | second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    lower = (raw >= 97) & (raw <= 122) | second & (raw >= 0x9F) & (raw <= 0xBF) & (raw != 0xB7)
    capital = (chars > 1) & (_within(upper, first, last) > 0) & (_within(lower, first, last) == 0)
    shout = _ends_with(raw, first, last, [b"!!"])
    failed |= (n >= 2) & (np.maximum(count(capital), count(shout)) > rules.most_shouts * n)
    failed |= (n >= 10) & (_commonest(line, names, len(lo)) > rules.most_same * n)
    if rules.check_end and len(lo):
        final = np.append(np.flatnonzero(np.diff(line)), len(line) - 1)
        failed |= (n >= rules.short) & ~_ends_with(raw, first[final], last[final], [e.encode() for e in ENDS])
    # menus: short lines whose words, without what is around their letters, are all on the lists
    short = np.flatnonzero((n <= rules.menu)[line])
    a, z = first[short].copy(), last[short].copy()
    for _ in range(3):
        a += (a < z) & ~K.LETTER[raw[np.minimum(a, len(raw) - 1)]]
        z -= (a < z) & ~K.LETTER[raw[np.maximum(z - 1, 0)]]
    word = K.spans_hash(low, a, z)
    strong = (a < z) & np.isin(word, _names(MENU))
    listed = strong | (a >= z) | np.isin(word, _names(BESIDE))
    of = line[short]
    failed |= (np.bincount(of, strong, len(lo)) > 0) & (np.bincount(of, listed, len(lo)) == n)
    out["n_failed_lines"] = np.bincount(own, failed, rows).astype(np.int64)
    out["n_lost_words"] = np.bincount(own, n * failed, rows).astype(np.int64)
    return out, lo, hi, own, failed


_OUT = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in _WORDS), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("n_lines", pa.int64()), ("n_failed_lines", pa.int64()), ("n_lost_words", pa.int64()), ("clean_text", pa.string())]
)


def _rows(batches, rules: LineRules, keep_text: bool):
    for b in batches:
        parts, texts = [], []
        for _, raw, starts in K.slices(b.column(1)):
            out, lo, hi, own, failed = judge(raw, starts, rules)
            parts.append(out)
            if keep_text:
                data, fine = raw.tobytes(), np.flatnonzero(~failed)
                cut = np.searchsorted(own[fine], np.arange(len(starts)))
                lines = [data[s:e] for s, e in zip(lo[fine].tolist(), hi[fine].tolist())]
                texts += [b"\n".join(lines[s:e]).decode() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
        col = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (*_WORDS, "n_lines", "n_failed_lines", "n_lost_words")}
        base = (col["n_words"] < 10) | (100 * col["n_repeat_words"] > 20 * col["n_words"])
        kept = ~base & (col["n_lost_words"] <= rules.most_lost * col["n_words"])
        clean = pa.array(texts, pa.string()) if keep_text else pa.nulls(len(base), pa.string())
        yield batch(_OUT, [b.column(0), *[col[c] for c in _WORDS], base, kept, col["n_lines"], col["n_failed_lines"], col["n_lost_words"], clean])


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), keep_text: bool = True) -> DataFrame:
    """One row for each document: base counts, verdict and the text of the lines that pass.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines (lines with a word),
    n_failed_lines, n_lost_words (in failed lines) and clean_text (lines that
    pass, joined by line feeds; null unless ``keep_text``).  A line fails for
    separators or links, as a menu or a notice, for symbols, shouting, one word
    over and over, or no mark at its end; a text whose base passes is kept
    unless it loses more than ``most_lost`` of its words.  Equal words and lines
    of a text are told by 64-bit hashes.  A null text has no words, fails the
    base and is not kept.  Rows are judged one by one, so equal rows get equal
    verdicts; a null doc_id stays null; other columns are not read.
    """
    schema = ", ".join(f"{f.name} {({'int64': 'long', 'bool': 'boolean'}).get(str(f.type), str(f.type))}" for f in _OUT)
    out = keyed(docs, "text").mapInArrow(lambda it: _rows(it, rules, keep_text), schema)
    return out.select(unkeyed(), *out.columns[1:])
