"""The operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, jaccard_join, line_quality, mixing, ordinal_quality, packing, passage_chains, suffix_dedup, token_counts, topk_search
from tessera.llm.encode import default_path, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdeéß") for _ in range(R.randint(2, 6))) for _ in range(400)]
PASSAGE = " ".join(R.choice(VOCABULARY) for _ in range(70))


def text(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(t, n):
    w = t.split()
    for _ in range(n):
        w[R.randrange(len(w))] = "edit" + str(R.randrange(99))
    return " ".join(w)


BASE = text(80)
DOCS = [(i, text(R.randint(1, 120))) for i in range(30)]
DOCS += [(100 + i, edited(BASE, i % 4)) for i in range(12)] + [(200 + i, BASE.upper() if i else BASE) for i in range(3)]
DOCS += [(300 + i, f"{text(30)} {edited(PASSAGE, i)}\n{text(20)}") for i in range(4)]
DOCS += [(400, None), (401, ""), (402, " \t\n"), (403, "a"), (404, "a " * 3000), (405, "x" * 5000), (None, "null id here"), (406, "one two three four"), (407, "ONE two three\x0bfour")]
SCHEMA = "doc_id long, text string, bucket string, key string, h string, rep string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "b", "k", "h", "r", None if i == 3 else f"s{(i or 0) % 4}") for i, t in DOCS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_jaccard(docs, none):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs, block=400).collect()}
    key = lambda i: -(2**63) if i is None else i
    sets, root = {i: shingles(t) for i, t in DOCS}, {i: i for i, _ in DOCS}
    while True:
        before = dict(root)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j], key=key)
        if before == root:
            break
    want = {i: (len(s), root[i]) for i, s in sets.items()}
    assert got == want
    for block, hot in ((90, 64), (2_000_000, 64), (2_000_000, 1), (400, 3)):  # blocks of one or two rows; no blocks; shingles that few share are hot
        assert {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs, block=block, hot=hot).collect()} == want
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_chain(spark):
    """A cluster of several components and long chains, cut into many blocks, has the components that it has in one."""
    made, base = [], text(40).split()
    for i in range(60):
        if i % 20 == 0:
            base = base[:20] + text(20).split()  # shares half with the component before
        w = list(base)
        w[i % 40] = f"own{i}"
        base = w if i % 3 == 0 else base
        made.append((1000 - i, " ".join(w)))
    docs, root = spark.createDataFrame(made, "doc_id long, text string"), {i: i for i, _ in made}
    sets = {i: shingles(t) for i, t in made}
    for _ in made:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert 1 < len(set(root.values())) < 60
    for block, hot in ((40, 64), (150, 64), (10**6, 64), (10**6, 1), (150, 4)):
        got = {r[0]: r[2] for r in jaccard_join.jaccard_components(docs, block=block, hot=hot).collect()}
        assert got == root


def test_suffix(docs, none, spark):
    extra = [(500, "ab" * 300), (500, "ab" * 300), (501, PASSAGE * 2)]
    core, sides = text(60)[:185], [text(30)[:40] for _ in range(6)]  # one gram with many contexts, of which some share 200 bytes
    extra += [(600 + i, f"{text(9)}{R.choice(sides)[R.randint(0, 35) :]}{core}{R.choice(sides)[: R.randint(0, 40)]}{text(9)}") for i in range(60)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    all_ = DOCS + extra
    raws, seen = [(t or "").encode() for _, t in all_], {}
    for n, b in enumerate(raws):
        for j in range(len(b) - 199):
            seen.setdefault(b[j : j + 200], []).append((n, j))
    marks = [bytearray(len(b)) for b in raws]
    for at in seen.values():
        for n, j in at if len(at) > 1 else ():
            marks[n][j : j + 200] = b"\1" * 200
    want = []
    for (i, _), b, m in zip(all_, raws, marks):
        kept = bytes(x for x, y in zip(b, m) if not y)
        want.append((i, len(b), len(b) - len(kept), len(bytes(m).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    for block, hot in ((1000, 64), (3000, 64), (1_000_000, 64), (1_000_000, 2)):
        got = suffix_dedup.remove_repeats(rows, block=block, hot=hot).drop("kept").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_run_index(seed):
    """Matching statistics against all pairs of places, and the transform's runs, on texts with many repeats."""
    r = random.Random(seed)
    base = [r.randrange(3) for _ in range(40)]
    texts = [base[r.randint(0, 10) : r.randint(20, 40)] * r.randint(1, 2) + [r.randrange(3) for _ in range(r.randint(0, 9))] for _ in range(7)]
    symbols = np.array([x for n, t in enumerate(texts) for x in [*(s + len(texts) + 1 for s in t), n + 1]])
    index = suffix_dedup.RunIndex.build(symbols, max(map(len, texts)) + 1)
    n = len(symbols)

    def shared(i, j):
        k = 0
        while max(i, j) + k < n and symbols[i + k] == symbols[j + k]:
            k += 1
        return k

    assert index.statistics(np.arange(n)).tolist() == [max(shared(i, j) for j in range(n) if j != i) for i in range(n)]
    order = sorted(range(n), key=lambda i: symbols[i:].tolist())
    transform = [int(symbols[i - 1]) for i in order]
    assert np.repeat(index.heads, index.lengths).tolist() == transform and len(index.heads) < n


def test_passages(docs, none):
    found = passage_chains.fuzzy_passages(docs)
    rows = found.collect()
    hits = {r.doc_id for r in rows if (r.ref_id or 0) >= 300 and r.ref_id < 400}
    assert {301, 302, 303} <= hits and not {r.doc_id for r in rows} & set(range(30))
    for r in rows:
        assert r.end - r.start >= 45 and r.n_matched * 100 >= 75 * (r.end - r.start)
    cut = {r[0]: r[1] for r in passage_chains.remove_passages(docs, found).select("doc_id", "text").collect()}
    assert len(cut) == len(DOCS) and cut[400] is None and cut[300] == dict(DOCS)[300]
    assert len(cut[301].split()) <= 55 and passage_chains.fuzzy_passages(none).count() == 0


def exact(d, r, n):
    """Two texts without a word in common but for ``n``."""
    return [f"d{d}w{i}" for i in range(n)], [f"d{r}w{i}" for i in range(n)]


def test_passages_of_a_chain_that_fails(spark):
    """Two exact passages with other words between them are both found, however far apart they are and on whichever side."""
    made, want = [], {}
    for n, (size, here, there) in enumerate([(60, 50, 50), (60, 100, 100), (60, 140, 140), (100, 160, 160), (60, 200, 0), (60, 0, 120), (60, 40, 40)]):
        p, q = ([f"{c}{n}x{i}" for i in range(size)] for c in "pq")
        a, b = exact(2 * n, 2 * n + 1, 400)
        made += [(2 * n, " ".join([*a[:40], *p, *a[40 : 40 + there], *q, *a[300:]])), (2 * n + 1, " ".join([*b[:30], *p, *b[30 : 30 + here], *q, *b[300:]]))]
        want[2 * n + 1] = {*range(30, 30 + size), *range(30 + size + here, 30 + 2 * size + here)}
    rows = passage_chains.fuzzy_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    for d, words in want.items():
        assert words <= {w for r in rows if r.doc_id == d for w in range(r.start, r.end)}
    assert all(4 * r.n_matched >= 3 * max(r.end - r.start, r.ref_end - r.ref_start) and r.n_matched >= 50 for r in rows)


def substituted(words, percent, seed):
    """Words of which the rest to ``percent`` are replaced at random places between the first and the last."""
    r, w = random.Random(seed), list(words)
    for n, i in enumerate(r.sample(range(1, len(w) - 1), len(w) - -(-len(w) * percent // 100))):
        w[i] = f"s{seed}n{n}"
    return w


@pytest.mark.parametrize("size, percent, least", [(50, 95, 60), (60, 90, 60), (60, 80, 57), (80, 75, 57), (50, 75, 54)])
def test_passages_with_changed_words(spark, size, percent, least):
    """60 passages with random substitutions, and one with a changed word near each end."""
    made = []
    for n in range(60):
        p, (a, b) = [f"p{n}x{i}" for i in range(size)], exact(2 * n, 2 * n + 1, 60)
        made += [(2 * n, " ".join([*a[:30], *p, *a[30:]])), (2 * n + 1, " ".join([*b[:30], *substituted(p, percent, n), *b[30:]]))]
    p = [f"px{i}" for i in range(50)]
    made += [(1000, " ".join(p)), (1001, " ".join([*p[:2], "new", *p[3:47], "other", *p[48:]]))]
    rows = passage_chains.fuzzy_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in rows} - {1001}) >= least
    assert [(r.start, r.end, r.n_matched) for r in rows if r.doc_id == 1001] == [(0, 50, 48)]


@pytest.mark.parametrize("copies", [1, 12])
@pytest.mark.parametrize("size", [50, 60])
def test_passages_whose_seeds_scatter(spark, copies, size):
    """Halves of a passage in other documents, rare or common, or earlier in the same one, do not hide it."""
    made, n = [], 0

    def add(*parts):
        nonlocal n
        made.append((n, " ".join(w for i, p in enumerate(parts) for w in (*p, *(f"d{n}f{i}x{j}" for j in range(8))))))
        n += 1
        return n - 1

    want = {}
    for c in range(5):
        p = [f"p{c}x{i}" for i in range(size)]
        halves, cut = (p[: size // 2], p[size // 2 :]), size - 1 if copies > 1 else size // 2
        for _ in range(copies):
            add(halves[0]), add(halves[1]), add(p[: min(cut, 49)])
        add(halves[1], halves[0], p)
        for _ in range(copies):
            add(halves[0]), add(halves[1]), add(p[: min(cut, 49)])
        want[add(p)] = size
    rows = passage_chains.fuzzy_passages(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    for d, size in want.items():
        assert any(r.doc_id == d and r.n_matched == size and r.start == 0 for r in rows), d


def test_fenwick_chain():
    assert passage_chains.chain([(0, 10, 0, 10), (12, 30, 12, 30), (5, 9, 40, 44)])[0] == [(0, 10, 0, 10), (12, 30, 12, 30)]
    assert passage_chains.chain([(0, 5, 0, 5)]) == []


def test_tokens_and_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    strange = ["a  b\n\n c", " lead", "tail ", "<|endoftext|> x", "日本語 テスト", "it's we'll 12ab\t\tq", "  nb sp"]
    for t in [x for _, x in DOCS if x] + strange:
        assert np.frombuffer(encoder(default_path()).ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    got = packing.pack(docs, capacity=64).toPandas()
    for i, t in DOCS:
        ids = np.array([*(whole.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[1:] == 64).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by.length.sum().max() <= 64
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert packing.pack(none).count() == 0


def fewest(pieces, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for n in {r: j for j, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, rooms[:n] + [rooms[n] - pieces[i]] + rooms[n + 1 :])
        place(i + 1, rooms + [capacity - pieces[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_local_search(seed):
    r = random.Random(seed)
    small = seed >= 4
    counts = {r.randint(20, 100): r.randint(1, 2 if small else 9) for _ in range(7 if small else 20)}
    plan = packing.best_fit(counts, 100)
    after = packing.local_search([[t, p] for t, p in plan], 100)
    total = {}
    for times, pattern in after:
        assert sum(k * v for k, v in pattern.items()) <= 100
        for k, v in pattern.items():
            total[k] = total.get(k, 0) + times * v
    assert total == counts and sum(t for t, _ in after) <= sum(t for t, _ in plan)
    if small:  # best fit and the search are near the least number
        pieces = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
        assert sum(t for t, _ in after) <= fewest(pieces, 100) + 1


def test_local_search_empties_sequences():
    """Each of these needs a move, a swap of one for one, or of two for one."""
    for pieces, before in (([[60], [30], [10]], 3), ([[70, 20], [60, 30], [20]], 3), ([[50, 40], [45, 45], [10, 10]], 3)):
        after = packing.local_search([[1, packing.Counter(p)] for p in pieces], 100)
        assert sum(t for t, _ in after) < before


def test_sections():
    first, most, split, across = token_counts.attribute(b"abcdefgh", np.array([3, 2, 3]), np.array([0, 4]))
    assert (first.tolist(), most.tolist(), split.tolist(), across.tolist()) == ([2, 1], [2, 1], [1.5, 1.5], [1, 0])


def spans_of(text, whole):
    """(first, past the last) byte of each token of an ASCII text, as the tokenizer itself tells them."""
    return whole.encode(text, add_special_tokens=False).offsets


def test_sections_against_loops(spark):
    """Each token's characters are dealt to the sections one by one."""
    from tokenizers import Tokenizer

    whole, r = Tokenizer.from_file(default_path()), random.Random(8)
    made = [(i, "".join(r.choice(["the ", "token", "isation", "\n", "\n\n", ";", " ", "-----", "\n   ", "x;y", "!!"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    for separator in ("\n", ";"):
        rows = token_counts.section_tokens(spark.createDataFrame(made, "doc_id long, text string"), separator=separator).collect()
        got = {}
        for x in rows:
            got.setdefault(x.doc_id, []).append(x)
        for i, t in made:
            parts = re.findall(f"[^{separator}]*{separator}|[^{separator}]+$", t) or [""]
            place = [n for n, p in enumerate(parts) for _ in p]
            first, most, split, cross = ([0.0] * len(parts) for _ in range(4))
            for a, z in spans_of(t, whole):
                held = [place[a:z].count(n) for n in range(len(parts))]
                first[place[a]] += 1
                most[held.index(max(held))] += 1
                cross[place[a]] += place[a] != place[z - 1]
                for n, h in enumerate(held):
                    split[n] += h / (z - a)
            own = sorted(got[i], key=lambda x: x.section)
            assert [x.n_chars for x in own] == [len(p) for p in parts] and [x.start for x in own] == [sum(map(len, parts[:n])) for n in range(len(parts))]
            assert [(x.tokens_start, x.tokens_most, x.n_crossing) for x in own] == list(zip(first, most, cross))
            assert [x.tokens_split for x in own] == pytest.approx(split)


def test_sections_add_up(docs, none):
    got = token_counts.section_tokens(docs).groupBy("doc_id").agg(F.sum("tokens_start").alias("a"), F.sum("tokens_most").alias("b"), F.sum("tokens_split").alias("c"), F.sum("n_chars").alias("n")).collect()
    enc = encoder(default_path())
    for r in got:
        t = dict(DOCS)[r.doc_id] or ""
        assert r.a == r.b == pytest.approx(r.c) == len(enc.ids(t)) // 4 and r.n == len(t)
    assert token_counts.section_tokens(none).count() == 0


def line_fails(line, rules=line_quality.LineRules()):
    """The rules for one line, one by one, without the operator's arrays."""
    words = WORD.findall(line)
    n, small = len(words), line.lower()
    if sum(w in line_quality.SEPARATORS for w in words) > rules.most_bars or sum(w.lower().startswith(line_quality.LINKS) for w in words) > rules.most_links * n:
        return "navigation"
    runs = [re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]{0,3}|[^0-9A-Za-z\x80-\U0010ffff]{0,3}$", "", w).lower() for w in words]
    if n <= rules.menu and any(w in line_quality.MENU for w in runs) and all(not w or w in line_quality.MENU or w in line_quality.BESIDE for w in runs):
        return "menu"
    letter = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    for p in line_quality.NOTICES:
        for m in re.finditer(f"(?={re.escape(p)})", small):
            before, after = small[m.start() - 1 : m.start()] if m.start() else "", small[m.start() + len(p) : m.start() + len(p) + 1]
            if not (p[0].isascii() and p[0].isalpha() and before and letter(before)) and not (p[-1].isascii() and p[-1].isalpha() and after and letter(after)):
                return "boilerplate"
    if sum(map(line.count, line_quality.SYMBOLS)) > rules.most_symbols * n:
        return "symbols"
    if n >= 2:
        loud = lambda w: len(w) > 1 and any(c.isupper() for c in w if ord(c) < 256) and not any(c.islower() for c in w if ord(c) < 256)
        if max(sum(w.endswith("!!") for w in words), sum(map(loud, words))) > rules.most_shouts * n:
            return "shouting"
    if n >= 10 and max(words.count(w) for w in words) > rules.most_same * n:
        return "sameness"
    return "punctuation" if n >= rules.short and not words[-1].endswith(line_quality.ENDS) else ""


def cleaned(text):
    """The whole row of a text, by loops."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    cover = {k for j, g in enumerate(grams) if seen[g] > 1 for k in range(j, j + 5)}
    bad = [bool(line_fails(x)) for x in lines]
    lost = sum(len(WORD.findall(x)) for x, f in zip(lines, bad) if f)
    base = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    counts = len(w), sum(map(len, w)), sum(map(text.count, line_quality.SYMBOLS)), len(lines) - len(set(lines)), len(cover)
    return (*counts, base, not base and lost <= 0.4 * len(w), len(lines), sum(bad), lost, "\n".join(x for x, f in zip(lines, bad) if not f))


LINES = ["Home | News | About | Help", "Home", "Skip to main content", "Log in / Sign up", "Zurück zur Startseite", "Inicio » Noticias » Ayuda", "About the more.", "ACCUEIL", "« Précédent Suivant »"]
LINES += ["All rights reserved.", "TOUS DROITS RÉSERVÉS.", "Small rights reserved", "call rights reserved.", "x© y z w.", "Copyright 2020 by none.", "We eat cookies here.", "cookiescutter is fine.", "(c) 2019 them.", "Lorem ipsum dolor sit."]
LINES += ["A fine line of words.", "BUY!! NOW!! YES!!", "ÉTÉ ÀÇ là.", "ß A B C.", "no end to this line", "three words here", "x### y*** z$$$", "a | b | c | d.", "a|b|c|d and more.", "see http://a.b www.c.d", "WWW.X.Y one two.", "a\xa0b c d", "ends in nbsp here.\xa0"]
LINES += ["it ends “so”", "end of it…", "日本 語 の 文。", "日本 語 の 文", " \t ", "", "\x0b", "buy " * 12 + "it.", "q w e r t z u i o p buy buy.", "Was it I or A B?", "ЭТО ВСЕ КРИК ТУТ.", "\r"]


@pytest.mark.parametrize("seed", range(3))
def test_clean_lines(spark, docs, none, seed):
    """Counts, verdicts and clean texts of hostile lines in random order, against loops."""
    r = random.Random(seed)
    made = [(i, t) for i, t in DOCS] if seed == 0 else []
    made += [(1000 + i, r.choice(["\n", "\n", "\r\n"]).join(r.choice([*LINES, text(12) + "."]) for _ in range(r.randint(0, 12)))) for i in range(120)] + [(2000 + i, x) for i, x in enumerate(LINES)]
    rows = line_quality.clean_lines(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(x) for x in rows), key=repr) == sorted(((i, *cleaned(t)) for i, t in made), key=repr)
    assert line_quality.clean_lines(none).count() == 0
    bare = line_quality.clean_lines(docs, keep_text=False)
    assert bare.where("clean_text is not null").count() == 0 and bare.count() == len(DOCS)


def test_line_rules():
    want = {"Home | News | About | Help": "navigation", "Skip to main content": "menu", "TOUS DROITS RÉSERVÉS.": "boilerplate", "call rights reserved.": "", "A fine line of words.": "", "no end to this line": "punctuation", "x### y*** z$$$": "symbols", "BUY!! NOW!! YES!!": "shouting"}
    assert {x: line_fails(x) for x in want} == want
    own = [f"own{i}" for i in range(130)]
    late = [*own[:20], *(w for i in range(110) for w in ("buy", own[20 + i])), *["buy"] * 60]
    assert [line_fails(" ".join(w) + ".") for w in (late, late[::-1])] == ["sameness", "sameness"]  # all of the line counts


HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "</turn", "</turn\\\\>", "\\\\### a\\", ": ", "", "a\nb", "<", "### ", "é</turn>"]


def test_chat(spark):
    rows = [(c, t, R.choice(["user", "assistant", "a: b", "### x", None]), R.choice([*HARD, None])) for c in range(40) for t in range(R.randint(1, 6))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (None, 0, "user", "x")]
    out = chat_format.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int"))
    for r in out.collect():
        own = sorted((t, a or "", b or "") for c, t, a, b in rows if c == r.conv_id)
        assert r.round_trip and [tuple(x) for x in r.turns] == [x[1:] for x in own] and r.n_turns == len(own)
        masked = [re.sub(r"\\(\\*)### ", r"\1### ", re.sub(r"</turn(\\*)\\>", r"</turn\1>", r.formatted[m["from"] : m["to"]])) for m in r.loss]
        assert masked == [b for _, a, b in own if a == "assistant"]
    for r in chat_format.digest(out).collect():
        own = sorted((t, a or "", b or "") for c, t, a, b in rows if c == r.conv_id)
        said = "".join(b for _, a, b in own if a == "assistant")
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()


@pytest.mark.parametrize("block, query_block", [(16, 3), (16, 8192), (8192, 3), (8192, 8192)])
def test_top_k(spark, block, query_block):
    """Against all products: ties, copies, zeros, rows that share a vec_id, two dimensions, null and odd parts."""
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.integers(-4, 5, 6)]) for i in range(90)] + [(200 + i, [1.0] * 6) for i in range(40)] + [(7000, [0.0] * 6), (7020, None), (7040, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    rows += [(20, [9.0] * 6), (20, [9.0] * 6), (40, [2.0, 1.0]), (61, [1.0, 1.0]), (62, [3.0, -1.0]), (80, [])] + [(300 + i, [float(x) for x in 50 * g.integers(0, 2, 6)]) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({c: F.lit(7) for c in ("row", "block", "dim", "floor")})
    got = topk_search.exact_top_k(docs, F.col("vec_id") % 20 == 0, k=5, block=block, query_block=query_block).collect()
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and not np.isnan(v).any()]
    want = []
    for n, (q, a) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted(((int(a @ b), i) for m, (i, b) in enumerate(fine) if m != n and len(a) == len(b)), key=lambda x: (-x[0], x[1]))
            want += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.exact_top_k(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k_search_of_many(spread):
    """Thousands of clustered vectors, of like and of unlike length, so that both ways of pruning are taken."""
    g = np.random.default_rng(9)
    middle = g.normal(size=(8, 32))
    x = np.floor(64 * (middle[g.integers(0, 8, 5000)] + 0.15 * g.normal(size=(5000, 32))) * np.exp(spread * g.normal(size=(5000, 1))))
    own = np.arange(0, 5000, 50)
    a, b, score = topk_search.search(own, x[own], np.full(len(own), -np.inf), np.arange(5000), np.arange(5000), x, 20, bucket=256)
    for n, q in enumerate(own):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(5000), -s)) if i != q][:20]
        assert b[a == n].tolist() == want and score[a == n].tolist() == s[want].astype(int).tolist()


def test_mixing(docs, none):
    rows = mixing.mixed(docs).toPandas()
    sizes = {None if s != s else s: n for s, n in rows.groupby("source", dropna=False)["size"].sum().items()}
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    for s, t, size, copies in zip(rows.source, rows.target, rows.source_size, rows.copies):
        assert t == pytest.approx(target[None if s != s else s]) and copies in (int(t // max(size, 1)), int(t // max(size, 1)) + 1) and copies <= 2
    assert mixing.emitted(docs).count() == rows.copies.sum() and mixing.mixed(none).count() == 0


def test_ordinal_fit_is_a_minimum():
    """The loss, written out for each row, is no lower beside the fitted weights and thresholds."""
    import math

    g = np.random.default_rng(3)
    n, dims = 240, 16
    grade = g.integers(0, 3, n)
    places = [np.array(sorted({int(grade[i]) * 5 if g.random() < 0.8 else int(g.integers(0, 16)), int(g.integers(0, 16))})) for i in range(n)]
    shares = g.normal(size=(n, ordinal_quality.N_SHARES)) + grade[:, None] * np.linspace(0, 0.6, ordinal_quality.N_SHARES)
    m = ordinal_quality.fit(grade, places, shares, dims, rounds=1500, screen=0.0)
    dense = (shares - m.middle) / m.spread
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def loss(words, own, t):
        total = 0.0
        for i in range(n):
            score = sum(words[p] for p in places[i]) + float(dense[i] @ own)
            below = [0.0, *(sigmoid(x - score) for x in t), 1.0]
            total -= math.log(below[grade[i] + 1] - below[grade[i]])
        return total / n + 0.5 * 0.5 * (float(words @ words) + float(own @ own)) / n

    words, best = m.words.astype(float), None
    best = loss(words, m.shares, m.thresholds)
    for _ in range(40):
        a, b, c = g.normal(size=dims), g.normal(size=len(m.shares)), g.normal(size=2)
        for step in (0.02, -0.02):
            assert loss(words + step * a, m.shares + step * b, m.thresholds + step * c) >= best - 1e-5
    score = m.score(np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate(places), shares)
    tails = m.tails(score)
    assert (tails[:, 0] > tails[:, 1]).all() and m.thresholds[0] < m.thresholds[1]


def test_ordinal(spark, none):
    r = random.Random(2)
    made = []
    for i in range(500):
        t, g = text(r.randint(20, 60)), r.choice([0, 1, 2])
        w = t.split()
        if g == 0:
            w[r.randrange(len(w))] = "vile"
        t = " ".join(x + "###" for x in w) if g == 1 else " ".join(w)
        made.append((i, t, g))
    docs = spark.createDataFrame([x[:2] for x in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if g == 1 else 1, int(g == 0)) for i, _, g in made[:350]], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(docs, labels)
    got = {x.doc_id: x for x in ordinal_quality.grade(docs, model).collect()}
    right = sum(got[i].selected == (g == 2) for i, _, g in made[350:])
    assert right >= 0.95 * 150 and all(0 <= x.p_good <= x.p_poor <= 1 and abs(x.expected_grade - x.p_good - x.p_poor) < 1e-9 for x in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "words of no label")], "doc_id long, text string")
    assert ordinal_quality.grade(odd, model).where("selected").where("doc_id is not null").count() == 0
    assert ordinal_quality.select(none, model).count() == 0
    blank = ordinal_quality.train(none, labels.limit(0))
    assert ordinal_quality.grade(odd, blank).count() == 3


def test_ordinal_labels_beyond_the_documents(spark):
    """Labels of documents that are not there take no places of the sample."""
    docs = spark.createDataFrame([(i, " ".join(f"g{j % 5}" if i % 2 else f"b{j % 7}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    few, all_ = ordinal_quality.train(docs, labels, sample=60), ordinal_quality.train(docs, labels)
    assert (few.words == all_.words).all() and few.words.any()
    graded = ordinal_quality.grade(docs, few).collect()
    assert all(r.selected == (r.doc_id % 2 == 1) for r in graded)
