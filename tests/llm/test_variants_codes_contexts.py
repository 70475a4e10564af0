"""Spelling variants, vector codes and personal data against SQL and plain loops, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from cyclarium.llm import _common, personal_data, spelling, vector_codes

# ---- spelling variants ----

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def told_variants(rows, noise=None, least=5, ratio=5):
    """Rows of the operator by loops over all pairs."""
    n = collections.Counter()
    for i, text in rows:
        for m in RUN.finditer(text or ""):
            word = m[0].translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= ratio * n[w] else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    out = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_variants_query(spark, sf_dir):
    assert same(spelling.query(spark, sf_dir), spelling.ORACLE_SQL, sf_dir)


def mutated(rng, word):
    at, c = rng.randrange(len(word)), rng.choice("abeé×Ààÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])


@pytest.mark.parametrize("noise", [None, 7])
def test_variants_by_loops(spark, noise):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 9))) for _ in range(12)]
    words += [mutated(rng, w) for w in words for _ in range(6)]
    words += [mutated(rng, w) for w in words[12:40]]
    text = [w for w in words for _ in range(rng.choice([1, 2, 5, 30, 160]))]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::25]).upper() if i % 9 == 0 else " ".join(text[i::25])) for i in range(25)]
    rows += [rows[3], (None, "abcdef, Abcdef; ABCDEF abcdef\x00abcdef"), (40, None), (41, ""), (42, "9 你好 !")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(0)})
    got = rows_of(spelling.variants(df, noise=noise))
    assert got == told_variants(rows, noise)
    assert any(f for _, f, *_ in got) and any(r not in (w, f) for w, f, r, *_ in got)


def test_variants_of_pieces(spark):
    """Pieces of texts end between words, also where a single word is longer than a piece."""
    rows = [(1, "einsam zweisam " * 400), (2, "ü" * 3000 + " einsam"), (3, None), (4, "zweisam"), (5, "你" * 2000 + " einsam einsamm")]
    df = spark.createDataFrame(rows * 5, "doc_id long, text string").coalesce(1)
    for piece in (64, 1000, 1 << 22):
        got = {tuple(r) for r in spelling.vocabulary(df, piece=piece, noise=5).collect()}
        assert got == {(w, n) for w, _, _, n, *_ in told_variants(rows * 5, 5)}


def test_variants_checksums():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 200, 50)
    data = rng.integers(0, 256, int(length.sum()), dtype=np.uint8)
    first = np.cumsum(length) - length
    got = spelling.checksums(data, first, length, np.full(50, zlib.crc32(b"12:"), np.uint32))
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes(), zlib.crc32(b"12:")) for a, n in zip(first, length)]


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_chains_of_forms(spark):
    """Each word's form is the next one; roots are found whatever the number of steps."""
    words = [("abcdef" + "x" * i, 5 * 5**i) for i in range(11)]
    got = rows_of(spelling.group(spark.createDataFrame(words, "word string, n long")))
    assert {r[2] for r in got} == {words[-1][0]} and {r[1] for r in got} == {w for w, _ in words[1:]} | {None}


def test_variants_are_joined_by_shuffles(spark, monkeypatch):
    """Sizes of files say little about rows made of words, so no side is sent through the driver however small it seems."""
    plans = []

    def noted(df, *args, **kwargs):
        if "n_near" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _common.cut(df, *args, **kwargs)

    monkeypatch.setattr(spelling, "cut", noted)
    words = [("abcdef" + "x" * i, 5 * 5**i) for i in range(4)]
    assert {r[2] for r in rows_of(spelling.group(spark.createDataFrame(words, "word string, n long")))} == {words[-1][0]}
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


# ---- vector codes ----


def told_codes(rows, entries=256, parts=4, rounds=4):
    """Codes, errors and codebooks by loops in Python's whole numbers."""
    kept = sorted((i, [int(np.floor(x * 1024)) for x in v], label) for i, v, label in rows)
    cutup = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, v, _ in kept]
    books = [[cutup[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for x in cutup:
                own[near(x[p], p)].append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if own[e] else books[p][e] for e in range(len(books[p]))]
    total, out = collections.Counter(), []
    for (i, _, label), x in zip(kept, cutup):
        at = [near(x[p], p) for p in range(parts)]
        error = sum(far(x[p], books[p][at[p]]) for p in range(parts))
        total[label] += error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    return {(i, code, error, total[label]) for i, code, error, label in out}, books


def test_codes_query(spark, sf_dir):
    assert same(vector_codes.query(spark, sf_dir), vector_codes.ORACLE_SQL, sf_dir)


def test_codes_by_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(1)], int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [(100 + i, rows[i % 7][1], None) for i in range(20)]
    bad = [(200, None, 1), (201, [], 1), (202, [0.5] * 7 + [float("nan")], 1), (203, [0.5] * 7 + [None], 1), (204, [float("-inf")] * 8, 1), (205, [0.5] * 7, 1), (206, [0.5] * 12, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "error": F.lit(2), "n": F.lit(3), "code": F.lit("x")}).repartition(5)
    for entries in (256, 9):
        coded, own = vector_codes.compress(df, entries=entries)
        want, books = told_codes([(i, np.float32(v), x) for i, v, x in rows], entries)
        assert {tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()} == want
        assert own.tolist() == books
        assert vector_codes.digest(own) == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    back = {r.vec_id: r.vector for r in vector_codes.decode(coded, own).collect()}
    for i, code, error, _ in want:
        whole = np.floor(np.float64(np.float32(dict((a, b) for a, b, _ in rows)[i])) * 1024)
        assert ((np.array(back[i]) * 1024 - whole) ** 2).sum() == error


def test_codes_of_large_and_odd_numbers(spark):
    """Distances of numbers that don't fit are those of the largest that do; rows without ids come last."""
    rows = [(1, [3e38, -3e38, 0.0, 1.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (0, [1.0, 2.0, 3.0, 5.0], 1), (0, [1.0, 2.0, 3.0, 4.0], 1)]
    coded, own = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=3)
    assert own.shape == (4, 3, 1) and own[3, :, 0].tolist() == [4096, 5120, 1024]
    assert sorted((r.vec_id is None, r.error) for r in coded.collect()) == [(False, 0), (False, 0), (False, 0), (True, 0)]
    x = np.array([[2**27, -(2**27)] * 32])
    at, far = vector_codes.nearest(x, -x)
    assert far.tolist() == [64 * 2**56]


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, own = vector_codes.compress(empty)
    assert coded.count() == 0 and own.size == 0 and coded.columns == ["vec_id", "code", "error", "label_error"]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], empty.schema))[0].count() == 0


# ---- personal data ----

PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(x):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(x)):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and plain_luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]
    return sorted((m.start(), k, m.end()) for k, (p, fit) in enumerate(zip(PATTERNS, fits)) for m in p.finditer(text or "") if fit(m[0]))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    card = "4111 1111 1111 1111"
    units = ["a@b.c", "x.y@z", "@", ".", "-", " ", "+", "1", "12", "255", "256", "0001", "(555)", "+1 (555) 555-1234", card, card.replace(" ", ""), "1.2.3.4", "%", "_", "é", "x", "\n", "A1", "mail@host.example.com"]
    for _ in range(6000):
        text = "".join(rng.choice(units) for _ in range(rng.randrange(1, 14)))
        assert personal_data.base_spans(text) == plain_base(text), text


def test_long_texts_take_time_in_proportion():
    for unit in ("a", "1", "1.", "1 ", "+1", "a@", "@a", "@", "a.", "+1 ", "(", "1-", "é"):
        text = unit * (300_000 // len(unit))
        spans = personal_data.base_spans(text)
        assert all(a < b for a, _, b in spans)
        more = personal_data.candidates(text, spans)
        personal_data.contexts(text, more)


def plain_tokens(text):
    """(first, hash stand-in) of each token by a pattern."""
    return [(m.start(), "0" if m[0][0] in "0123456789" else re.sub("[A-Z]", lambda x: x[0].lower(), m[0])) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^\x00-\x20]", text)]


def plain_extract(rows, support=3, confidence=0.5, rounds=4):
    """The bootstrap by loops, with contexts as tuples of tokens."""
    edges, total, slots = collections.Counter(), collections.Counter(), []
    for i, text in enumerate(rows):
        text = text or ""
        first = plain_tokens(text)
        words = tuple(w for _, w in first)
        for o in (2, 3):
            total.update(words[j : j + o] for j in range(len(words) - o + 1))
        base = plain_base(text)
        spans = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in personal_data.candidates(text, base)]
        for a, b, seed in spans:
            before, behind = sum(x < a for x, _ in first), sum(x < b for x, _ in first)
            own = [(0, words[before - o : before]) for o in (2, 3) if before >= o] + [(1, words[behind : behind + o]) for o in (2, 3) if behind + o <= len(words)]
            kind = next((k for x, k, y in base if (x, y) == (a, b)), None) if seed else "other"
            name = (kind, "".join(c for c in text[a:b].lower() if c.isalnum() or c == "@"))
            for p in own:
                edges[p, name] += 1
                if not seed:
                    slots.append((i, a, b, p))
    score, trusted = {}, {}
    of = collections.defaultdict(list)
    for (p, name), n in edges.items():
        of[p].append((name, n))
    for _ in range(rounds):
        trusted = {}
        for p, held in of.items():
            if len(held) < support:
                continue
            s = {name: 1.0 if name[0] != "other" else score.get(name, 0.0) for name, _ in held}
            good, unknown, n = sum(k * s[x] for x, k in held), sum(k * (1 - s[x]) for x, k in held), sum(k for _, k in held)
            c = good / (good + 0.1 * unknown + max(total[p[1]] - n, 0) + 1)
            if sum(v >= confidence for v in s.values()) >= support and c >= confidence:
                trusted[p] = c
        score = {}
        for (p, name), _ in edges.items():
            if p in trusted and name[0] == "other":
                score[name] = 1 - (1 - score.get(name, 0.0)) * (1 - trusted[p])
    return {(i, a, b) for i, a, b, p in slots if p in trusted}


def corpus():
    """Seeds and unknown identifiers in shared contexts, contexts that hold anything, and clean texts."""
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice("the of thtion été and hehe".split()) for _ in range(n))
    out, local = [], [f"{rng.randrange(100, 999)}-555-{rng.randrange(1000, 9999)}" for _ in range(9)]
    for i in range(120):
        phone = rng.choice([f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", rng.choice(local)])
        account = rng.choice([f"AC{rng.randrange(10**7, 10**8)}", rng.choice(local)])
        out.append([f"{fill(5)} Please call me at {phone} today. {fill(4)}", f"{fill(3)} my account number is {account} thanks {fill(2)}", f"{fill(6)} in the year {rng.randrange(10000, 99999)} {fill(3)}", f"Call me at home. {fill(8)}"][i % 4])
    return [*out, None, "", "a", out[0], out[0], "x 12345"]


def findings(df):
    return {(r.doc_id, f.start, f.stop) for r in df.collect() for f in r.findings if f.kind == "context"}


def test_contexts_find_what_no_pattern_does(spark):
    rows = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"row": F.lit(1), "base": F.lit(2), "pattern": F.lit("x"), "id": F.lit(3)})
    got = findings(personal_data.extract(df))
    assert got == plain_extract(rows)
    texts = {i: t for i, t in enumerate(rows)}
    assert any(texts[i][a:b].startswith("AC") for i, a, b in got) and any("555" in texts[i][a:b] for i, a, b in got)
    assert not any("year" in texts[i] or "home" in texts[i] for i, _, _ in got)


def test_personal_data_query(spark, sf_dir):
    got = {r.doc_id: r for r in personal_data.query(spark, sf_dir).collect()}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == rows.keys()
    order = sorted(rows)
    extra = {}
    for i, a, b in plain_extract([rows[i] for i in order]):
        extra.setdefault(order[i], []).append((a, 4, b))
    for i, text in rows.items():
        base = plain_base(text)
        name = lambda spans: ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)  # noqa: B023, E731
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS[:4]] == [sum(x[1] == k for x in base) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert got[i].spans == name(sorted(base + extra.get(i, [])))


def test_tokens_of_pieces():
    """The tokens counted in pieces are those of the whole text, and of texts by themselves."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "é", "12", " ", ", ", "x", "\n"]) for _ in range(n)) for n in (0, 1, 400, 3, 0, 900)]
    want = collections.Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        hashed = personal_data.tokens(data, np.array([0, len(data)]))[1]
        for o in personal_data.ORDERS:
            want.update(personal_data.grams(hashed, o).tolist())
        assert len(hashed) == len(plain_tokens(t))
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for piece in (1, 7, 50, 10_000):
        assert collections.Counter(itertools.chain.from_iterable(x.tolist() for x in personal_data.all_grams(data, ends, piece))) == want
        spans = [(m.start(), m.end()) for m in re.finditer("12", texts[5])]
        assert personal_data.contexts(texts[5], spans, piece) == personal_data.contexts(texts[5], spans)


def test_personal_data_of_nothing(spark):
    assert personal_data.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = personal_data.extract(spark.createDataFrame([(None, "a@b.c"), (1, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted(len(r.findings) for r in got) == [0, 0, 1]


def test_cuts():
    within = np.array([1, 1, 0, 1, 1, 1, 1, 1, 0, 1], bool)
    assert _common.cuts_between(within, np.array([0, 10]), 3) == [0, 8, 10]
    assert _common.cuts_between(within, np.array([0, 2, 10]), 3) == [0, 2, 8, 10]
    assert _common.cuts_between(within, np.array([0, 10]), 10) == [0, 10]
    assert _common.cuts_between(within[:0], np.array([0]), 3) == [0]


def test_personal_data_writes_what_it_reads(spark, monkeypatch):
    """Each table but the result is read again; texts are read in short batches, and the session's own number is back afterwards."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before, made = spark.conf.get(key), []

    def noted(df, *args, **kwargs):
        made.append((df.columns, spark.conf.get(key)))
        return _common.cut(df, *args, **kwargs)

    monkeypatch.setattr(personal_data, "cut", noted)
    assert personal_data.extract(spark.createDataFrame([(1, "mail a@b.c")], "doc_id long, text string"), rounds=2).count() == 1
    assert [c for c, _ in made].count(["inst", "score"]) == 1 and [c for c, _ in made].count(["pattern", "confidence"]) == 2
    assert {rows for _, rows in made} == {str(_common.READ_ROWS)} and spark.conf.get(key) == before
