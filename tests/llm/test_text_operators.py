"""Decontamination, secrets, language, toxicity and line deduplication against brute force and edge cases."""

import hashlib
import re

import numpy as np
import pytest
from compare import same

from cyclarium.llm import decontaminate, language_id, line_dedup, registry, secret_scan, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window=10):
    own, found, hit = words(text), set(), set()
    for item, words_ in items:
        n = min(window, len(words_))
        for k in range(len(words_) - n + 1) if n else ():
            for i in range(len(own) - n + 1):
                if own[i : i + n] == words_[k : k + n]:
                    found.add(item)
                    hit |= set(range(i, i + n))
    return len(own), len(hit), sorted(map(str, found))


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "x Y z"), (3, None), (4, ""), (5, "c d e f g h i j k l m n"), (2, "solo"), (None, "p q r"), (7, "a b a b a b a b a b a b a b")]
TEXTS = [None, "", "A b,c d e f g h i j K l m", "x y z x y z", "x y", "solo solo", "p q r", "a b a b a b a b a b", "b a b a b a b a b a", "é " * 50 + "X, Y... Z", "q " * 20000 + "a b c d e f g h i j", "a b c d e f g h i"]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination(spark, limit):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "x y z", "clash")], "doc_id bigint, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    listed = [(i, words(t)) for i, t in ITEMS if i is not None]
    got = {}
    for r in decontaminate.scan(docs, items, shard_bytes=limit).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, sum(s.word_stop - s.word for s in r.spans), sorted(map(str, r["items"]))))
    for i, t in enumerate(TEXTS):
        assert brute_hits(t, listed) in got[i], t
    assert len(got[0]) == 2


def test_removal(spark):
    docs = spark.createDataFrame([(1, "keep this, A b c d e f g h i j k; and that", "en", "s", 1), (2, "a b c d e f g h i j", "en", "s", 1), (3, None, None, None, None), (4, "a b c d e a b c d e f g h i j k l f g h i j k and many other words that follow here", "en", "s", 1)], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = {r.doc_id: r for r in decontaminate.remove(docs, items).collect()}
    assert out[1].text == "keep this, ; and that" and out[1].n_chars == len(out[1].text)
    assert 2 not in out and out[3].text is None
    assert brute_hits(out[4].text, [(i, words(t)) for i, t in ITEMS if i])[1] == 0
    assert decontaminate.remove(docs.limit(0), items).count() == 0
    assert decontaminate.remove(docs, items.limit(0)).count() == 4


def brute_removal(text, items, most=0.8, window=10):
    """What stays of the text, or nothing at all, and the number of rounds."""
    for turn in range(100):
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        own, hit = words(text), set()
        for words_ in items:
            n = min(window, len(words_))
            for k in range(len(words_) - n + 1) if n else ():
                hit |= {j for i in range(len(own) - n + 1) if own[i : i + n] == words_[k : k + n] for j in range(i, i + n)}
        if not hit:
            return text
        if not turn and len(hit) > most * len(own):
            return None
        runs = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i for i in sorted(hit) if i + 1 not in hit]
        for i, j in reversed(list(zip(runs, ends))):
            text = text[: places[i][0]] + text[places[j][1] :]


def test_removal_does_not_depend_on_shards(spark):
    listed = [(1, "a b c d e f g h i j k l"), (2, "x Y z"), (3, "p q r s t"), (4, "m n o"), (5, "u v w p"), (6, "k1 k2 k3 k4 k5 k6 k7 k8 k9"), (7, "l1 l2 l3 l4 l5 l6 l7 l8"), (8, None)]
    texts = ["k1 k2 k3 k4 k5 k6 k7 k8 k9, l1 l2 l3 l4 l5 l6 l7 l8. and two more", "p q x y z r s t, stays", "x m n o y z stays", "x p q m n o r s t y z stays", "x y z, m n o; p q r s t stays here with some other words", "u v x y z w p q r s t: é stays with others", None, "", "a b c d e x y z f g h i j k l and more words to keep it from going away"]
    texts += ["k1 k2 k3 k4 k5 k6 k7 k8 k9 and l1 l2 l3 l4 l5 l6 l7 l8 other words are here too, enough of them", "nothing at all"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame(listed, "item_id bigint, text string")
    assert len(decontaminate.shards(items, "item_id", "text", 40)) > 2
    want = {i: brute_removal(t, [words(x) for _, x in listed]) for i, t in enumerate(texts) if t}
    want = {i: t for i, t in want.items() if t is not None} | {6: None, 7: ""}
    assert 0 not in want and want[1] == ", stays"
    for limit in (1 << 20, 40, 15):
        out = decontaminate.remove(docs, items, shard_bytes=limit).collect()
        assert {r.doc_id: r.text for r in out} == want and len(out) == len(want), limit
        assert all(r.n_chars == len(r.text) for r in out if r.text is not None)


def test_decontamination_query(spark, sf_dir):
    bench = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    window = {}
    for item, own in bench:
        n = min(10, len(own))
        for k in range(len(own) - n + 1):
            window.setdefault(tuple(own[k : k + n]), set()).add(item)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.queries()["op1_decontaminate"](spark, sf_dir).collect():
        own, hit, found = words(texts[r.doc_id]), set(), set()
        for n in {len(k) for k in window}:
            for i in range(len(own) - n + 1):
                if owners := window.get(tuple(own[i : i + n])):
                    found |= owners
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(own), len(hit), len(found), digest, bool(hit))


def test_secrets_follow_the_patterns(spark, sf_dir):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts |= {-1: "", -2: "é API_KEY = 'abcdef' token:12345 AKIA" + "A1" * 8 + " " + "deadbeef" * 4, -3: "x" * 100000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in secret_scan.scan(docs).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = list(secret_scan.KINDS)
        assert [(f.start, kinds.index(f.kind), f.stop) for f in r.findings if f.kind != "random"] == sorted(base)


def test_secrets_battery():
    import base64
    import random

    random.seed(3)
    plain = "the quick brown foxes were jumping over many lazy dogs and internationalisation misunderstandings " * 5
    hits = sum(any(k == 3 for _, k, _, _ in secret_scan.find(plain + base64.b64encode(random.randbytes(30)).decode() + " end")) for _ in range(50))
    assert hits >= 40
    assert secret_scan.find(plain) == []
    assert secret_scan.find(None) == [] and secret_scan.find("z" * 500) == []
    p = secret_scan.battery([random.randrange(16) for _ in range(200)], 16)
    assert min(p) > 1e-4
    assert min(secret_scan.battery([0, 1] * 100, 16)) < 1e-6


@pytest.mark.parametrize("before", ["AWS_KEY=", "id=", "host/my-app/", "https_//host/my-app?sig=", "a_b=c/d-e/f="])
@pytest.mark.parametrize("after", ["", "=", "==&x=1"])
def test_secrets_behind_names_and_paths(before, after):
    import random

    random.seed(5)
    plain = "the quick brown foxes were jumping over many lazy dogs and internationalisation misunderstandings " * 5
    hits = 0
    for _ in range(30):
        secret = "".join(random.choices(secret_scan.ALPHABETS["base62"], k=40))
        found = [(a, b) for a, k, b, _ in secret_scan.find(plain + before + secret + after + " end") if k == 3]
        assert found == sorted(found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        at = len(plain + before)
        hits += (at, at + 40) in found
    assert hits >= 24


def test_secret_parts():
    longer, other = "aB3" * 10, "Zy9" * 8
    cut = lambda t: [t[a:b] for a, b, _ in secret_scan.parts(t, 0, len(t))]
    assert cut(longer) == cut(longer + "==") == cut("K=" + longer) == [longer]
    assert cut(longer + "=" + other) == [longer, other]
    assert cut("my-app/" + longer + "/x") == ["app/" + longer + "/x", longer]
    assert cut("1" * 30) == cut("a=b") == []
    assert secret_scan.find("deadbeef" * 4 + "=" + "é") == [(0, 2, 32, "")]


def test_redact(spark):
    docs = spark.createDataFrame([(1, "my token = abcdef123 and " + "0f" * 20 + "!"), (2, None), (3, "fine")], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert out == {1: "my [SECRET] and [SECRET]!", 2: None, 3: "fine"}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = registry.queries()["op8_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! \n"), (4, "é" * 200000), (5, "THE AND")], "doc_id bigint, text string")
    model = language_id.train(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] in truth.values()
    empty = language_id.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}


def test_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grades = toxicity.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.train(docs, grades)
    assert (np.diff(model.thresholds) > 0).all() and (model.weights >= 0).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 100000), (3, "a")], "doc_id bigint, text string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(abs(sum(r.p_grades) - 1) < 1e-9 and 0 <= r.severity <= 2 for r in rows)
    assert toxicity.train(docs, grades.limit(0)) is None
    assert toxicity.score(odd, None).where("severity is null").count() == 4


def test_ordinal_model_learns():
    rng = np.random.default_rng(0)
    grades, rows = [], []
    for i in range(900):
        g = i % 3
        rows.append(np.unique(np.concatenate([rng.integers(10, 500, 20), [1] * (g > 0), [2] * (g > 1)])).astype(np.int64))
        grades.append(g)
    model = toxicity.fit(rows, grades, 3, epochs=4)
    severity = [model.exceed(np.array([model.weights[r].sum()]))[0].sum() for r in rows]
    means = [np.mean([s for s, g in zip(severity, grades) if g == k]) for k in range(3)]
    assert means[0] < 0.5 < means[1] < 1.6 < means[2] + 0.3 and means[2] > means[1]


def test_line_dedup(spark, sf_dir):
    assert same(registry.queries()["op5_line_dedup"](spark, sf_dir), line_dedup.ORACLE_SQL, sf_dir)
    rows = [(i, "foot\nown %d\n\nfoot" % i, "h", "en") for i in range(10)] + [(20, None, "h", "x"), (21, "", "h", "x"), (22, "foot", None, "x"), (23, "foot", "other", "x"), (5, "foot", "h", "again")]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines string")
    for limit in (100, -1):
        out = line_dedup.clean(pages, broadcast_rows=limit).collect()
        got = {}
        for r in out:
            got.setdefault(r.doc_id, []).append((r.text, r.n_dropped))
        assert len(out) == len(rows)
        assert ("own 3\n", 2) in got[3] and ("", 1) in got[5]
        assert got[20] == [(None, 0)] and got[21] == [("", 0)] and got[22] == [("foot", 0)] and got[23] == [("foot", 0)]
    assert line_dedup.clean(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    import corpus_pipeline

    copy = "this page was copied\nwith all of its words again and again\nfoot"
    rows = [(i, copy if i < 10 else f"page {i} stands alone\nand says {i * i}\nfoot", "en", "s", 0) for i in range(30)]
    rows += [(40 + i, "three of a kind here", "en", "small", 0) for i in range(3)] + [(50, None, "en", "small", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, ""), "").collect()}
    assert out[0] == copy.removesuffix("\nfoot") and out[40] == "three of a kind here" and out[50] is None
    assert out.keys() == {0, *range(10, 30), 40, 50}
    assert all(out[i] == f"page {i} stands alone\nand says {i * i}" for i in range(10, 30))
    counted = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert counted[0] == counted[40] == ""
