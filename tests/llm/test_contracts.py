"""Query results against plain loops on the test tables, and edge cases that all operators share."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cyclarium.llm import _common, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, packing, registry, secret_scan, toxicity, url_filter, warc

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def counted(text):
    """N-gram slots and counts by loops."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    x = [ord(c) for c in f" {' '.join(words)} "] if words else []
    out = {}
    for n in range(1, language_id.ORDER + 1):
        for i in range(1 if n == 1 else 0, len(x) - max(n - 1, 1) if n == 1 else len(x) - n + 1):
            code = 0
            for c in x[i : i + n]:
                code = (code * 0x110000 + c) & MASK
            slot = mix((code + (n - 1 << 60)) & MASK) >> 50
            out[slot] = out.get(slot, 0) + 1
    return out


def plain_language(model, text):
    """The most probable label by loops."""
    own = counted(text)
    if not own or not model.classes:
        return "und", 0.0
    value = {s: (1 + math.log(k)) * model.idf[s] for s, k in own.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    z = [(sum(v / norm * model.weights[s, c] for s, v in value.items()) + model.bias[c]) / model.temperature for c in range(len(model.classes))]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(z)), key=lambda c: (e[c], -c))
    return model.classes[best], e[best] / sum(e)


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language_id.train(docs.where(~language_id.held_out()))
    known = [r for r in docs.where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    df, n = np.zeros(language_id.DIM), 0
    for r in known:
        own = list(counted(r.text))
        df[own] += 1
        n += bool(own)
    np.testing.assert_allclose(model.idf, np.log((1 + n) / (1 + df)) + 1)
    for r in registry.queries()["op8_language_id"](spark, sf_dir).collect():
        label, score = plain_language(model, texts[r.doc_id])
        assert (r.held_out, r.lang_pred) == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2, label) and r.score == pytest.approx(score, abs=1e-9)


def test_leader_by_coordinates():
    """Each coordinate's weight follows from its own sums alone."""
    rng, idf = np.random.default_rng(2), np.ones(language_id.DIM)
    rows = [(s := np.unique(rng.integers(0, 40, 6)), rng.integers(1, 4, len(s)), "xyz"[i % 3]) for i in range(45)]
    model = language_id.fit(rows, idf, alpha=0.3, l1=0.01, l2=0.1, epochs=2, seed=7)
    order = np.random.default_rng(7).permutation(45)[9:]
    z, n = {}, {}

    def weight(j, c):
        a, b = z.get((j, c), 0.0), n.get((j, c), 0.0)
        return 0.0 if abs(a) <= 0.01 else -(a - math.copysign(0.01, a)) / ((1 + math.sqrt(b)) / 0.3 + 0.1)

    for _ in range(2):
        for i in order:
            slots, counts, label = rows[i]
            x = [(1 + math.log(k)) for k in counts]
            norm = math.sqrt(sum(v * v for v in x))
            own = {int(s): v / norm for s, v in zip(slots, x)} | {language_id.DIM: 1.0}
            w = {(j, c): weight(j, c) for j in own for c in range(3)}
            score = [sum(v * w[j, c] for j, v in own.items()) for c in range(3)]
            e = [math.exp(s - max(score)) for s in score]
            for j, v in own.items():
                for c in range(3):
                    g = v * (e[c] / sum(e) - ("xyz"[c] == label))
                    old = n.get((j, c), 0.0)
                    z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.3 * w[j, c]
                    n[j, c] = old + g * g
    for j in range(40):
        for c in range(3):
            assert model.weights[j, c] == pytest.approx(weight(j, c), abs=1e-9)
    assert model.bias.tolist() == pytest.approx([weight(language_id.DIM, c) for c in range(3)], abs=1e-9)


def test_toxicity_query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, toxicity.grades_of(labels))
    read = toxicity.Features()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.queries()["op2_toxicity"](spark, sf_dir).collect():
        raw = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        total = sum(model.weights[s] for s in {int(s) for s in read(raw, np.array([0, len(raw)]))[1]})
        above = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        p = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r.severity == pytest.approx(sum(k * x for k, x in enumerate(p))) and r.p_toxic == pytest.approx(above[0])
        assert r.grade == p.index(max(p)) and r.toxic == (r.p_toxic >= model.cut)


def test_ordinal_gradients():
    """A step down the likelihood's gradient, taken by differences, is what fit() takes."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, 4)) for _ in range(60)]
    grades = [int(rng.integers(0, 3)) for _ in rows]
    loss = lambda m: -sum(math.log(max(p, 1e-12)) for r, g in zip(rows, grades) for e in [m.exceed(np.array([m.weights[r].sum()]))[0]] for p in [([1, *e][g] - [*e, 0][g])])
    losses = [loss(toxicity.fit(rows, grades, 3, epochs=e, l1=0.0, rate=0.05)) for e in (0, 1, 4, 16)]
    assert losses == sorted(losses, reverse=True)
    assert (np.diff(toxicity.fit(rows, grades, 3).thresholds) > 0).all()


def test_best_cut_by_trial():
    rng = np.random.default_rng(8)
    for _ in range(20):
        p, toxic = rng.integers(0, 6, 30) / 6, rng.random(30) < 0.4
        f1 = lambda c: 2 * (toxic & (p >= c)).sum() / ((p >= c).sum() + toxic.sum())
        assert f1(toxicity.best_cut(p, toxic)) == pytest.approx(max(f1(c) for c in set(p)))
    assert toxicity.best_cut(np.zeros(0), np.zeros(0, bool)) == toxicity.best_cut(np.ones(3), np.zeros(3, bool)) == toxicity.CUT


def test_several_labels_and_copies_of_an_id(spark):
    docs = spark.createDataFrame([("a", "bad bad words", 0), ("a", "other text", 1), ("b", "fine", 2)] * 9, "doc_id string, text string, grade int")
    grades = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0), (None, 1), ("b", None)], "doc_id string, grade int")
    one, two = (toxicity.train(df, grades) for df in (docs, docs.repartition(7)))
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


def test_secret_query(spark, sf_dir):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.queries()["op3_secret_scan"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in found) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == (said.split(",") if said else []) and sum(s.startswith("random") for s in spans) == r.n_random


def test_spans():
    spans = secret_scan.Spans([(5, 9), (1, 3), (3, 4), (8, 12)])
    assert (spans.starts, spans.stops) == ([1, 5], [4, 12])
    assert spans.meets(0, 2) and spans.meets(11, 20) and spans.meets(2, 3) and not spans.meets(4, 5) and not spans.meets(12, 13)
    spans.add(20, 22)
    assert spans.meets(21, 30) and not spans.meets(22, 30)


def test_many_secrets_in_one_text():
    text = " ".join(f"token=abcdef{i:06d}" for i in range(20000))
    assert len(secret_scan.find(text)) == 20000
    assert secret_scan.redacted(text, "*") == " ".join(["*"] * 20000)


def test_packing_query(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, by = registry.queries()["op6_packing"](spark, sf_dir).collect(), {}
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert len(by) * 1024 < 1.05 * sum(r.length for r in rows) + 1024


def test_ids_of_every_kind_of_character():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    encoder, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    for first in range(0, 0x30000, 16):
        text = "".join(f"a{c}b {c}{c} 1{c} .{c}\n{c} " for c in map(chr, range(first, first + 16)) if not 0xD800 <= ord(c) < 0xE000)
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("x <|endoftext|> y", " " * 3000, "ab" * 30000, "it's  I'LL\t\tdon't ", "١٢٣ 〇"):
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "\r\n", " \n\t", "\u2003", "a", "7", "!", "\u00e9", "\u3042"])
def test_ids_of_two_million_characters_in_a_row(unit):
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(1)
    run = "".join(rng.choice(unit) for _ in range(2_000_000)) if len(unit) > 1 else unit * 2_000_000
    text = f"before {run}after"
    assert (encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids)).all()


def test_very_long_blanks_are_packed(spark):
    rows = [(1, "x" + " " * 1_500_000), (2, "\n" * 1_500_000), (3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "length": F.lit(2), "block": F.lit("x")})
    got = packing.result(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.n == r.m for r in got)


def test_full_windows_need_no_group(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, "word " * 90000) for i in range(4)], "doc_id bigint, text string")
    rows = packing.windows(_common.cut(packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY))))
    full = [r for r in rows.collect() if r.length == 1024]
    assert len(full) > 300 and len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 and r.sequence_id % 2 for r in full)


def brute_links(ids, x, labels, threshold=0.98):
    """Number of links of each id, by all cosines."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    return {i: int(n) - 1 for i, n in zip(ids, near.sum(1))}


def test_vectors_query(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None and r.label is not None]
    want = brute_links([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64), [r.label for r in rows])
    got = {r.vec_id: r.n_links for r in registry.queries()["op10_embedding_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_recall_at_the_threshold(spark):
    """Planted neighbours of the tables' length, whose cosines lie just above the threshold and just below it."""
    rng = np.random.default_rng(12)
    n, dim = 1200, 64
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=(n, dim))
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(n) % 4 < 3, rng.uniform(0.98001, 0.983, n), rng.uniform(0.975, 0.97999, n))[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside]) * rng.uniform(0.5, 2, (2 * n, 1))
    labels = [i % n % 7 for i in range(2 * n)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels))], "vec_id bigint, embedding array<double>, label int")
    want = brute_links(range(2 * n), x, labels)
    got = {r.vec_id: r.n_links for r in embedding_dedup.deduplicate(df).collect()}
    assert sum(want.values()) >= 1500 and all(got[i] <= k for i, k in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_blocks_do_not_change_links(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=12)
    rows = [(i, [float(v) for v in base + rng.normal(0, 0.05, 12)], "x" if i % 9 else "y") for i in range(300)] + [(300 + i, [float(v) for v in base], "x") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    one, many = ({r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.deduplicate(df, block=b).collect()} for b in (1000, 7))
    assert one == many and max(n for n, _, _ in one.values()) > 40


def test_groups_of_any_size(spark):
    rows = [(i, 0 if i < 700 else i, i % 5) for i in range(1000)] + [(5, 0, 1), (None, 0, 2)]
    out = _common.with_least(spark.createDataFrame(rows, "id bigint, k bigint, salt int"), ["k"], "id").collect()
    assert len(out) == len(rows) and all((r.rep, r.size) == ((0, 702) if r.k == 0 else (r.id, 1)) for r in out)


CLASH = "doc_id bigint, text string, lang string, source string, _host string, _row string, _kept string, _drop string, n_lines bigint, score double, lang_pred string, id bigint, label string, slots string, spans string, again boolean, n_chars bigint"


def clashing(spark, n=12):
    rows = [(i, f"foot\nline {i} with more words in it to tell the language", "en", "s", "h", "r", "k", "d", 7, 7.5, "mine", 3, "l", "s", "p", True, 9) for i in range(n)]
    return spark.createDataFrame(rows, CLASH)


def test_columns_with_clashing_names_stay(spark):
    docs = clashing(spark)
    out = line_dedup.clean(docs, counts=())
    assert out.columns == docs.columns
    for limit in (100, -1):
        rows = line_dedup.clean(docs, broadcast_rows=limit).collect()
        assert all((r._host, r._row, r._kept, r._drop, r.n_lines, r.n_dropped) == ("h", "r", "k", "d", 2, 1) for r in rows)
    kept = language_id.known_language(docs, docs, accept=0.0)
    assert kept.columns == docs.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {(7.5, "mine")}
    items = spark.createDataFrame([(1, "line 3 with more words in it to tell the language"), (2, "no such thing")], "item_id bigint, text string")
    for limit in (1 << 20, 10):
        rows = decontaminate.remove(docs, items, max_coverage=1.0, shard_bytes=limit).collect()
        assert len(rows) == 12 and all((r.spans, r.again, r.id) == ("p", True, 3) for r in rows)
        assert {r.n_chars for r in rows} == {len(r.text) for r in rows}
    assert secret_scan.redact(docs).columns == docs.columns
    assert {len(ngram_join.one_of_each(docs, percent=100).columns)} == {len(docs.columns)}
    assert secret_scan.scan(docs).columns == ["doc_id", "findings"] and toxicity.score(docs, None).columns == ["doc_id", "severity", "p_toxic", "p_grades"]
    pages = spark.createDataFrame([(1, "http://b.com/x", "mine", "theirs", "h", 5.0, "id")], "page_id bigint, url string, _domain string, _host string, host string, bad_rate_bound double, digest string")
    outcomes = spark.createDataFrame([("b.com", True)] * 9, "host string, bad boolean")
    r = url_filter.judge(pages, outcomes).first()
    assert (r._domain, r._host, r.host, r.digest) == ("mine", "theirs", "b.com", "id") and r.bad_rate_bound != 5.0
    out = warc.read(warc.write(warc.records(pages.withColumn("html", F.lit("x"))), _common.shared_path(spark)))
    assert out.where("is_last").count() == 1


def test_empty_tables(spark):
    docs = clashing(spark).limit(0)
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    for limit in (1 << 20, 1):
        assert decontaminate.scan(docs, items, shard_bytes=limit).count() == decontaminate.remove(docs, items, shard_bytes=limit).count() == 0
    assert toxicity.score(docs, None).count() == toxicity.score(docs, toxicity.Model(np.ones(toxicity.DIM), np.array([0.0, 1.0]))).count() == 0
    assert secret_scan.scan(docs).count() == secret_scan.redact(docs).count() == 0
    model = language_id.train(docs)
    assert language_id.predict(docs, model).count() == language_id.known_language(docs, docs).count() == 0
    assert line_dedup.clean(docs, counts=()).count() == ngram_join.one_of_each(docs).count() == 0


def test_multi_label_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "y.com", "com", "localhost", "", "p.q.r.com.au"]
    d, s = url_filter.levels_of(F.col("h"))
    out = [(r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(d.alias("d"), s.alias("s")).collect()]
    assert out == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("y.com", "com"), ("com", "com"), ("localhost", "localhost"), ("", ""), ("r.com.au", "com.au")]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError):
        _common.shared_root(Session)


def test_archives_of_many_copies(spark):
    body = "copy " * 100
    rows = [(i, f"u{i}", body if i % 3 else f"{i} {body}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    for limit in (1000, -1):
        out = {r.record_id: r for r in warc.read(warc.write(warc.records(pages, broadcast_rows=limit, size=64), _common.shared_path(spark)), size=50).where("is_last").collect()}
        assert len(out) == 200
        for i, _, html in rows:
            r, copy = out[str(i)], i % 3 and i != 1
            assert (r.record_type, r.refers_to, r.declared_digest) == ("revisit" if copy else "response", "1" if copy else None, hashlib.sha256(html.encode()).hexdigest())
            assert copy or r.digest_so_far == r.declared_digest
