"""Packing, archives, URLs, n-gram join, embeddings and components against brute force and edge cases."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import same

from cyclarium.llm import components, embedding_dedup, ngram_join, packing, registry, url_filter, warc
from cyclarium.llm._common import shared_path


def find_components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return {i: root(i) for i in ids}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == find_components({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_join(rows, n, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return {i: len(a) for i, a in sets}, find_components([i for i, _ in sets], links)


def near_copies(n_groups, size, seed=0):
    random.seed(seed)
    pool = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(n_groups):
        base = random.choices(pool, k=random.randrange(4, 260))
        for _ in range(random.randrange(1, size)):
            own = list(base)
            for _ in range(random.randrange(0, 8)):
                own[random.randrange(len(own))] = random.choice(pool)
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def test_ngram_join_of_repeated_ids_with_different_texts(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    near = lambda x: texts[x] + f" {x}more"
    rows = [(1, texts["a"]), (5, texts["a"]), (5, texts["b"]), (6, near("b"))]
    rows += [(11, texts["c"]), (12, texts["c"]), (12, texts["d"]), (13, texts["d"]), (14, near("d")), (20, "something else that has no copies at all")]
    _, want = brute_join(rows, 3, 90)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), n=3, percent=90).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == want
    assert want[6] == 1 and want[14] == 11


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = near_copies(25, 12) + [(9000 + i, f"u{i} v{i} " + passage + f" x{i} y{i} z{i}") for i in range(30)]
    rows += [(8000, None), (8001, ""), (8002, " \t\n"), (8003, "one"), (8004, "One"), (8005, "one two"), (8006, "a b c"), (8007, "A\tB\nC"), (8008, "é ü"), (8009, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    sizes, want = brute_join(rows, n, percent)
    out = ngram_join.join(docs, n=n, percent=percent).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.n_shingles for r in out} == sizes
    assert {r.doc_id: r.component_id for r in out} == want
    kept = [r.doc_id for r in ngram_join.one_of_each(docs, n=n, percent=percent, broadcast_rows=-1).collect()]
    assert sorted(kept) == sorted(i for i in want if want[i] == i)


def test_ngram_join_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (3, "other words entirely here")], "doc_id bigint, text string")
    out = ngram_join.join(docs)
    assert out.count() == 6 and {r.component_id for r in out.where("doc_id = 2").collect()} == {1}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs.where("doc_id is not null")).collect()) == [1, 3]
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in range(3):
        for _ in range(40):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((i, [float(x) for x in base + rng.normal(0, rng.choice([0, 0.02, 0.08]), 16)], label))
                i += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 16, None), (904, [1.0] * 16, 1), (905, [2.0] * 16, 1), (906, [None] + [1.0] * 15, 1), (907, [float("inf")] * 16, 1), (908, [], 1), (909, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, label int, n_links int")
    usable = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for x, (i, a, p) in enumerate(usable) for j, b, q in usable[:x] if p == q and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = find_components([i for i, _, _ in rows], links)
    for block in (512, 3):
        out = {r.vec_id: r for r in embedding_dedup.deduplicate(df, block=block).collect()}
        assert len(out) == len(rows)
        assert sum(r.n_links for r in out.values()) >= 0.9 * sum(n.values()) and all(out[i].n_links <= n[i] for i in n)
        assert np.mean([out[i].component_id == want[i] for i in want]) > 0.95
        assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())
    assert embedding_dedup.deduplicate(df.limit(0)).count() == 0


def test_archives(spark, sf_dir):
    assert same(registry.queries()["op4_warc"](spark, sf_dir), warc.ORACLE_SQL, sf_dir)
    big = "é" * 150_000
    rows = [(5, "u", big), (3, None, big), (9, "a\r\nb", big), (1, "e", ""), (2, "e", None), (None, "q", "x\r\n\r\ny" * 30), (3, "w", big), (7, "s", "short"), (8, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (100, -1):
        manifest = warc.write(warc.records(pages, broadcast_rows=limit), shared_path(spark))
        out = warc.read(manifest, size=1000)
        last = out.where("is_last").collect()
        assert len(last) == len(rows)
        assert sorted((r.record_id, r.record_type) for r in last) == sorted([("5", "revisit"), ("3", "response"), ("9", "revisit"), ("1", "response"), ("2", "response"), ("", "response"), ("3", "response"), ("7", "response"), ("8", "response")])
        parts = out.where("record_id = '3'").orderBy("file", "chunk_no").collect()
        whole = b"".join(bytes(r.chunk) for r in parts)
        assert whole in (big.encode(), big.encode() * 2) or len(whole) == 2 * len(big.encode())
        assert {r.digest_so_far for r in last if r.record_id == "3"} == {hashlib.sha256(big.encode()).hexdigest()}
        assert max(len(r.chunk) for r in parts) <= 1000
    assert warc.read(warc.write(warc.records(pages.limit(0)), shared_path(spark))).count() == 0


def test_foreign_archive(tmp_path):
    body = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for name, data in (("a.warc", body), ("b.warc.gz", gzip.compress(body))):
        (tmp_path / name).write_bytes(data)
        rows = list(warc.chunks(str(tmp_path / name), 2))
        assert [r[8] for r in rows] == [b"he", b"ll", b"o"] and rows[-1][-1] and rows[-1][1] == "urn:uuid:1"


def test_urls(spark, sf_dir):
    assert same(registry.queries()["op7_url_filter"](spark, sf_dir), url_filter.ORACLE_SQL, sf_dir)
    urls = ["http://A.Com/", None, "x/y", "h://://a?b", "http://www.Example.com/en/x#f", "a://b.example.com/en/", "http://x.net?a=/es/", "ht://q.NET/fr/u?x", "http://notexample.com/en/", "http://net/es/", "http://m.bad.org/1", "http://new.bad.org/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    outcomes = spark.createDataFrame([("m.bad.org", True)] * 60 + [("fine.org", False)] * 60 + [(f"h{i}.net", False) for i in range(40)], "host string, bad boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, outcomes).collect()}
    assert out[0] == ("a.com", "/", "com/", "allow") and out[1][:3] == ("", "", None) and out[2][:2] == ("", "")
    assert out[3][:2] == (":", "//a") and out[4][2:] == ("www.example.com/en/", "allow") and out[5][2:] == ("example.com/en/", "block")
    assert out[6][:3] == ("x.net", "", None) and out[7][2:] == ("net/fr/", "block") and out[8][2] == "com/" and out[9][2] == "net/es/"
    assert out[10][3] == "block" and out[11][3] == "block"
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge(pages, outcomes.limit(0)).count() == len(urls)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    random.seed(5)
    texts = [None, "", "a", "two  spaces\n\n and 'tis don't ''s", "é ü\u00a0x\u3000y", "<|endoftext|> x", "long " * 5000, " lead", "trail  "] + [" ".join(random.choices(["word", "Tion,", "éa.", "12", "a\nb", "x  y"], k=random.randrange(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id bigint, text string, start int")
    rows = packing.result(docs).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        own = own[:: 2 if i == 3 else 1]
        at = 0
        for start, length, crc, total in own:
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by) * 1024 <= 1.1 * total + 2048
    assert packing.result(docs.limit(0)).count() == 0


def test_differencing():
    random.seed(2)
    for n, cap in ((0, 10), (1, 10), (50, 100), (800, 1024)):
        sizes = [random.randrange(1, min(cap, 257)) if cap > 10 else 3 for _ in range(n)]
        windows = packing.pack(sizes, cap)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= cap for w in windows)
    windows = packing.pack([random.randrange(1, 257) for _ in range(5000)], 1024)
    assert packing.difference([8, 7, 6, 5, 4], 2)[1] == 16
