"""The corpus pipeline, each stage and all of it, against plain loops on a small corpus."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import plain_language
from test_join_operators import brute_join
from test_text_operators import brute_removal, words

from cyclarium.llm import language_id, line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, score double"
WORDS = {"en": "the of and that with from this have which there water people house little".split(), "de": "und der die das nicht auch sich mit werden einer über schon zwischen können".split()}
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def corpus():
    random.seed(12)
    say = lambda lang, n: " ".join(random.choices(WORDS[lang], k=n))
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        body = "\n".join(say(lang, random.randrange(12, 40)) for _ in range(3))
        rows.append((i, body + "\nfooter of the site" * (i % 3 > 0), lang if i % 5 else None, f"s{i % 2}"))
    for i in range(20):
        rows.append((100 + i, rows[7][1], "en", "s1"))
        rows.append((200 + i, rows[9][1].replace("water", "fire", 1), "en", "s0"))
    rows += [(300, None, "en", "s0"), (301, "", None, "s1"), (302, "123 456 --", "en", None), (303, f"{say('en', 60)} {ITEM} {say('en', 60)}", "en", "s1"), (304, ITEM, "en", "s0"), (305, "footer of the site", "en", "s1")]
    return [(i, t, lang, s, len(t or ""), "own", 7.5) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def told_language(docs, model):
    """Documents of which the model is sure enough."""
    out = {i: plain_language(model, d["text"]) for i, d in docs.items()}
    return {i: d for i, d in docs.items() if out[i][0] != "und" and out[i][1] >= language_id.ACCEPT}


def told_lines(docs):
    """Documents without the lines on too many different pages of their source."""
    pages = {}
    for d in docs.values():
        if d["source"] is not None:
            pages.setdefault(d["source"], set()).add(d["text"])
    drop = {}
    for source, texts in pages.items():
        every = [set(t.split("\n")) for t in texts if t is not None]
        lines = set().union(*every)
        drop[source] = {x for x in lines if x.strip() and (n := sum(x in e for e in every)) >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(texts)}
    cut = lambda d: d["text"] if d["text"] is None else "\n".join(x for x in d["text"].split("\n") if x not in drop.get(d["source"], ()))
    return {i: d | {"text": cut(d), "n_chars": len(cut(d) or "") if d["text"] is not None else None} for i, d in docs.items()}


def told_copies(docs):
    """The smallest id of each group."""
    _, component = brute_join([(i, d["text"]) for i, d in docs.items()], 5, 80)
    return {i: d for i, d in docs.items() if component[i] == i}


def told_passages(docs):
    """Documents without benchmark passages."""
    out = {i: None if d["text"] is None else brute_removal(d["text"], [words(ITEM)]) for i, d in docs.items()}
    return {i: d | {"text": out[i], "n_chars": None if out[i] is None else len(out[i])} for i, d in docs.items() if d["text"] is None or out[i] is not None}


def dicts(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs)
    stages, want = dict(corpus_pipeline.STAGES), dicts(docs)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark_passages", "packed"]
    for name, told in (("language", lambda d: told_language(d, model)), ("lines", told_lines), ("near_duplicates", told_copies), ("benchmark_passages", told_passages)):
        before, made, want = len(want), stages[name](spark, docs, folder), told(want)
        assert made.columns == docs.columns and dicts(made) == want, name
        assert name == "lines" or len(want) < before
        docs = spark.createDataFrame([tuple(d.values()) for d in want.values()], DOCS)
    assert 303 in want and "gamma" not in want[303]["text"] and 304 not in want and {7, 9} <= want.keys()


def test_run_equals_the_stages_in_turn(spark, folder):
    from tokenizers import Tokenizer

    import public_tokenizers
    from cyclarium.llm import packing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = told_passages(told_copies(told_lines(told_language(dicts(docs), language_id.train(docs)))))
    rows = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert {r.doc_id for r in rows} == want.keys()
    for i, d in want.items():
        n = len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids) + 1
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert [s for s, _ in own] == np.cumsum([0, *[x for _, x in own]])[:-1].tolist() and sum(x for _, x in own) == n


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs.limit(0), folder)
        assert made.count() == 0 and (name == "packed" or made.columns == docs.columns)
    bare = docs.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c != "doc_id"})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, bare, folder).count() == (0 if name == "language" else docs.count()), name


def test_nothing_passes_twice(spark, folder):
    """A page's own text never makes its lines boilerplate, however many copies there are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 7 or doc_id between 100 and 119")
    out = corpus_pipeline.lines(spark, docs, folder)
    assert {re.sub(r"\s+", " ", r.text) for r in out.collect()} == {re.sub(r"\s+", " ", docs.first().text)}
