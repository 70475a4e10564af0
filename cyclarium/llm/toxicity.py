"""Toxicity: a cumulative-link ordinal model over sparse word features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality. One
weight vector serves all grades; ordered thresholds part them:
P(grade > k) = sigmoid(w.x - t_k). A document's expected severity is the sum
of these probabilities. Features are the hashed distinct words of the whole
text and their stems. The model is fitted on a bounded sample of labelled
documents by adaptive gradients with an L1 penalty; weights are not negative,
so that no amount of harmless words outweighs a toxic one, and rare words are
left out. The thresholds keep their order as the later ones are sums of
positive steps.

A document counts as toxic if P(grade > 0) reaches the model's ``cut``. A first
fit on four fifths of the sample sets it where precision and recall balance
best (the F1 score) on the fifth that it hasn't seen.

Edge cases: null and empty texts have no words and the grades' base rates;
documents without a label are scored but not learned from; a label row without
grades is ignored, and of several rows for one document the highest grade
counts; of documents with equal ids one is learned from; repeated rows are
scored alike; of grades with equal probability the lowest is reported; whole
texts of any length are read; without any labels the severity is null; an empty
table has an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import Words, bytes_of, mix, shared, slices, table

#: Hashed words, and the most labelled documents that the model is fitted on.
DIM, SAMPLE = 1 << 18, 6000
#: The cut of a model whose sample has no toxic documents to set it by.
CUT = 0.5
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Model:
    """Weights by word slot, increasing thresholds (one less than grades), and the least P(grade > 0) of a toxic document."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = CUT

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))


class Features:
    """Slots of the words of many texts and of their first 4 and 5 bytes, which stand for stems."""

    def __init__(self) -> None:
        self.words = Words(SEPARATORS)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, slot) of each word and stem; a text's may repeat."""
        first, last, hashed, begin = self.words(data, ends)
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        texts, slots = [text], [hashed]
        for n in (4, 5):
            long = np.flatnonzero(last - first > n)
            stem = np.zeros(len(long), np.uint64)
            for k in range(n):
                stem = stem << np.uint64(8) | self.words.lower[data[first[long] + k]]
            texts.append(text[long])
            slots.append(mix(stem + np.uint64(n << 56)))
        return np.concatenate(texts), (np.concatenate(slots) >> np.uint64(46)).astype(np.int64)


def fit(rows: list[np.ndarray], grades: list[int], n_grades: int, *, rate: float = 0.3, l1: float = 0.01, epochs: int = 8, least: int = 3, seed: int = 11) -> Model:
    """Ordinal regression of ``grades`` on rows of distinct word slots."""
    grade = np.asarray(grades)
    counts = np.zeros(DIM, np.int64)
    for r in rows:
        counts[r] += 1
    rows = [r[counts[r] >= least] for r in rows]
    share = np.array([(np.sum(grade > k) + 0.5) / (len(grade) + 1) for k in range(n_grades - 1)])
    first = np.log((1 - share) / share)
    base, steps = first[0], np.log(np.maximum(np.diff(first), 0.1))
    w, seen = np.zeros(DIM), np.full(DIM, 1e-2)
    seen_base, seen_steps = 1e-2, np.full(len(steps), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            t = base + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            s = 1 / (1 + np.exp(-np.clip(w[r].sum() - t, -500, 500)))
            y = int(grade[i])
            high = np.concatenate([[1.0], s])[y]
            low = np.concatenate([s, [0.0]])[y]
            p = max(high - low, 1e-9)
            d_high = high * (1 - high) if y > 0 else 0.0
            d_low = low * (1 - low) if y < len(s) else 0.0
            g = -(d_high - d_low) / p
            d_t = np.zeros(len(t))
            if y > 0:
                d_t[y - 1] += d_high / p
            if y < len(t):
                d_t[y] -= d_low / p
            seen_base += d_t.sum() ** 2
            base -= rate * d_t.sum() / np.sqrt(seen_base)
            d_steps = np.cumsum(d_t[::-1])[::-1][1:] * np.exp(steps)
            seen_steps += d_steps**2
            steps = np.clip(steps - rate * d_steps / np.sqrt(seen_steps), -5, 5)
            seen[r] += g * g
            move = rate / np.sqrt(seen[r])
            new = w[r] - move * g
            w[r] = np.maximum(new - move * l1, 0)
    return Model(w, base + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def _slots(docs: DataFrame, kinds: str, names: list[str]) -> DataFrame:
    """The rows with the distinct word slots of their texts in place of these."""
    read = Features()

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                text, slot = read(*bytes_of(rows.column("text")))
                pairs = np.unique(text * DIM + slot)
                made = np.split(pairs % DIM, np.searchsorted(pairs // DIM, np.arange(1, rows.num_rows)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(made, pa.list_(pa.int64()))], [*names, "slots"])

    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, slots array<bigint>")


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability from which on counting as toxic has the highest F1 score; of equals the highest."""
    at = np.argsort(-p, kind="stable")
    p, toxic = p[at], toxic[at]
    if not toxic.any():
        return CUT
    last = np.append(p[1:] < p[:-1], True)
    f1 = np.where(last, 2 * np.cumsum(toxic) / (np.arange(1, len(p) + 1) + toxic.sum()), -1)
    return float(p[int(np.argmax(f1))])


def train(docs: DataFrame, grades: DataFrame, *, n_grades: int = 3, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` documents of ``grades`` (doc_id, grade): those whose ids hash lowest."""
    known = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    slots = _slots(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grade int", ["doc_id", "grade"])
    got = slots.groupBy("doc_id", "grade").agg(F.min("slots").alias("slots")).collect()
    if not got:
        return None
    got.sort(key=lambda r: r["doc_id"])
    slots, own = [np.array(r["slots"], np.int64) for r in got], np.array([r["grade"] for r in got])
    held = np.arange(len(got)) % 5 == 4
    model, tried = fit(slots, own.tolist(), n_grades), fit([x for x, h in zip(slots, held) if not h], own[~held].tolist(), n_grades)
    model.cut = best_cut(tried.exceed(np.array([tried.weights[x].sum() for x, h in zip(slots, held) if h]))[:, 0], own[held] > 0)
    return model


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, severity (expected grade), p_toxic (grade above 0), p_grades (array)."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return docs.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("severity"), F.lit(None).cast("double").alias("p_toxic"), F.lit(None).cast("array<double>").alias("p_grades"))
    used = np.flatnonzero(model.weights)
    known = shared(docs.sparkSession, (used, model.weights[used], model.thresholds))
    read = Features()

    def run(batches):
        used, values, thresholds = known.value
        weights = np.zeros(DIM)
        weights[used] = values
        own = Model(weights, thresholds)
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                text, slot = read(*bytes_of(rows.column("text")))
                some = np.flatnonzero(weights[slot])
                pairs = np.unique(text[some] * DIM + slot[some])
                total = np.bincount(pairs // DIM, weights[pairs % DIM], rows.num_rows) if len(pairs) else np.zeros(rows.num_rows)
                above = own.exceed(total)
                at_least = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
                p = at_least[:, :-1] - at_least[:, 1:]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(list(p), pa.list_(pa.float64()))], ["id", "severity", "p_toxic", "p_grades"])

    return docs.mapInArrow(run, f"id {kind}, severity double, p_toxic double, p_grades array<double>").withColumnRenamed("id", id_col)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from toxic and quality flags."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.cast("int").alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_toxicity: severity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, grades_of(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    grade = F.array_position("p_grades", F.array_max("p_grades")) - 1
    return out.select("doc_id", "severity", "p_toxic", grade.alias("grade"), (F.col("p_toxic") >= (model.cut if model else CUT)).alias("toxic"))
