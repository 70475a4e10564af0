"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed 1- to 3-grams of lower-case letters (any
other character counts as a space), of unit length. Document frequencies come
from all training documents. The weights are learned on a bounded sample of
them by follow-the-regularised-leader with elastic-net penalties; a part of
the sample that training doesn't see sets the temperature of the softmax.

Edge cases: null texts and texts without letters are ``und`` with score 0, as
is everything if no training row has a label; rows without a label are never
trained on; repeated rows count each for the frequencies, and of rows with
equal ids the sample holds one; rows without an id aren't in the sample; of
labels with equal probability the first in order is predicted; whole texts of
any length are read; an empty table has an empty result; columns with the names
of the results are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclarium.llm._common import fresh, mix, shared, slices, table

#: Hashed n-grams, the longest n-gram, and the most training rows that the weights are fitted on.
DIM, ORDER, SAMPLE = 1 << 14, 3, 3000
UNKNOWN = "und"
#: Below this calibrated probability a document's language counts as uncertain.
ACCEPT = 0.5


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text, with runs of anything but letters as one space; empty without letters."""
    kept = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(ASCII)
    words = kept.split()
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)


#: What is no letter among the first 128 characters.
ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and their counts."""
    x = letters_of(text).astype(np.uint64)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0)
    grams = [x[1:-1]]
    code = x
    for n in range(2, ORDER + 1):
        code = code[:-1] * np.uint64(0x110000) + x[n - 1 :]
        grams.append(code)
    slots = np.concatenate([mix(g + np.uint64(i << 60)) for i, g in enumerate(grams)]) >> np.uint64(50)
    counts = np.bincount(slots.astype(np.int64), minlength=DIM)
    used = np.flatnonzero(counts)
    return used, counts[used]


@dataclass
class Model:
    """Fitted weights; ``classes`` are the labels in order."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def weigh(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Values of the unit-length TF-IDF vector."""
        values = (1 + np.log(counts)) * self.idf[used] if len(used) else counts
        norm = np.sqrt(values @ values) if len(used) else 0
        return values / norm if norm else values

    def logits(self, used: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[used] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Label and calibrated probability."""
        used, counts = features(text or "")
        if not len(used) or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(self.logits(used, self.weigh(used, counts)) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, epochs: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal with elastic net over (slots, counts, label) rows, then the temperature on a fifth of them."""
    classes = sorted({label for _, _, label in rows})
    model = Model(classes, idf, np.zeros((DIM, len(classes))), np.zeros(len(classes)))
    if not classes:
        return model
    data = [(used, model.weigh(used, counts), classes.index(label)) for used, counts, label in rows if len(used)]
    order = np.random.default_rng(seed).permutation(len(data))
    held, trained = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((DIM + 1, len(classes))), np.zeros((DIM + 1, len(classes)))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in trained:
            used, values, label = data[i]
            at, x = np.append(used, DIM), np.append(values, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    every = weights(np.arange(DIM + 1))
    model.weights, model.bias = every[:DIM], every[DIM]
    if len(held):
        logits = np.array([model.logits(*data[i][:2]) for i in held])
        labels = np.array([data[i][2] for i in held])
        temperatures = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), labels], 1e-12)).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(loss))])
    return model


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies of all rows' n-grams; each task counts its own rows first."""

    def count(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for lo, hi in slices(batch):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    used = features(text or "")[0]
                    df[used] += 1
                    n += len(used) > 0
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, DIM), pa.int32()), pa.array(np.append(df[used], n), pa.int64())], ["slot", "df"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(DIM + 1), 0
    for slot, k in rows:
        df[slot] = k
    n = df[DIM]
    return np.log((1 + n) / (1 + df[:DIM])) + 1


def _counted(docs: DataFrame) -> DataFrame:
    """(id, label, slots, counts) of (id, text, label); n-grams as two packed arrays of at most ``DIM`` numbers."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                made = [features(t or "") for t in rows.column("text").to_pylist()]
                packed = [pa.array([x.astype(kind).tobytes() for x in of], pa.binary()) for of, kind in zip(zip(*made), ("<u2", "<u4"))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), *packed], ["id", "label", "slots", "counts"])

    return docs.select("id", "text", "label").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, label string, slots binary, counts binary")


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows: frequencies on all, weights on the ``sample`` rows whose ids hash lowest.

    The sample's texts are counted where they are read; the driver gets at most
    ``sample`` times ``DIM`` slots and counts, whatever the texts' length.
    """
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    idf = inverse_frequencies(rows)
    chosen = rows.select("id").where("id is not null").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample)
    counted = _counted(rows.join(F.broadcast(chosen.distinct()), "id", "left_semi"))
    picked = counted.groupBy("id").agg(F.min(F.struct("label", "slots", "counts")).alias("row")).collect()
    unpacked = lambda x, kind: np.frombuffer(x, kind).astype(np.int64)
    return fit([(unpacked(r["row"]["slots"], "<u2"), unpacked(r["row"]["counts"], "<u4"), r["row"]["label"]) for r in sorted(picked, key=lambda r: r["id"])], idf)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents (or their columns ``keep``) with a language and its probability as ``names``; columns of these names are replaced."""
    keep = [c for c in keep or docs.columns if c.lower() not in names]
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    known = shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, text_col):
                rows = batch.slice(lo, hi - lo)
                made = [known.value.predict(t) for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], [*keep, *names])

    fields = [f for f in docs.schema.fields if f.name in keep]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out() -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_language_id: the language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, labelled: DataFrame, *, accept: float = ACCEPT) -> DataFrame:
    """The documents whose language is predicted with a probability of ``accept`` at least; columns stay."""
    model = train(labelled)
    label, score = (fresh(f"_{x}", docs.columns) for x in ("language", "score"))
    return predict(docs, model, names=(label, score)).where((F.col(label) != UNKNOWN) & (F.col(score) >= accept)).select(*docs.columns)
