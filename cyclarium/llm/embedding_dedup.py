"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Equal vectors of a label collapse into one class first. Each class gets a code
of ``BITS`` signs against random hyperplanes in each of ``TABLES`` tables, and
classes with an equal code in a table are compared by exact cosine. A pair with
a cosine of 0.98 agrees on one sign with probability 0.936, so it misses all
24 tables of 20 signs with probability 0.0006.

A bucket is cut into blocks. A block's classes are compared where they meet;
a block then travels as one row of packed arrays to be compared with each other
block of its bucket, so a pair of blocks is one unit of work and no bucket is
too large for a task and none is capped. Blocks grow with their bucket, up to
a bound, as vectors are sent once per other block. A pair that meets in
several tables counts in the first; that is read from the codes of both, so
links are counted without listing the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
numbers, and those without a label, link with nothing; vectors of different
lengths don't link; of equal cosines none is preferred; rows with equal ids are
one node with the links of all their vectors, and rows without an id link with
exact copies only; vectors of any length are compared whole; an empty table
has an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, hot_join, scratch, table, with_least
from cyclarium.llm.components import components

THRESHOLD, BITS, TABLES = 0.98, 20, 24
#: Classes in a block of a small bucket and of a large one, and rows of a block that are compared at a time.
BLOCK, LARGE_BLOCK, TILE = 256, 4096, 512


def codes(classes: DataFrame, bits: int, tables: int, seed: int = 5) -> DataFrame:
    """Adds ``unit`` (the unit vector) and ``codes`` (one per table) to (rep, label, n, vector)."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits)
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("vector").to_pylist()]
            made: list = [None] * len(vectors)
            units: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                code = ((x @ planes[dim] > 0).reshape(len(at), tables, bits) * weight).sum(axis=2)
                for k, i in enumerate(at):
                    made[i], units[i] = code[k].astype(np.int32), x[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "label", "n")), pa.array(units, pa.list_(pa.float64())), pa.array(made, pa.list_(pa.int32()))], ["rep", "label", "n", "unit", "codes"])

    return classes.mapInArrow(run, f"rep {classes.schema['rep'].dataType.simpleString()}, label {classes.schema['label'].dataType.simpleString()}, n bigint, unit array<double>, codes array<int>")


class Block:
    """Packed classes: unit vectors, codes, hashed labels, rows of each class, and the classes' ids."""

    def __init__(self, rep: pa.Array, n: np.ndarray, label: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        self.rep, self.n, self.label, self.unit, self.codes = rep, n, label, unit, codes

    @classmethod
    def of_cells(cls, rep: pa.Array, n: bytes, label: bytes, unit: bytes, codes: bytes) -> Block:
        matrix = lambda x, kind: np.frombuffer(x, kind).reshape(len(rep), -1)
        return cls(rep, np.frombuffer(n, "<i8"), np.frombuffer(label, "<i8"), matrix(unit, "<f8"), matrix(codes, "<i4"))

    def cells(self) -> list[bytes]:
        return [x.astype(kind, copy=False).tobytes() for x, kind in ((self.n, "<i8"), (self.label, "<i8"), (self.unit, "<f8"), (self.codes, "<i4"))]


def _compare(x: Block, y: Block | None, t: int, threshold: float) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Of the classes of two blocks, or of one with itself, that are linked first in table ``t``: id, links, and a class of their group."""
    whole = y is None
    y = x if whole else y
    found = []
    for at in range(0, len(x.rep), TILE):
        p, q = np.nonzero(x.unit[at : at + TILE] @ y.unit.T >= threshold)
        p = p + at
        if whole:
            p, q = p[p < q], q[p < q]
        same = x.codes[p] == y.codes[q]
        first = (x.label[p] == y.label[q]) & same[:, t] & ~same[:, :t].any(axis=1)
        found.append((p[first], q[first]))
    p, q = (np.concatenate(z) for z in zip(*found))
    rep, shift = (x.rep, 0) if whole else (pa.concat_arrays([x.rep, y.rep]), len(x.rep))
    q = q + shift
    n = x.n if whole else np.concatenate([x.n, y.n])
    links = np.bincount(p, n[q], len(rep)) + np.bincount(q, n[p], len(rep))
    root = np.arange(len(rep))
    while len(p):
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(links)
    return rep.take(pa.array(at)), links[at].astype(np.int64), rep.take(pa.array(root[at]))


CELLS = ["ns", "labels", "units", "all_codes"]


def _within(threshold: float):
    """The function for mapInArrow that compares the classes of each block, and packs those of buckets with several blocks."""
    where = ("t", "bucket", "dim", "own", "blocks")

    def batch_of(rows: pa.RecordBatch, edges: list[tuple[int, int]]) -> pa.RecordBatch | None:
        """What the blocks at ``edges`` give: first their links, then their packed rows."""
        one = {c: rows.column(c).to_numpy() for c in (*where, "n", "label_key")}
        flat = {c: (offsets_of_lists(rows.column(c)), rows.column(c).flatten().to_numpy()) for c in ("unit", "codes")}
        rep, found, packed = rows.column("rep"), [], []
        for lo, hi in edges:
            matrix = lambda c: flat[c][1][flat[c][0][lo] : flat[c][0][hi]].reshape(hi - lo, -1)  # noqa: B023, E731
            block = Block(rep.slice(lo, hi - lo), one["n"][lo:hi], one["label_key"][lo:hi], matrix("unit"), matrix("codes"))
            part = _compare(block, None, int(one["t"][lo]), threshold)
            if len(part[0]):
                found.append(part)
            if one["blocks"][lo] > 1:
                packed.append(([one[c][lo].item() for c in where], block.rep.to_pylist(), block.cells()))
        n, m = sum(len(x) for x, _, _ in found), len(packed)
        if not n + m:
            return None
        join = lambda parts, kind, pad: pa.concat_arrays([*parts, pa.nulls(pad, kind)])
        late = lambda values, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)])
        columns = [join([x[0] for x in found], rep.type, m), join([pa.array(x[1]) for x in found], pa.int64(), m), join([x[2] for x in found], rep.type, m)]
        columns += [late([x[0][i] for x in packed], pa.int64() if c == "bucket" else pa.int32()) for i, c in enumerate(where)]
        columns += [late([x[1] for x in packed], pa.list_(rep.type)), *(late([x[2][i] for x in packed], pa.binary()) for i in range(len(CELLS)))]
        return pa.RecordBatch.from_arrays(columns, ["rep", "links", "root", *where, "reps", *CELLS])

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            keys = [held.column(c).to_numpy() for c in ("bucket", "dim", "own")]
            starts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist()]
            ends = [*starts[1:], held.num_rows] if batch is None else starts[1:]
            several = held.column("blocks").to_numpy()
            out = batch_of(held, [(a, b) for a, b in zip(starts, ends) if b - a > 1 or several[a] > 1])
            if out is not None:
                yield out
            held = held.slice(starts[-1]) if batch is not None else None

    return run


def offsets_of_lists(array: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values (one more at the end)."""
    ends = array.offsets.to_numpy()
    return ends - ends[0]


def _across(threshold: float):
    """The function for mapInArrow that compares the two packed blocks of each row."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i]
                x, y = (Block.of_cells(cell(f"reps_{k}").values, *(cell(f"{c}_{k}").as_py() for c in CELLS)) for k in ("a", "b"))
                rep, links, root = _compare(x, y, cell("t").as_py(), threshold)
                yield pa.RecordBatch.from_arrays([rep, pa.array(links), root], ["rep", "links", "root"])

    return run


def links(coded: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, large_block: int = LARGE_BLOCK) -> DataFrame:
    """(rep, links, root): parts of each class's links, and a class that it is linked with."""
    with scratch():
        return cut(_links(coded, threshold, block, large_block), outside=True)


def _links(coded: DataFrame, threshold: float, block: int, large_block: int) -> DataFrame:
    kind = coded.schema["rep"].dataType.simpleString()
    rows = coded.select("rep", "label", F.size("unit").alias("dim"), F.posexplode("codes").alias("t", "code"))
    rows = rows.select("rep", "t", "dim", F.xxhash64(F.col("label").cast("string"), "t", "code").alias("bucket"))
    buckets = rows.groupBy("bucket", "dim").agg(F.count("*").alias("size")).where("size > 1")
    per_block = F.least(F.lit(max(block, large_block)), F.greatest(F.lit(block), F.ceil(F.col("size") / 64)))
    buckets = buckets.select("bucket", "dim", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"))
    rows = hot_join(rows, buckets, ["bucket", "dim"], "rep", "inner").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(coded.select("rep", F.xxhash64(F.col("label")).alias("label_key"), "n", "unit", "codes"), "rep")
    where = ["bucket", "dim", "own"]
    schema = f"rep {kind}, links bigint, root {kind}, t int, bucket bigint, dim int, own int, blocks int, reps array<{kind}>, " + ", ".join(f"{c} binary" for c in CELLS)
    met = cut(rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(_within(threshold), schema))
    packed = ["reps", *CELLS]
    side = lambda k, own, other, first, last: met.where("blocks > 1").select("t", "bucket", "dim", F.col("own").alias(own), F.explode(F.when(last >= first, F.sequence(first, last))).alias(other), *[F.col(c).alias(f"{c}_{k}") for c in packed])
    low, high = side("a", "low", "high", F.col("own") + 1, F.col("blocks") - 1), side("b", "high", "low", F.lit(0), F.col("own") - 1)
    pairs = low.join(high.drop("t"), ["bucket", "dim", "low", "high"]).select("t", *[f"{c}_{k}" for k in ("a", "b") for c in packed])
    return met.where("rep is not null").select("rep", "links", "root").union(pairs.mapInArrow(_across(threshold), f"rep {kind}, links bigint, root {kind}"))


def deduplicate(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """Per vector: ``id_col``, n_links, component_id, kept."""
    with scratch():
        return cut(_deduplicated(vectors, id_col, vector_col, label_col, threshold, bits, tables, block), outside=True)


def _deduplicated(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, bits: int, tables: int, block: int) -> DataFrame:
    v = F.col("vector")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    key = ["label", "h", "g"]
    own = rows.where("usable").withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit("second"), "vector")})
    classes = own.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    coded = cut(codes(classes.select("rep", "label", "n", "vector"), bits, tables))
    parts = links(coded, threshold, block)
    found = components(parts.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    total = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    known = total.join(found.withColumnRenamed("id", "rep"), "rep", "full")
    own = hot_join(with_least(own.select("id", *key), key, "id"), known, ["rep"], "id")
    own = own.select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = own.union(rows.where("not usable").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_embedding_dedup: links and components of all embeddings."""
    return deduplicate(table(spark, sf_dir, "embeddings"))
