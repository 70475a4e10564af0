"""Compression of vectors to codes of integer codebooks, one per part of the vector.

Components become whole numbers (``floor(scale * x)``) and vectors are cut into
equal consecutive parts. Each part position has a codebook, which begins as
that part of the rows with the smallest ids. A round gives every part to its
nearest entry and moves each entry to the floor of its parts' mean.

The codebooks are small (parts x entries x width numbers, whatever the rows)
and are broadcast. A task reads Arrow batches, takes all distances of a batch
by expanding the norm, ``|x - c|**2 = |x|**2 - 2 x.c + |c|**2``, with exact
matrix products of 64-bit integers, and the first smallest one. It sums up the
parts of each entry over all its batches and hands on at most parts x entries
rows; a shuffle by (part, entry) merges them, and the driver gets one row per
entry. So vectors never move, and a round is one pass over the stored integers.

Edge cases: rows whose vector is null, empty or holds null or non-finite
numbers are left out, as are those whose length is no multiple of the parts or
differs from that of the first row by id; fewer rows than entries give smaller
codebooks; equal distances go to the entry with the lower index; unused
entries stay as they are; rows without an id come last, and of equal ids the
smaller vector first; repeated rows count each; components beyond +-2**27/1024
(131,072 at 64 components; less for longer vectors) count as that, so that
distances fit 64 bits; a label's error beyond 64 bits is null; an empty table
has an empty result and empty codebooks; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, hot_join, scratch, shared, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are in memory at once.
TILE = 2048


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v): the rows that are kept, their components as whole numbers; vectors may still differ in length."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, finite))
    # distances are at most size * (2 * most)**2, which has to stay below 2**63
    most = F.pow(F.lit(2.0), F.floor((62 - F.ceil(F.log2(F.size(v)))) / 2) - 1)
    return rows.withColumn("v", F.transform(v, lambda x: F.floor(F.greatest(-most, F.least(most, x * scale))).cast("bigint")))


def first_rows(rows: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the ``entries`` smallest ids among those as long as the first, in order."""
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    first = rows.orderBy(*order).select("v").limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    own = rows.where(F.size("v") == len(first[0].v)).orderBy(*order).select("v").limit(entries)
    return np.array([r.v for r in own.collect()], np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's first nearest entry and the squared distance, all in 64-bit integers."""
    norms = (book * book).sum(axis=1)
    at, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), TILE):
        own = x[lo : lo + TILE]
        far = own @ (-2 * book.T)
        far += norms
        code = far.argmin(axis=1)
        at[lo : lo + TILE] = code
        least[lo : lo + TILE] = far[np.arange(len(own)), code] + (own * own).sum(axis=1)
    return at, least


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """The vectors' consecutive parts."""
    return np.split(x, parts, axis=1)


def sums(rows: DataFrame, books) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what each task's parts sum up to, by their nearest entries."""

    def run(batches):
        own = books.value
        parts, entries, width = own.shape
        total, n = np.zeros(own.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, x in enumerate(split(matrix(batch.column("v"), parts * width), parts)):
                if not len(x):
                    continue
                code, _ = nearest(x, own[p])
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                total[p, used] += np.add.reduceat(x[order], starts, axis=0)
                n[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(n)
        columns = [p.astype(np.int32), e.astype(np.int32), n[p, e], *(np.ascontiguousarray(total[p, e, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    width = books.value.shape[2]
    return rows.select("v").mapInArrow(run, "part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width)))


def moved(rows: DataFrame, own: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = own.shape
    with scratch():
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        merged = sums(rows, shared(rows.sparkSession, own)).groupBy("part", "entry").agg(exact("n"), *[exact(f"s{i}") for i in range(width)]).collect()
    out = own.copy()
    for r in merged:
        out[r.part, r.entry] = [int(r[f"s{i}"]) // int(r.n) for i in range(width)]
    return out


def encoded(rows: DataFrame, own: np.ndarray) -> DataFrame:
    """(id, label, code, error) by the codebooks ``own``."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    books = shared(rows.sparkSession, own)

    def run(batches):
        own = books.value
        parts, _, width = own.shape
        names = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(x, own[p]) for p, x in enumerate(split(matrix(batch.column("v"), parts * width), parts))]
            code = names[found[0][0]]
            for at, _ in found[1:]:
                code = np.char.add(code, names[at])
            error = np.sum([least for _, least in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code), pa.array(error)], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of (id, label, v) with vectors of the first one's length."""
    first = first_rows(rows, entries)
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    own = np.stack(split(first, parts))
    rows = rows.where(F.size("v") == first.shape[1])
    for _ in range(rounds):
        own = moved(rows, own)
    return own


def digest(own: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, own.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Per kept vector ``id_col``, code, error and label_error; and the codebooks, with which a code is read back."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    with scratch():
        return _compressed(vectors, id_col, vector_col, label_col, parts, entries, rounds, scale)


def _compressed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    rows = cut(whole_numbers(vectors, id_col, vector_col, label_col, parts, scale))
    own = train(rows, parts, entries, rounds)
    width = own.shape[2]
    coded = cut(encoded(rows.where(F.size("v") == parts * width), own)) if width else rows.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    key = ["nothing", "name"]
    coded = coded.withColumns({"nothing": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    total = coded.groupBy(*key).agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("bigint").alias("label_error"))
    out = hot_join(coded, total, key, "id").select(F.col("id").alias(id_col), "code", "error", "label_error")
    return cut(out, outside=True), own


def decode(codes: DataFrame, own: np.ndarray, *, scale: int = SCALE) -> DataFrame:
    """Adds ``vector``, what the codes of ``compress`` stand for: the entries over ``scale``."""
    parts, _, width = own.shape
    books = shared(codes.sparkSession, own)

    def run(batches):
        own = books.value
        for batch in batches:
            raw = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, parts)
            values = np.concatenate([own[p][raw[:, p]] for p in range(parts)], axis=1) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * parts * width, pa.int32()), pa.array(values.reshape(-1)))
            yield batch.append_column("vector", lists)

    return codes.mapInArrow(run, codes.withColumn("vector", F.lit(None).cast("array<double>")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_vector_codes: codes of all embeddings."""
    coded, own = compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(own)))


def _rounds_sql() -> str:
    """Each round's assignment and codebooks; distances as plain sums of squares."""
    near = lambda book: f"SELECT x.vec_id, x.part, arg_min(b.entry, (list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry, min(list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far FROM pieces x JOIN {book} b USING (part) GROUP BY ALL"
    out = []
    for i in range(ROUNDS):
        out.append(f"a{i} AS MATERIALIZED ({near(f'b{i}')})")
        out.append(
            f"m{i} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY pos) AS c FROM (SELECT part, entry, pos, CAST(floor_div AS BIGINT) AS m FROM (SELECT part, entry, pos, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS floor_div "
            f"FROM (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT x.part, a.entry, unnest(x.c) AS v, generate_subscripts(x.c, 1) AS pos FROM pieces x JOIN a{i} a USING (vec_id, part)) GROUP BY ALL))) GROUP BY ALL)"
        )
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    return ",\n".join([*out, f"final AS MATERIALIZED ({near(f'b{ROUNDS}')})"])


ORACLE_SQL = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS c FROM kept, range({PARTS}) r(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, c FROM pieces JOIN firsts USING (vec_id)),
{_rounds_sql()},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM final GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""
