"""What the operators of this subpackage share: tables, cuts of lineage, text."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once, and Spark's own number, which is for narrow rows.
BATCH_ROWS, USUAL_ROWS = 2000, 10_000


def small_batches(spark: SparkSession) -> None:
    """Texts are wide rows: unless the session says otherwise, fewer of them are held on their way to a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, str(USUAL_ROWS)) == str(USUAL_ROWS):
        spark.conf.set(key, str(BATCH_ROWS))


#: Rows that Parquet's reader holds at once inside ``short_reads``.
READ_ROWS = 256


@contextlib.contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """Inside, whole texts are read fewer rows at once: arrays of megabytes make an executor's heap grow. What runs inside has to end there."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset in local tests a
    temporary folder is made and kept for the rest of the session. On a cluster
    a folder of one machine would lose what executors write, so it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cyclarium-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/cyclarium/{uuid.uuid4().hex}"


#: Open scopes, the innermost last: what each is to delete.
_SCOPES: list[list[DataFrame | Broadcast]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is cut or shared inside is deleted at the end, but for cuts made for the outside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for made in _SCOPES.pop():
            made.destroy() if isinstance(made, Broadcast) else drop_cut(made)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that lasts as long as the open scope; without one, as long as something refers to it."""
    small_batches(spark)
    out = spark.sparkContext.broadcast(value)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, outside: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the stages since the last
    cut, and nothing stays in an executor's own memory or disk. Within a
    ``scratch`` the files live as long as that, or as the scope around it if
    they are for the outside.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cyclarium_path = path
    if len(_SCOPES) > outside:
        _SCOPES[-1 - outside].append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_cyclarium_path", None)
    if path:
        df._cyclarium_path = None
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Parts into which a hot group's rows are dealt.
SALTS = 1024


def hot_join(rows: DataFrame, table: DataFrame, key: list[str], by: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key; a key may hold any share of the rows.

    A group's rows are dealt into ``SALTS`` parts by a hash of the column
    ``by``; the table's row goes to those of its parts that there are.
    """
    salt = fresh("_salt", [*rows.columns, *table.columns])
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return rows.join(rows.select(*key, salt).distinct().join(table, key), [*key, salt], how).drop(salt)


def with_least(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """The rows with ``rep``, the least id of their group, and ``size``, its rows; groups of any size.

    Groups are summed up in parts before they are summed up whole.
    """
    salt = fresh("_salt", rows.columns)
    parts = rows.groupBy(*key, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias(salt)).agg(F.min(id_col).alias("rep"), F.count("*").alias("size"))
    groups = parts.groupBy(*key).agg(F.min("rep").alias("rep"), F.sum("size").alias("size")).where("size > 1")
    out = hot_join(rows, groups, key, id_col)
    return out.withColumns({"rep": F.coalesce("rep", id_col), "size": F.coalesce("size", F.lit(1))})


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` with at most ``limit`` bytes of ``column`` (one row may be longer)."""
    ends = offsets_of(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's values (nulls are empty)."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    buffer = array.buffers()[1]
    if buffer is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffer, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets, which begin at 0. Nulls count as empty."""
    if array.null_count:
        array = array.fill_null("")
    ends = offsets_of(array)
    buffer = array.buffers()[2]
    if buffer is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def cuts_between(within: np.ndarray, ends: np.ndarray, piece: int) -> list[int]:
    """Where to cut so that parts have about ``piece`` bytes and no word is cut: ends of texts, or bytes within very long ones that belong to no word."""
    out, n = [0], len(within)
    while n - out[-1] > piece:
        at = out[-1] + piece
        near = ends[np.searchsorted(ends, at, side="right") - 1]
        if near <= out[-1]:
            gap = np.flatnonzero(~within[at : at + piece])
            while not len(gap) and at + piece < n:
                at += piece
                gap = np.flatnonzero(~within[at : at + piece])
            near = at + int(gap[0]) if len(gap) else n
        out.append(int(near))
    return [*out, n] if out[-1] < n else out


class Words:
    """Splits UTF-8 text into words and hashes each to 64 bits, for many texts at once.

    ``separators`` are the bytes between words; A-Z count as a-z. The hash is a
    polynomial modulo 2**64 over random byte values with a final mix.
    """

    PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, separators: bytes) -> None:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.is_word = self.is_word[lower]
        values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
        self.values = np.where(self.is_word, values[lower], np.uint64(0))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(self.PRIME), -1, 1 << 64))
            self.power, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (self.PRIME, inverse))

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end byte, hash) of each word, and for each text the index of its first word (one more at the end)."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        word = self.is_word[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        edges = ends[(ends > 0) & (ends < n)]
        before[edges] = False
        after[edges - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self._powers(n)
        hashed = self.values[data]
        hashed *= self.power[:n]
        hashed = mix(np.add.reduceat(hashed, first) * self.inverse[first]) if len(first) else np.zeros(0, np.uint64)
        return first, last, hashed, np.searchsorted(first, ends)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(first[i], first[i] + length[i])``."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return np.arange(total, dtype=np.int64) + shift
