"""Packing token sequences into near-equal windows by multiway differencing.

A document's ids (an end id follows its text) are cut where its length says: as
many full windows as fit, then pieces of ``tail`` ids and one of the rest. Full
windows are sequences as they are and take their ids where they are read, with
no shuffle. The other pieces are dealt into blocks of bounded size by a hash of
the piece, and each block is packed by Karmarkar and Karp's multiway
differencing: every piece begins as a partial partition into m windows; the two
partial partitions with the largest imbalance are merged, the fullest window of
one with the emptiest of the other, until one is left. If its largest window
exceeds the capacity, m rises and the block is packed again.

Ids never move: the cut points follow from the length alone, so the pass that
makes the ids also makes each piece's checksum, and only pieces are shuffled.

Edge cases: null and empty texts give one piece, the end id alone. Very long
documents become many pieces that land in many blocks; their ids are made at
once, also where millions of blanks or of one letter stand in a row. Ties in length are
packed in the order of id and start; repeated rows are packed each. An empty
table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, slices, table

CAPACITY, TAIL = 1024, 256
#: Pieces in a block on average.
BLOCK = 8192
VOCABULARY = "byte_bpe_50k.json"
#: A text with this string goes to the tokenizer itself, for which it is a token of its own.
SPECIAL = "<|endoftext|>"
#: So does one with this many blanks in a row, on which the other library's pattern runs out of stack.
BLANKS, LONG_BLANKS = re.compile(r"\s++"), 100_000
#: Units that are merged by themselves: a fixed pattern of this vocabulary.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level vocabularies write each byte as a visible character: itself if it is one, else the next from U+0100 on.
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {chr(b): b for b in VISIBLE} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in VISIBLE)}


class Encoder:
    """Ids of a byte-level vocabulary in which a token's id is also the rank of its merge.

    The merges of the vocabulary file are done by the faster of two libraries
    where it can, and by the other where it can't; their ids are the same. It
    keeps nothing from text to text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        added = {t["content"] for t in known["added_tokens"]}
        ranks = {bytes(BYTES[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in added}
        self.merges = tiktoken.Encoding("own", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text or len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.merges.encode_ordinary(text), "<u4")


#: The encoder of this worker by path; it outlives a task and doesn't grow.
ENCODERS: dict[str, Encoder] = {}


def cuts(n: int, capacity: int, tail: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full windows, then pieces of ``tail``, then what is left."""
    full = n - n % capacity
    return [(i, capacity) for i in range(0, full, capacity)] + [(i, min(tail, n - i)) for i in range(full, n, tail)]


PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, tail: int = TAIL, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches):
        if vocabulary not in ENCODERS:
            ENCODERS[vocabulary] = Encoder(vocabulary)
        encode = ENCODERS[vocabulary].encode
        for batch in batches:
            for lo, hi in slices(batch, limit=1 << 20):
                rows, out = batch.slice(lo, hi - lo), ([], [], [], [], [], [])
                for i, text in enumerate(rows.column("text").to_pylist()):
                    ids = np.append(encode(text), end) if text else end
                    for start, length in cuts(len(ids), capacity, tail):
                        own = ids[start : start + length]
                        for column, x in zip(out, (i, start, length, zlib.crc32(own), len(ids), own if with_ids else None)):
                            column.append(x)
                columns = [rows.column("id").take(pa.array(out[0], pa.int32())), *(pa.array(x, pa.int64()) for x in out[1:5])]
                if with_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    schema = PIECES.replace("id bigint", f"id {kind}", 1) + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def difference(sizes: list[int], m: int) -> tuple[list[list[int]], int]:
    """Karmarkar and Karp's differencing of ``sizes`` into ``m`` windows: the items of each, and the largest sum.

    A partial partition lists its non-empty windows, (sum, node) from the
    emptiest; its other windows are empty. A node is an item or joins two.
    """
    joins: list[tuple[int, int]] = []
    n = len(sizes)

    def join(x: int, y: int) -> int:
        joins.append((x, y))
        return n + len(joins) - 1

    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = itertools.count(n)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            size, node = b[0]
            if len(a) == m:
                less, other = a.pop(0)
                size, node = size + less, join(other, node)
            bisect.insort(a, (size, node))
        else:
            spare = m - len(a)
            alone, rest = b[:spare] if spare else [], b[spare:]
            fullest = rest[::-1]
            met = [(x + y, join(p, q)) for (x, p), (y, q) in zip(a, fullest)]
            a = sorted(met + a[len(fullest) :] + alone)
        least = a[0][0] if len(a) == m else 0
        heapq.heappush(heap, (least - a[-1][0], next(fresh), a))
    made = heap[0][2] if heap else []
    out = []
    for _, node in made:
        items, todo = [], [node]
        while todo:
            node = todo.pop()
            if node < n:
                items.append(node)
            else:
                todo += joins[node - n]
        out.append(items)
    return out, made[-1][0] if made else 0


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by window; windows are near-equal and none exceeds ``capacity``."""
    m = -(-sum(sizes) // capacity)
    while sizes:
        windows, most = difference(sizes, m)
        if most <= capacity:
            return windows
        m += max(1, m * (most - capacity) // (4 * capacity))
    return []


def windows(made: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``.

    ``made`` is read three times, so it should be stored. Ids of packed
    sequences are even and hold the block's number above the sequence's number
    in the block; those of full windows are odd and given where they are read.
    """
    rest = made.where(F.col("length") < capacity)
    n = -(-rest.count() // block) or 1
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id", "start", "doc_tokens", "ids_crc32"), F.lit(n)))
    extra = [f for f in made.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extra) + ", sequence_id bigint, offset bigint"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="block").sort_values(["length", "id", "start"], ascending=[False, True, True], ignore_index=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for w, items in enumerate(pack(sizes, capacity)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = (int(key[0]) << 32 | w) << 1, at
                at += sizes[i]
        return rows.assign(sequence_id=sequence, offset=offset)

    full = made.where(F.col("length") == capacity).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rest.groupBy("block").applyInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Pieces of all documents with their places; the pieces are kept in the shared folder meanwhile."""
    return windows(cut(pieces(docs, vocabulary, **options)))


def result(docs: DataFrame) -> DataFrame:
    """The columns of op6_packing."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path(VOCABULARY))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_packing: all documents in sequences of at most 1024 ids."""
    return result(table(spark, sf_dir, "documents"))
