"""Grouping of spelling variants by the parity of their letters.

Words are counted where texts are read: Arrow batches give the words' bytes,
equal words of a slice are added up there, and Spark sums up the rest.

Each word gets a bitmask with the parity of how often each letter occurs. A
deleted or inserted code point flips one bit and a replaced one flips two, or
none if both share a bit; so of the mask's three bands at least one is equal in
two words that are one edit apart. Words with an equal band and lengths that
differ by one at most are joined, and Spark's ``levenshtein`` verifies them
after the masks' differing bits are counted. A band alone would hold a fixed
share of all words, however many there are, so its buckets are cut further:
one edit also leaves the first or the last half of the shorter word's length
as it is, and a key is a band together with one half. A pair that meets under
several keys counts at the first, which is read from the words themselves; so
no pair has to be told apart afterwards, and no bucket is capped.

A word's form is its most frequent near word, if that is frequent enough;
forms are followed to their root by doubling the steps, a join per round.

Edge cases: null and empty texts have no words, and a null id counts as empty
text; very long texts are read in pieces that end between words; of equally
frequent near words the first in code-point order is the form; repeated rows
count each; an empty table has an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import bytes_of, cut, cuts_between, drop_cut, hot_join, ranges, scratch, slices, small_batches, table

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Of the words of a document one in so many loses a letter, by its checksum: the contract's own noise.
NOISE = 199
#: Bytes of text whose words are counted at a time, and the longest word whose checksum is made in step with others'.
PIECE, STEPS = 1 << 22, 64
BITS, BANDS = 63, 3


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by its polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


CRC = _crc_table()
#: Bytes of A-Z as those of a-z, and the letters among ASCII bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First byte of the two of U+00C0 to U+00FF.
LEAD = 0xC3


def checksums(data: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at ``first``, each carried on from the checksum ``state`` of what stands before it."""
    out = ~state.astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    size = length[order]
    for k in range(min(int(size[0]) if len(size) else 0, STEPS)):
        own = order[: np.searchsorted(-size, -k)]
        now = out[own]
        out[own] = CRC[(now ^ data[first[own] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = ~out
    for i in order[: np.searchsorted(-size, -STEPS)]:
        out[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes(), int(state[i]))
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z and U+00C0 to U+00FF."""
    lead = data == LEAD
    out = ASCII_LETTER[data] | lead
    out[1:] |= lead[:-1]
    return out


def runs(data: np.ndarray, is_letter: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, bytes and text of each maximal run of letters; ``ends`` are the texts' offsets."""
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = is_letter
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = is_letter
    first = np.flatnonzero(after & (edge | ~before))
    stop = np.flatnonzero(before & (edge | ~after))
    return first, stop - first, np.searchsorted(ends, first, side="right") - 1


def counted(data: np.ndarray, is_letter: np.ndarray, ends: np.ndarray, states: np.ndarray, min_length: int, noise: int | None) -> pa.RecordBatch | None:
    """(word, n) of the texts between ``ends``, small A-Z; ``states`` are the checksums of the texts' prefixes."""
    first, length, text = runs(data, is_letter, ends)
    later = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    points = length - (later[first + length] - later[first])
    keep = points >= min_length
    first, length, text, points = first[keep], length[keep], text[keep], points[keep]
    if not len(first):
        return None
    shortened: list[str] = []
    if noise:
        crc = checksums(data, first, length, states[text])
        hit = crc % np.uint32(noise) == 0
        for i in np.flatnonzero(hit):
            word = data[first[i] : first[i] + length[i]].tobytes().decode()
            at = int(crc[i]) % len(word)
            if len(word) > min_length:
                shortened.append(word[:at] + word[at + 1 :])
        first, length = first[~hit], length[~hit]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[ranges(first, length)]))
    found = pc.value_counts(pa.concat_arrays([words, pa.array(shortened, pa.string())]))
    return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = None, piece: int = PIECE) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and how often they occur, if ``min_count`` times."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, limit=piece):
                rows = batch.slice(lo, hi - lo)
                raw, ends = bytes_of(rows.column("text"))
                data = LOWER[raw]
                is_letter = letters(data)
                states = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in rows.column("id").to_pylist()], np.uint32)
                at = cuts_between(is_letter, ends, piece)
                for a, b in zip(at, at[1:]):
                    t, u = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, b, side="left")
                    own = counted(data[a:b], is_letter[a:b], np.clip(ends[t : u + 1] - a, 0, b - a), states[t:u], min_length, noise)
                    if own is not None:
                        yield own

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def parity(word: Column) -> Column:
    """Mask of the letters that occur an odd number of times; letters share ``BITS`` bits by code point."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % BITS)))


def band(i: int) -> Column:
    """The bits of a band: every third, so that neighbours in the alphabet fall into different ones."""
    return F.lit(sum(1 << b for b in range(i, BITS, BANDS))).cast("bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of (word, n) that are one edit apart, each once; words are distinct."""
    own = words.select("word", "n", F.length("word").alias("size"), parity(F.col("word")).alias("mask"))

    def keys(short: Column) -> list[Column]:
        """Keys of a word where the shorter word's size is ``short``."""
        half = F.floor(short / 2).cast("int")
        kept = (F.substr("word", F.lit(1), half), F.substr("word", F.col("size") - half + 1, half))
        return [F.struct(F.lit(h * BANDS + i).alias("slot"), F.xxhash64(F.lit(h * BANDS + i), short, F.col("mask").bitwiseAND(band(i)), kept[h]).alias("key")) for h in range(2) for i in range(BANDS)]

    side = lambda name, ks: own.select(F.explode(F.array(*ks)).alias("k"), "*").select(F.col("k.key").alias("key"), F.col("k.slot").alias("slot"), F.struct("word", "n", "size", "mask").alias(name)).select("key", "slot", *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("word", "n", "size", "mask")])
    # a is the shorter word, or the first of two of one size
    one, two = side("a", keys(F.col("size"))), side("b", [*keys(F.col("size")), *keys(F.col("size") - 1)]).drop("slot")
    longer = F.col("b_size") - F.col("a_size")
    differ = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    in_band = [differ.bitwiseAND(band(i)) == 0 for i in range(BANDS)]
    head = F.substr("a_word", F.lit(1), F.floor(F.col("a_size") / 2).cast("int")) == F.substr("b_word", F.lit(1), F.floor(F.col("a_size") / 2).cast("int"))
    i, h = F.col("slot") % BANDS, F.floor(F.col("slot") / BANDS)
    first_band = F.when(in_band[0], 0).when(in_band[1], 1).otherwise(2)
    met = (longer == 1) | ((longer == 0) & (F.col("a_word") < F.col("b_word")))
    met = met & (F.bit_count(differ) <= 2 - longer) & (i == first_band) & (h == F.when(head, 0).otherwise(1))
    # both sides are several rows a word, which their estimated sizes don't count
    return one.hint("merge").join(two, "key").where(met & (F.levenshtein("a_word", "b_word", 1) == 1)).select("a_word", "a_n", "b_word", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms of forms end. Forms must not lead back."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(hot_join(now, ahead.hint("merge"), ["root"], "word").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_cut(now)
        now = moved
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def group(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """Per row of (word, n): word, form, root, n, n_near, form_n."""
    with scratch():
        return cut(_grouped(words, ratio), outside=True)


def _grouped(words: DataFrame, ratio: int) -> DataFrame:
    words = cut(words)
    both = F.explode(F.array(*[F.struct(F.col(f"{x}_word").alias("word"), (-F.col(f"{y}_n")).alias("less"), F.col(f"{y}_word").alias("other")) for x, y in ("ab", "ba")])).alias("x")
    best = near_pairs(words).select(both).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    formed = cut(words.join(best.hint("merge"), "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = None) -> DataFrame:
    """Words of all texts with their forms and roots."""
    return group(vocabulary(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count, noise=noise), ratio=ratio)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_spelling_variants: words of all documents and their forms."""
    return variants(table(spark, sf_dir, "documents"), noise=NOISE)


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END))), lambda s, b: xor(s >> 8, list_reduce(list_prepend(xor(s, b) & 255, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295)"
#: DuckDB's levenshtein counts bytes, so U+00C0 to U+00FF stand as one byte each: those from "!" to "`", which no word has.
_ONE_BYTE = "translate({0}, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(map(chr, range(33, 97))).replace("'", "''") + "')"
ORACLE_SQL = f"""WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS k FROM found WHERE length(w) >= {MIN_LENGTH} GROUP BY ALL),
summed AS MATERIALIZED (SELECT w, k, {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM own),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN w[: CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2 :] ELSE w END AS word, k FROM summed),
words AS MATERIALIZED (SELECT word, {_ONE_BYTE.format('word')} AS bytes, CAST(sum(k) AS BIGINT) AS n FROM noisy WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
near AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word WHERE levenshtein(a.bytes, b.bytes) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s USING (word) JOIN formed e ON e.word = s.at WHERE e.form IS NULL"""
