"""N-gram Jaccard join: prefix filters under several global orders, then exact sets.

A document's set holds its distinct word n-grams as 64-bit hashes. Two sets of
similarity t share at least t times the larger set, so under any global order
of the n-grams their prefixes share some. Three orders are used: rare n-grams
first (by a fixed-size table of counts over the whole corpus), and two orders
by independent hashes. The first order's prefixes are indexed; they are longer
by ``MORE`` n-grams so that a pair must share that many of them and one more,
at places that leave enough behind them to be shared.
Pairs that survive must share prefix n-grams under the other two orders as
well, and those that do are verified on the whole sets.

Equal sets collapse into one class first; a class of any size is summed up in
parts, and its documents take its component in parts too. Links are wanted for their
components, so pairs inside a component known already needn't be verified:
a first pass compares each document only with the smallest document of the
n-gram's bucket that it meets most often, which joins large groups of near
copies without listing their pairs; a second pass takes all pairs of documents
that meet in a bucket but lie in different components. No bucket is capped.

Edge cases: null and empty texts have no n-grams, link with nothing and are
their own component; texts with fewer words than n are one n-gram; rows with
equal ids are one node of the graph, linked by any of their texts; rows with a
null id have a null component unless their text equals another's; of n-grams
that tie in an order the smaller hash comes first; texts of any length are read
whole; other columns are ignored, whatever their names; an empty table has an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import Words, bytes_of, cut, drop_cut, hot_join, mix, ranges, scratch, shared, slices, table, with_least
from cyclarium.llm.components import components

#: Bytes between words.
SEPARATORS = b"\x20\t\n\v\f\r"
#: Slots of the table of counts (a power of two), and the n-grams by which an indexed prefix is longer.
SLOT_BITS, MORE = 18, 1
#: Classes of a set's tally.
TALLY = 256
#: Documents (of about 100 bytes in memory) whose ids may be broadcast.
BROADCAST_ROWS = 500_000
ORDERS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35))


class Grams:
    """Sets of hashed word n-grams of many texts at once."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, Words(SEPARATORS)
        self.factors = np.random.default_rng(99).integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _join(self, hashed: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), np.uint64(n))
        for k in range(n):
            out = mix(out + hashed[starts + k] * self.factors[k])
        return out

    def every(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in turn, and the index of each text's first (one more at the end)."""
        _, _, hashed, begin = self.words(data, ends)
        size = np.diff(begin)
        count = np.where(size >= self.n, size - self.n + 1, (size > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(at[-1], np.uint64)
        full = np.flatnonzero(size >= self.n)
        if len(full):
            out[ranges(at[full], count[full])] = self._join(hashed, self.n, ranges(begin[full], count[full]))
        for few in range(1, self.n):
            short = np.flatnonzero(size == few)
            if len(short):
                out[at[short]] = self._join(hashed, few, begin[short])
        return out, at

    def sets(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Distinct n-grams of each text."""
        out, at = self.every(data, ends)
        return [np.unique(out[a:b]) for a, b in zip(at, at[1:])]


def least_shared(n: int, percent: int) -> int:
    """N-grams that a set of ``n`` shares with any similar one."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int, more: int) -> int:
    shared = least_shared(n, percent)
    return n - shared + min(more + 1, shared)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams fall into each slot of a table of fixed size, over all texts; each task counts its own first."""
    grams = Grams(n)

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for lo, hi in slices(batch):
                hashed, _ = grams.every(*bytes_of(batch.slice(lo, hi - lo).column("text")))
                total += np.bincount((hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    got = docs.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def described(docs: DataFrame, n: int, percent: int, more: int) -> DataFrame:
    """Per row of (id, text): id, n, a 128-bit digest of the set (s, r), and its prefix under the first order."""
    kind = docs.schema["id"].dataType.simpleString()
    counts = shared(docs.sparkSession, frequencies(docs, n))
    grams = Grams(n)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                sets = grams.sets(*bytes_of(rows.column("text")))
                prefixes = []
                for x in sets:
                    size = prefix_size(len(x), percent, more) if len(x) else 0
                    often = counts.value[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    prefixes.append(x[np.argsort(often, kind="stable")[:size]])
                s = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
                r = np.array([mix(x ^ ORDERS[0]).sum(dtype=np.uint64) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([len(x) for x in sets], pa.int64()), _signed(s), _signed(r), _lists(prefixes)], ["id", "n", "s", "r", "prefix"])

    return docs.mapInArrow(run, f"id {kind}, n bigint, s bigint, r bigint, prefix array<bigint>")


def detailed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of (id, text): id, the prefixes under the other orders, the set's tally, and the whole set.

    The tally counts a set's n-grams in ``TALLY`` classes by hash. Two sets
    share at most the sum of the smaller counts.
    """
    kind = docs.schema["id"].dataType.simpleString()
    grams = Grams(n)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                sets = grams.sets(*bytes_of(rows.column("text")))
                others = [[x[np.argsort(mix(x ^ o))[: prefix_size(len(x), percent, 0)]] for x in sets] for o in ORDERS]
                tallies = pa.array([np.bincount((x >> np.uint64(8)).astype(np.int64) % TALLY, minlength=TALLY) for x in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), *map(_lists, others), tallies, _lists(sets)], ["id", "second", "third", "tally", "grams"])

    return docs.mapInArrow(run, f"id {kind}, second array<bigint>, third array<bigint>, tally array<int>, grams array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that share prefixes under the other orders and are similar; some repeat where ids do.

    Nothing is grouped right after a join, so that Spark can split an id that has many pairs.
    """
    with scratch():
        return cut(_verified(pairs, docs, n, percent), outside=True)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    few = ids.count() <= BROADCAST_ROWS
    known = cut(detailed(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi"), n, percent))
    side = lambda x, columns, of=known: of.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    columns = ["second", "third", "tally"]
    some = pairs.join(side("a", columns), "a").join(side("b", columns), "b")
    total = lambda x: F.aggregate(x, F.lit(0), lambda m, v: m + v)
    at_most = total(F.zip_with("a_tally", "b_tally", lambda p, q: F.least(p, q)))
    possible = 100 * at_most >= percent * (total(F.col("a_tally")) + total(F.col("b_tally")) - at_most)
    some = cut(some.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third") & possible).select("a", "b")).distinct()
    left = cut(some.select(F.col("a").alias("id")).union(some.select(F.col("b").alias("id"))).distinct())
    known = known.join(F.broadcast(left) if few else left, "id", "left_semi")
    both = some.join(side("a", ["grams"], known), "a").join(side("b", ["grams"], known), "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    every = F.size("a_grams") + F.size("b_grams") - shared
    return both.where(100 * shared >= percent * every).select("a", "b")


def _similar_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _enough(a: str, b: str, percent: int, more: int):
    """How many n-grams of their prefixes two sets of these sizes share at least."""
    shared = lambda c: F.least(F.lit(more + 1), F.floor((percent * F.col(c) + 99) / 100))
    return F.least(shared(a), shared(b))


def _in_reach(a: str, b: str, place_a, place_b, percent: int, slack: int):
    """Whether sets of sizes ``a`` and ``b`` can be similar if the (``slack`` + 1)-th n-gram that they share has these places in their orders.

    What stands before the first shared n-gram in either set isn't in the
    other, so at most the rest is shared.
    """
    needed = F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))
    return F.least(F.col(a) - place_a, F.col(b) - place_b) + slack >= needed


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, more: int = MORE) -> DataFrame:
    """Per document: ``id_col``, n_shingles, component_id; similar means a Jaccard similarity of ``percent`` / 100."""
    with scratch():
        return cut(_joined(docs, id_col, text_col, n, percent, more), outside=True)


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, more: int) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = cut(described(docs, n, percent, more))
    key = ["n", "s", "r"]
    member = cut(with_least(every.where("n > 0").select("id", *key), key, "id").select("id", *key, "rep"))
    copies = member.where("id <> rep").select("id", *key)
    few = copies.count() <= BROADCAST_ROWS
    own = cut(every.where("n > 0").join(F.broadcast(copies) if few else copies, ["id", *key], "left_anti").select("id", "n", F.posexplode("prefix").alias("place", "gram")))
    met = own.groupBy("gram").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("gram", "pivot")
    live = cut(own.join(met, "gram").select("gram", "id", "n", "place", "pivot"))
    pivots = live.where("id = pivot").groupBy("gram").agg(F.min("n").alias("pivot_n"), F.min_by("place", "n").alias("pivot_place"))
    near = live.where("id <> pivot").join(pivots, "gram")
    near = near.where(_similar_sizes("n", "pivot_n", percent) & _in_reach("n", "pivot_n", F.col("place"), F.col("pivot_place"), percent, more))
    near = near.groupBy("id", "n", "pivot", "pivot_n").agg(F.count("*").alias("shared"), F.min("place").alias("place"), F.min("pivot_place").alias("pivot_place"))
    near = near.where((F.col("shared") >= _enough("n", "pivot_n", percent, more)) & _in_reach("n", "pivot_n", F.col("place"), F.col("pivot_place"), percent, 0))
    drop_cut(own)
    best = near.groupBy("id").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"))
    links = verified(best.select(F.col("pivot").alias("a"), F.col("id").alias("b")), docs, n, percent)
    groups = components(links)

    # What still meets across components.
    known = live.select("gram", "id", "n", "place").join(groups, "id", "left").select("gram", "id", "n", "place", F.coalesce("component", "id").alias("group"))
    mixed = known.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("gram")
    known = cut(known.join(mixed, "gram", "left_semi"))
    drop_cut(live)
    sizes = known.groupBy("gram", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest"))
    x, y = (sizes.select("gram", *[F.col(c).alias(f"{c}_{k}") for c in ("group", "least", "most", "rest")]) for k in ("a", "b"))
    in_reach = F.least("rest_a", "rest_b") + more >= F.ceil(percent * (F.col("least_a") + F.col("least_b")) / (100 + percent))
    meet = x.join(y, "gram").where((F.col("group_a") < F.col("group_b")) & (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a")) & in_reach).select("gram", "group_a", "group_b")
    x, y = (known.select("gram", F.col("group").alias(f"group_{k}"), F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("place").alias(f"place_{k}")) for k in ("a", "b"))
    across = meet.join(x, ["gram", "group_a"]).join(y, ["gram", "group_b"]).where(_similar_sizes("n_a", "n_b", percent) & _in_reach("n_a", "n_b", F.col("place_a"), F.col("place_b"), percent, more))
    across = across.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"), F.min("place_a").alias("place_a"), F.min("place_b").alias("place_b"))
    across = across.where((F.col("shared") >= _enough("n_a", "n_b", percent, more)) & _in_reach("n_a", "n_b", F.col("place_a"), F.col("place_b"), percent, 0))
    more_links = verified(across.select("a", "b"), docs, n, percent)

    # An id with several texts ties their classes.
    by_id = cut(member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")))
    several = by_id.where("low <> high")
    tied = several.select(F.col("low").alias("a"), F.col("high").alias("b")).union(several.select("low", "id"))
    tied = tied.union(member.join(several.select("id"), "id", "left_semi").select("rep", "id"))
    found = components(links.union(more_links).union(tied))
    full = hot_join(member.select("id", "n", "rep"), found.select(F.col("id").alias("rep"), "component"), ["rep"], "id").select("id", "n", F.coalesce("component", "rep").alias("component"))
    bare = every.where("n = 0").select("id", "n").join(by_id.select("id", F.col("low").alias("rep")), "id", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    out = full.union(bare.select("id", "n", F.coalesce("component", "rep", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents with the smallest id of each component; rows with a null id all stay, of rows with equal ids one."""
    with scratch():
        judged = join(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
        gone = cut(judged.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), outside=True)
        unique = judged.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    few = gone.count() <= broadcast_rows
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    if unique:
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_ngram_jaccard: components of all documents by their 3-word shingles at 0.9."""
    return join(table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, least(len(w), 3) AS n, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS k FROM docs WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS gram FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams AS x JOIN grams AS y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT docs.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(docs.doc_id, coalesce(low, docs.doc_id)) AS component_id
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) AS lows ON lows.a = docs.doc_id
"""
