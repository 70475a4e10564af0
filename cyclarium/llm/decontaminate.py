"""Benchmark decontamination with a generalised suffix automaton.

The items' word sequences form one generalised suffix automaton. Training
texts stream through it word by word; the automaton's state and match length
are the longest suffix read so far that occurs in any item. Where that length
reaches the window, the last ``window`` words are an item's words (items
shorter than the window count as a whole).

Most words never come near a match, so arrays find the runs of words whose
neighbours are neighbours in some item; only runs of at least the shortest
window go through the automaton, which yields the same matches as reading all.

Items beyond ``SHARD_BYTES`` make several automata. Then a Bloom filter of all
items' windows first finds the texts that may hold one, and only these are read
by each automaton in turn; the corpus is read twice, however many items there are.

Edge cases: null or empty texts have no words and no hits; items without words
never occur; items without an id are ignored; repeated items and documents are
judged alike, each row by itself; a coverage that meets the limit exactly is
allowed; texts of any length are read whole; an empty table has an empty
result; other columns pass through ``remove`` untouched, whatever their names,
and ``scan`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclarium.llm._common import Words, bytes_of, cut, drop_cut, fresh, mix, ranges, scratch, shared, slices, table

#: Bytes that separate words once A-Z are a-z: all of ASCII but digits and letters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WINDOW = 10
#: Bytes of item text in one automaton; more items make more automata, applied in turn.
SHARD_BYTES = 2 << 20
#: Bits of the Bloom filter for each window, and how many of them each window sets.
BITS, PROBES = 32, 4


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of word numbers."""

    def __init__(self) -> None:
        self.length, self.link, self.step = [0], [-1], {}

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, old: int, edges: list[set]) -> int:
        """The state for the shorter strings of ``old``, which ``word`` reaches from ``at``."""
        copy = self._state(self.length[at] + 1, self.link[old])
        edges.append(set(edges[old]))
        for w in edges[old]:
            self.step[copy << 32 | w] = self.step[old << 32 | w]
        self.link[old] = copy
        while at >= 0 and self.step.get(at << 32 | word) == old:
            self.step[at << 32 | word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[int], edges: list[set]) -> None:
        """Insert one sequence; ``edges`` holds the words that leave each state while building."""
        last = 0
        for word in words:
            to = self.step.get(last << 32 | word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to, edges)
                continue
            new, at = self._state(self.length[last] + 1, 0), last
            edges.append(set())
            while at >= 0 and (at << 32 | word) not in self.step:
                self.step[at << 32 | word] = new
                edges[at].add(word)
                at = self.link[at]
            if at >= 0:
                to = self.step[at << 32 | word]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to, edges)
            last = new

    def read(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match length) after each word."""
        step, link, length, state, size = self.step, self.link, self.length, 0, 0
        for word in words:
            to = step.get(state << 32 | word)
            while to is None and state > 0:
                state = link[state]
                size = length[state]
                to = step.get(state << 32 | word)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            yield state, size


class Matcher:
    """Finds items' windows in texts."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.window, self.words = window, Words(SEPARATORS)
        hashed: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = self.words(data, np.array([0, len(data)]))[2]
            if len(h):
                hashed.setdefault(item, []).append(h)
        every = [h for hs in hashed.values() for h in hs]
        self.vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.least = min((min(len(h), window) for h in every), default=0)
        self.automaton, edges = SuffixAutomaton(), [set()]
        sequences = {k: [np.searchsorted(self.vocabulary, h).tolist() for h in hs] for k, hs in hashed.items()}
        pairs = set()
        for rows in sequences.values():
            for row in rows:
                self.automaton.add(row, edges)
                pairs.update(a << 32 | b for a, b in zip(row, row[1:]))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.known = [self._flags(self.vocabulary), self._flags(self.pairs.astype(np.uint64))]
        self._owners(sequences)

    @staticmethod
    def _flags(values: np.ndarray) -> np.ndarray:
        """A table by low bits that rules most absent values out."""
        bits = np.zeros(1 << 20, bool)
        bits[Matcher._slot(values)] = True
        return bits

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _within(self, values: np.ndarray, among: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Index in the sorted ``among``, or -1."""
        out = np.full(len(values), -1, np.int64)
        if len(among):
            maybe = np.flatnonzero(known[self._slot(values.astype(np.uint64))])
            at = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
            out[maybe] = np.where(among[at] == values[maybe], at, -1)
        return out

    def _owners(self, sequences: dict[int, list[list[int]]]) -> None:
        """Items by the state of their windows, and the way from each state to those states."""
        a, window = self.automaton, self.window
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__)
        self.at_window, self.short_at = [0] * len(a.length), [0] * len(a.length)
        for s in order:
            self.at_window[s] = 0 if a.length[s] < window else s if a.length[a.link[s]] < window else self.at_window[a.link[s]]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, rows in sequences.items():
            for row in rows:
                path = [s for s, _ in a.read(row)]
                if len(row) < window:
                    self.short.setdefault(path[-1], {}).setdefault(len(row), set()).add(item)
                for s in path[window - 1 :]:
                    self.items.setdefault(self.at_window[s], set()).add(item)
        for s in order:
            self.short_at[s] = s if s in self.short else self.short_at[a.link[s]]

    def _run(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit ranges of word positions, the items, and the longest match."""
        a, window, hits, found, longest = self.automaton, self.window, [], set(), 0
        for i, (state, size) in enumerate(a.read(words)):
            reach = 0
            longest = max(longest, size)
            if size >= window:
                reach = window
                found |= self.items[self.at_window[state]]
            s = self.short_at[state]
            while s > 0:
                for n, items in self.short[s].items():
                    if n <= (size if s == state else a.length[s]):
                        reach = max(reach, n)
                        found |= items
                s = self.short_at[a.link[s]]
            if reach:
                if hits and hits[-1][1] >= i + 1 - reach:
                    start = min(hits[-1][0], i + 1 - reach)
                    hits[-1] = (start, i + 1)
                    while len(hits) > 1 and hits[-2][1] >= start:
                        hits[-2:] = [(min(hits[-2][0], start), i + 1)]
                        start = hits[-1][0]
                else:
                    hits.append((i + 1 - reach, i + 1))
        return hits, found, longest

    def scan(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, int, int]], set[int], int]]]:
        """Words of each text; for texts with hits: (first byte, end byte, first word, end word) of each hit range, items, longest match."""
        first, last, hashed, begin = self.words(data, ends)
        found: dict[int, tuple[list, set, int]] = {}
        if len(hashed) and self.least:
            word = self._within(hashed, self.vocabulary, self.known[0])
            joined = (word[:-1] >= 0) & (word[1:] >= 0)
            joined[begin[(begin > 0) & (begin < len(word))] - 1] = False
            some = np.flatnonzero(joined)
            joined[some] = self._within(word[some] << 32 | word[some + 1], self.pairs, self.known[1]) >= 0
            starts = np.flatnonzero((word >= 0) & ~np.concatenate([[False], joined]))
            stops = np.flatnonzero((word >= 0) & ~np.concatenate([joined, [False]])) + 1
            for i in np.flatnonzero(stops - starts >= self.least):
                lo, hi = int(starts[i]), int(stops[i])
                hits, items, longest = self._run(word[lo:hi].tolist())
                if hits:
                    k = int(np.searchsorted(begin, lo, side="right")) - 1
                    rows, every, most = found.get(k, ([], set(), 0))
                    at, byte = lo - int(begin[k]), int(ends[k])
                    rows = rows + [(int(first[lo + x]) - byte, int(last[lo + y - 1]) - byte, at + x, at + y) for x, y in hits]
                    found[k] = rows, every | items, max(most, longest)
        return np.diff(begin), found


class Sieve:
    """A Bloom filter of windows of words: texts without any of them are known for sure."""

    def __init__(self, texts: Iterable[str], n_bytes: int, window: int) -> None:
        self.window, self.words, self.sizes = window, Words(SEPARATORS), set()
        self.size = 1 << max(16, (BITS * n_bytes // 4).bit_length())
        bits = np.zeros(self.size, bool)
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            h = self.words(data, np.array([0, len(data)]))[2]
            n = min(window, len(h))
            if n:
                self.sizes.add(n)
                for slot in self._slots(h, n, np.arange(len(h) - n + 1)):
                    bits[slot] = True
        self.bits = np.packbits(bits)

    def _slots(self, hashed: np.ndarray, n: int, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the bits of each window of ``n`` words."""
        h = np.full(len(starts), np.uint64(n))
        for k in range(n):
            h = mix(h * np.uint64(3) + hashed[starts + k])
        for _ in range(PROBES):
            yield (h & np.uint64(self.size - 1)).astype(np.int64)
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and whether it may hold a window."""
        _, _, hashed, begin = self.words(data, ends)
        n_words = np.diff(begin)
        may = np.zeros(len(n_words), bool)
        for n in self.sizes:
            count = np.maximum(n_words - n + 1, 0)
            starts = ranges(begin[:-1], count)
            text = np.repeat(np.arange(len(count)), count)
            every = np.ones(len(text), bool)
            for slot in self._slots(hashed, n, starts):
                every &= (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
            may[text[every]] = True
        return n_words, may


SPAN = pa.struct([(x, pa.int64()) for x in ("start", "stop", "word", "word_stop")])


def shards(items: DataFrame, item_col: str, text_col: str, limit: int = SHARD_BYTES) -> list[DataFrame]:
    """The items in parts of about ``limit`` bytes of text at most."""
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit) or 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def _sieved(sieve, text_col: str, maybe: bool):
    """The function for mapInArrow that keeps the texts which may hold a window, or the others."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in slices(batch, text_col):
                rows = batch.slice(lo, hi - lo)
                may = sieve.value(*bytes_of(rows.column(at)))[1]
                if (may == maybe).any():
                    yield rows.filter(pa.array(may == maybe))

    return run


def sieve_of(items: DataFrame, item_col: str, text_col: str, window: int):
    """The broadcast filter of all items."""
    texts = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return shared(items.sparkSession, Sieve((r[0] for r in texts.toLocalIterator()), n_bytes, window))


def matcher_of(part: DataFrame, window: int):
    """The broadcast automaton of one shard."""
    return shared(part.sparkSession, Matcher([tuple(r) for r in part.toLocalIterator()], window))


def _finder(known, first: bool, keep_text: bool):
    """The function for mapInArrow that adds one automaton's matches."""

    def find(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                n_words, found = known.value.scan(*bytes_of(rows.column("text")))
                hits = [found.get(i, ([], (), 0)) for i in range(len(n_words))]
                spans, owners, longest = [x[0] for x in hits], [sorted(x[1]) for x in hits], [x[2] for x in hits]
                if not first:
                    before = [rows.column(x).to_pylist() for x in ("spans", "items", "longest")]
                    spans = [merged([tuple(x.values()) for x in a] + b) for a, b in zip(before[0], spans)]
                    owners = [sorted({*a, *b}) for a, b in zip(before[1], owners)]
                    longest = [max(a, b) for a, b in zip(before[2], longest)]
                columns = [rows.column("id"), pa.array(n_words, pa.int64()), pa.array([[dict(zip(("start", "stop", "word", "word_stop"), x)) for x in a] for a in spans], pa.list_(SPAN)), pa.array(owners, pa.list_(pa.int64())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [rows.column("text")] * keep_text, ["id", "n_words", "spans", "items", "longest", "text"][: 5 + keep_text])

    return find


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: ``id_col``, n_words, spans, items, longest.

    A span is a hit range: bytes [start, stop) and words [word, word_stop).
    ``longest`` is the longest match, 0 without hits. Items are integers. With
    items beyond one shard, texts that may hold a window are kept in the shared
    folder while each shard adds to what the ones before have found.
    """
    parts = shards(items, item_col, item_text, shard_bytes)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_words bigint, spans array<struct<start:bigint,stop:bigint,word:bigint,word_stop:bigint>>, items array<bigint>, longest bigint"
    if len(parts) == 1:
        out = docs.mapInArrow(_finder(matcher_of(parts[0], window), True, False), schema)
    else:
        sieve = sieve_of(items, item_col, item_text, window)
        out = cut(docs.mapInArrow(_sieved(sieve, "text", True), docs.schema))
        for k, part in enumerate(parts):
            with scratch():
                found = cut(out.mapInArrow(_finder(matcher_of(part, window), k == 0, True), schema + ", text string"), outside=True)
            drop_cut(out)
            out = found
        nothing = Matcher([], window)
        bare = docs.mapInArrow(_sieved(sieve, "text", False), docs.schema).mapInArrow(_finder(shared(docs.sparkSession, nothing), True, False), schema)
        out = out.drop("text").union(bare)
    return out.withColumnRenamed("id", id_col)


def merged(spans: list[tuple]) -> list[tuple]:
    """Hit ranges joined where their words touch or overlap."""
    out: list[list[int]] = []
    for start, stop, word, word_stop in sorted(spans, key=lambda x: x[2]):
        if out and word <= out[-1][3]:
            out[-1][1], out[-1][3] = max(out[-1][1], stop), max(out[-1][3], word_stop)
        else:
            out.append([start, stop, word, word_stop])
    return [tuple(x) for x in out]


def without(text: str, spans: list[tuple]) -> str:
    """The text without the bytes of hit ranges that are in order and apart."""
    raw = text.encode()
    for start, stop, _, _ in reversed(spans):
        raw = raw[:start] + raw[stop:]
    return raw.decode()


def _remover(known, text_col: str, earlier: bool, last: bool, alone: bool, most: float, mark: str = ""):
    """The function for mapInArrow that adds one automaton's hit ranges to the ``earlier`` ones.

    The ``last`` automaton's pass drops texts with more than ``most`` of their
    words hit and cuts the hits from the others; if it is not ``alone`` it tells
    which texts to read again, else it reads them itself. ``mark`` is the added column.
    """

    def spans_of(text: str) -> list[tuple]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return merged(known.value.scan(raw, np.array([0, len(raw)]))[1].get(0, ([],))[0])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in slices(batch, text_col):
                rows = batch.slice(lo, hi - lo)
                n_words, found = known.value.scan(*bytes_of(rows.column(at)))
                spans = {i: merged(x[0]) for i, x in found.items()}
                if earlier:
                    before = {i: [tuple(x.values()) for x in xs] for i, xs in enumerate(rows.column(rows.num_columns - 1).to_pylist()) if xs}
                    spans = {i: merged(before.get(i, []) + spans.get(i, [])) for i in {*before, *spans}}
                columns, names = rows.columns[: rows.num_columns - earlier], batch.schema.names[: rows.num_columns - earlier]
                if not last:
                    own = pa.array([[dict(zip(("start", "stop", "word", "word_stop"), x)) for x in spans.get(i, ())] for i in range(rows.num_rows)], pa.list_(SPAN))
                    yield pa.RecordBatch.from_arrays([*columns, own], [*names, mark])
                    continue
                keep, again = np.ones(rows.num_rows, bool), np.zeros(rows.num_rows, bool)
                if spans:
                    texts = columns[at].to_pylist()
                    for i, hits in spans.items():
                        keep[i] = sum(x[3] - x[2] for x in hits) <= most * n_words[i]
                        again[i] = True
                        while keep[i] and hits:
                            texts[i] = without(texts[i], hits)
                            hits = spans_of(texts[i]) if alone else []
                    columns[at] = pa.array(texts, batch.schema.field(at).type)
                out = pa.RecordBatch.from_arrays(columns + [pa.array(again)] * (not alone), names + [mark] * (not alone))
                yield out if keep.all() else out.filter(pa.array(keep))

    return run


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, *, max_coverage: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without the items' passages.

    A document of which more than ``max_coverage`` of the words are hit goes.
    From the others each hit range goes, its first word's start to its last
    word's end, ranges that touch as one; what that joins is read again until
    nothing more is found. All columns stay; a column ``n_chars`` follows the
    text. With items beyond one shard, texts that may hold a window make a pass
    of each: hits of all shards are found on the same text, judged and cut
    together, and texts with cuts are read again by all shards. The results of
    passes are kept in the shared folder.
    """
    columns, schema = docs.columns, docs.schema
    parts = shards(items, item_col, item_text, shard_bytes)
    if len(parts) == 1:
        docs = docs.mapInArrow(_remover(matcher_of(parts[0], window), text_col, False, True, True, max_coverage), schema)
    else:
        sieve = sieve_of(items, item_col, item_text, window)
        done = [docs.mapInArrow(_sieved(sieve, text_col, False), schema)]
        spans, again = (fresh(x, columns) for x in ("spans", "again"))
        marked = T.StructType([*schema.fields, T.StructField(spans, T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "stop", "word", "word_stop")])))])
        ended = T.StructType([*schema.fields, T.StructField(again, T.BooleanType())])
        rest, most = cut(docs.mapInArrow(_sieved(sieve, text_col, True), schema)), max_coverage
        while not rest.isEmpty():
            for k, part in enumerate(parts):
                last = k + 1 == len(parts)
                with scratch():
                    found = cut(rest.mapInArrow(_remover(matcher_of(part, window), text_col, k > 0, last, False, most, again if last else spans), ended if last else marked), outside=True)
                if k:
                    drop_cut(rest)
                rest = found
            done.append(rest.where(~F.col(again)).select(*columns))
            rest, most = rest.where(again).select(*columns), 1.0
        docs = reduce(DataFrame.union, done)
    return docs.select(*[F.length(text_col).cast(schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_decontaminate: windows of the benchmark in all documents."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["word_stop"] - s["word"])
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} FROM documents),
items AS (SELECT item_id, {_WORDS} FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS said FROM starts),
places AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) AS sizes WHERE len(w) >= n),
hits AS (SELECT row, k, places.n AS n, item_id FROM places JOIN windows ON places.n = windows.n AND array_to_string(w[k:k + places.n - 1], ' ') = said),
covered AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS place FROM hits) AS each_place GROUP BY row),
owners AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) AS each_item GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN owners USING (row)
"""
