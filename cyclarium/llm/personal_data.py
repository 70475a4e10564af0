"""Personal data: fixed patterns, and identifiers found by the contexts that these patterns' matches share.

Four patterns give the base findings: mail addresses, IPv4 addresses, card and
phone numbers. They are the seeds of a bootstrap for identifiers that no
pattern knows (account, passport or local phone numbers, handles):

1. Each text is read once for its seeds, for its candidates (groups of digits,
   and words with digits or "@", outside of the seeds) and for the contexts of
   both: the two and the three tokens before, and those behind. Tokens are runs
   of letters, runs of digits (all alike) and single signs; a context is a
   lexical pattern with a slot.
2. Contexts that hold several different instances are the patterns, and seeds
   and candidates their instances: a graph, kept as a table of edges.
3. A second pass counts how often the patterns' tokens occur at all, with
   whatever in their slot. A filter of fixed size says which tokens to count;
   what it lets through in error falls out of the join.
4. Rounds of joins and sums score the graph. A pattern's confidence is the
   share of its slots that hold instances known by then, an instance's score
   the chance that one of its trusted patterns is right (noisy or). Patterns
   with enough known instances and confidence are trusted; what they find makes
   further patterns trusted in the next round.
5. Candidates in the slot of a trusted pattern are findings of kind "context".

No text moves: spans, contexts' hashes and counts do, and only those of seeds
and candidates.

Edge cases: null texts are empty; empty texts have no findings and the digest
of the empty string; whole texts are read, very long ones in pieces where
arrays are made of them, and no pattern takes more than a bounded number of
looks at a character; repeated rows are judged alike; of findings that begin
at one place the kinds' order decides; copies of a text add occurrences to a
pattern but no instances; an empty table has an empty result; other columns
are ignored, whatever their names. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import bytes_of, cut, cuts_between, hot_join, mix, scratch, shared, short_reads, slices, small_batches, table
from cyclarium.llm.secret_scan import Spans

#: Kinds in the order in which findings at one place are listed.
KINDS = ("email", "ip", "card", "phone", "context")
#: The patterns, written so that no text makes them look again and again at the same characters.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
#: Candidates: words around a digit or "@", and groups of digits.
ANCHOR = re.compile(r"[0-9@]")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._/-")
WORD_ON = re.compile(r"[A-Za-z0-9@._/-]*+")
NUMBER = re.compile(r"[0-9]++(?:[\x20()./-]{1,2}[0-9]++)*+")
MIN_DIGITS, MAX_LENGTH = 5, 64
#: Tokens of a context.
ORDERS = (2, 3)
#: Known instances that a pattern needs, its confidence, what an unknown candidate weighs against it, and the rounds.
SUPPORT, CONFIDENCE, UNKNOWN, ROUNDS = 3, 0.5, 0.1, 4
#: Bytes whose tokens are made at a time.
PIECE = 1 << 20
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
#: 64-bit words of the filter.
FILTER = 1 << 16

# ---- base findings ----


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, "@" and a domain with a dot."""
    at, end = text.find("@"), 0
    while at >= 0 and (m := DOMAIN.search(text, at)):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            at = end = m.end()
        else:
            at = m.start() + 1


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns' findings."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    small = lambda part: len(own := part.lstrip("0")) <= 3 and int(own or 0) <= 255
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            own = only_digits(m[0])
            if CARD_DIGITS[0] <= len(own) <= CARD_DIGITS[1] and luhn(own):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(only_digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that look like identifiers and overlap none of ``taken``."""
    out, own, pos = [], Spans((a, b) for a, _, b in taken), 0
    while m := ANCHOR.search(text, pos):
        start = m.start()
        while start > pos and text[start - 1] in WORD:
            start -= 1
        end = WORD_ON.match(text, m.start()).end()
        while start < end and text[start] in "._/-":
            start += 1
        if number := NUMBER.match(text, start):
            end = max(end, number.end())
        pos = end
        while end > start and text[end - 1] in "._/-":
            end -= 1
        if end - start <= MAX_LENGTH and not own.meets(start, end):
            word = text[start:end]
            if sum(map(str.isdigit, word)) >= MIN_DIGITS or "@" in word.strip("@"):
                out.append((start, end))
    return out


def instance(kind: str, text: str) -> int:
    """A 63-bit number of an identifier, whatever its case and separators."""
    raw = f"{kind}:{''.join(c for c in text.lower() if c.isalnum() or c == '@')}".encode()
    return zlib.crc32(raw) << 31 | zlib.crc32(raw, 0x5EED) >> 1


# ---- tokens and contexts ----

#: Kinds of bytes: blanks, letters (all beyond ASCII among them), digits, signs.
BYTE_KIND = np.full(256, 3, np.uint8)
BYTE_KIND[:33] = 0
BYTE_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
BYTE_KIND[48:58] = 2
BYTE_VALUE = np.random.default_rng(20250117).integers(1, 2**63, 256, dtype=np.uint64)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BYTE_VALUE[:33] = 0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NUMBER_HASH = np.uint64(0x6A09E667F3BCC909)
LOW62 = np.uint64((1 << 62) - 1)


class Powers:
    """Powers of ``FACTOR`` modulo 2**64 and of its inverse, for as many bytes as are hashed at once."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (FACTOR, inverse))
        return cls.up[:n], cls.down


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and hash of each token, and for each text the index of its first token (one more at the end)."""
    kind = BYTE_KIND[data]
    starts = kind != 0
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    inner = ends[(ends > 0) & (ends < len(data))]
    starts[inner] = kind[inner] != 0
    first = np.flatnonzero(starts)
    if not len(first):
        return first, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    up, down = Powers.of(len(data))
    hashed = mix(np.add.reduceat(BYTE_VALUE[data] * up, first) * down[first])
    hashed[kind[first] == 2] = NUMBER_HASH
    return first, hashed, np.searchsorted(first, ends)


def grams(hashed: np.ndarray, order: int) -> np.ndarray:
    """62-bit hashes of ``order`` consecutive tokens; the first is that of the tokens from 0."""
    n = len(hashed) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, order, np.uint64)
    for i in range(order):
        out = mix(out * FACTOR + hashed[i : i + n])
    return out & LOW62


def all_grams(data: np.ndarray, ends: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Hashes of all contexts' tokens in the texts between ``ends``, text by text; a long text's in pieces."""
    longest = max(ORDERS)
    carried = np.zeros(0, np.uint64)
    at = cuts_between(BYTE_KIND[data] != 0, ends, piece)
    is_end = set(ends.tolist())
    for a, b in zip(at, at[1:]):
        t, u = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, b, side="left")
        _, hashed, own = tokens(data[a:b], np.clip(ends[t : u + 1] - a, 0, b - a))
        n = len(carried)
        hashed, own = np.concatenate([carried, hashed]), own + n
        own[0] = 0
        text = np.repeat(np.arange(len(own) - 1), np.diff(own))
        for order in ORDERS:
            made = grams(hashed, order)
            whole = text[: len(made)] == text[order - 1 :]
            whole[: max(0, n - order + 1)] = False  # those were counted with the piece before
            yield made[whole]
        carried = np.zeros(0, np.uint64) if b in is_end else hashed[own[-2] :][1 - longest :]


def contexts(text: str, spans: list[tuple[int, int]], piece: int = PIECE) -> list[list[int]]:
    """Patterns of each span: twice the hash of the tokens before it, or that of those behind it and one."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.array([0, len(data)])
    parts = cuts_between(BYTE_KIND[data] != 0, ends, piece)
    made = [(a, tokens(data[a:b], np.array([0, b - a]))) for a, b in zip(parts, parts[1:])]
    first, hashed = np.concatenate([a + x[0] for a, x in made]), np.concatenate([x[1] for _, x in made])
    points = np.array(spans, np.int64).reshape(-1, 2)
    if len(data) > len(text):
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[points]
    before, behind = np.searchsorted(first, points[:, 0]), np.searchsorted(first, points[:, 1])
    all_of = {order: grams(hashed, order) for order in ORDERS}
    out: list[list[int]] = []
    for i, j in zip(before.tolist(), behind.tolist()):
        own = [int(all_of[o][i - o]) << 1 for o in ORDERS if i >= o]
        out.append(own + [int(all_of[o][j]) << 1 | 1 for o in ORDERS if j + o <= len(hashed)])
    return out


# ---- passes over the texts ----

SPAN = "struct<start:bigint,kind:int,stop:bigint>"
FOUND = f"base array<{SPAN}>, seeds array<struct<inst:bigint,patterns:array<bigint>>>, others array<struct<start:bigint,stop:bigint,inst:bigint,patterns:array<bigint>>>"


def _found(text: str | None) -> tuple[list, list, list]:
    """Base spans, seeds and candidates of a text."""
    if not text or not ANCHOR.search(text):
        return [], [], []
    base = base_spans(text)
    more = candidates(text, base)
    around = contexts(text, [(a, b) for a, _, b in base] + more) if base or more else []
    seeds = [{"inst": instance(KINDS[k], text[a:b]), "patterns": p} for (a, k, b), p in zip(base, around)]
    others = [{"start": a, "stop": b, "inst": instance("other", text[a:b]), "patterns": p} for (a, b), p in zip(more, around[len(base) :])]
    return [{"start": a, "kind": k, "stop": b} for a, k, b in base], seeds, others


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, base, seeds, others): what the first pass reads from each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    patterns = ("patterns", pa.list_(pa.int64()))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    seed, other = pa.struct([("inst", pa.int64()), patterns]), pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("inst", pa.int64()), patterns])
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                found = [_found(t) for t in rows.column("text").to_pylist()]
                columns = [pa.array([x[i] for x in found], pa.list_(t)) for i, t in enumerate((span, seed, other))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), *columns], ["id", "base", "seeds", "others"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {FOUND}").withColumn("row", F.monotonically_increasing_id())


def bits_of(gram: Column) -> list[Column]:
    """The places of a gram in the filter."""
    return [F.pmod(gram, F.lit(FILTER * 64)), F.pmod(F.shiftright(gram, 31), F.lit(FILTER * 64))]


def filter_of(patterns: DataFrame) -> np.ndarray:
    """A filter of ``FILTER`` 64-bit words with the grams of (pattern): words are made in tasks, and there are no more of them, however many patterns."""
    gram = F.shiftright("pattern", 1)
    at = patterns.select(F.explode(F.array(*bits_of(gram))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("bits"))
    out = np.zeros(FILTER, np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def totals(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(gram, total): how often the grams of (pattern) occur in all texts; some others may be counted too."""
    words = shared(docs.sparkSession, filter_of(patterns))

    def run(batches):
        own = words.value
        size = np.uint64(FILTER * 64)

        def within(at: np.ndarray) -> np.ndarray:
            return (own[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) != 0

        held, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            """All counts of this task so far."""
            gram, at = np.unique(np.concatenate([held[0], *waiting]), return_inverse=True)
            n = np.bincount(at, np.concatenate([held[1], np.ones(len(at) - len(held[1]), np.int64)]), len(gram))
            waiting.clear()
            return gram, n.astype(np.int64)

        def rows(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], ["gram", "total"])

        for batch in batches:
            for lo, hi in slices(batch):
                for made in all_grams(*bytes_of(batch.slice(lo, hi - lo).column("text"))):
                    made = made[within(made % size)]
                    waiting.append(made[within((made >> np.uint64(31)) % size)])
                if sum(map(len, waiting)) >= HELD:
                    held = merged()
                if len(held[0]) >= HELD:
                    yield rows(*held)
                    held = held[0][:0], held[1][:0]
        yield rows(*merged())

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram bigint, total bigint").groupBy("gram").agg(F.sum("total").alias("total"))


# ---- the graph of patterns and instances ----


def edges_of(found: DataFrame) -> DataFrame:
    """(pattern, inst, seed, n): how often an instance stands in a pattern's slot."""
    one = lambda column, seed: found.select(F.explode(column).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.col("x.inst").alias("inst"), F.lit(seed).alias("seed"))
    return one("seeds", True).union(one("others", False)).groupBy("pattern", "inst", "seed").agg(F.count("*").alias("n"))


def scored(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the trusted patterns, of (pattern, inst, seed, n, total)."""
    instances = edges.select("inst", F.lit(0.0).alias("score")).where("false")
    for i in range(rounds):
        known = hot_join(edges, instances, ["inst"], "pattern").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).cast("double"))
        n, s = F.col("n"), F.col("s")
        sums = known.groupBy("pattern").agg(F.sum(n * s).alias("held"), F.sum(n * (1 - s)).alias("unknown"), F.sum(n).alias("slots"), F.count_if(s >= confidence).alias("instances"), F.max("total").alias("total"))
        # what isn't in a slot as seed or candidate is something else
        other = F.greatest(F.col("total") - F.col("slots"), F.lit(0))
        trusted = cut(sums.withColumn("confidence", F.col("held") / (F.col("held") + UNKNOWN * F.col("unknown") + other + 1)).where((F.col("instances") >= support) & (F.col("confidence") >= confidence)).select("pattern", "confidence"))
        if i + 1 < rounds:
            instances = cut(hot_join(edges.where("not seed"), trusted, ["pattern"], "inst", "inner").groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
    return trusted


def extract(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Per document: ``id_col`` and its findings (kind, start, stop), in order."""
    with scratch(), short_reads(docs.sparkSession):
        return cut(_extracted(docs, id_col, text_col, support, confidence, rounds), outside=True)


def _extracted(docs: DataFrame, id_col: str, text_col: str, support: int, confidence: float, rounds: int) -> DataFrame:
    found = cut(scanned(docs, id_col, text_col))
    edges = cut(edges_of(found))
    patterns = cut(edges.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= support).select("pattern"))
    counts = patterns.withColumn("gram", F.shiftright("pattern", 1)).join(totals(docs, patterns, text_col), "gram", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))
    graph = cut(hot_join(edges, cut(counts), ["pattern"], "inst", "inner"))
    trusted = scored(graph, support, confidence, rounds)
    slots = found.select("row", F.explode("others").alias("x")).select("row", "x.start", "x.stop", F.explode("x.patterns").alias("pattern"))
    more = hot_join(slots, trusted.select("pattern"), ["pattern"], "row", "inner").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "stop")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.lit([]).cast(f"array<{SPAN}>"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    findings = F.transform(spans, lambda x: F.struct(F.get(name, x["kind"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return found.select("id", "row", "base").join(more, "row", "left").select(F.col("id").alias(id_col), findings.alias("findings"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_personal_data: findings in all documents."""
    found = extract(table(spark, sf_dir, "documents"))
    text = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("findings", lambda x: x["kind"] != "context")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"), count("context").alias("n_context"))
