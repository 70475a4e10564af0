"""Secret scans: fixed patterns, and a battery of randomness tests.

Three patterns give the base findings. Every other run of encoding characters
of at least ``MIN_LENGTH`` is a candidate, or its parts where no alphabet holds
it all (``KEY=value``, dashed names in paths). Its encoding (hexadecimal, base
32, letters, letters and digits, base 64) is inferred from the characters in
it, and three tests ask whether its symbols look drawn evenly and independently
from that alphabet: chi-squared uniformity, Wald-Wolfowitz runs about the
median symbol, and lag-1 serial correlation. A candidate that any of them
rejects (Bonferroni over the three) is not random.

Short words pass such tests by chance, so false discoveries are controlled by
length: under "ordinary text" symbols are drawn from the text's own letters,
for which the mean and variance of the chi-squared statistic at the
candidate's length are known exactly; the lower tail there is one p-value. The
other tests how many small letters, capitals, digits and signs the candidate
has against the text's shares of them. Twice the smaller is the candidate's
p-value, and Benjamini-Hochberg over all candidates of the document selects.
Digits alone are numbers, and are left out.

Edge cases: null texts are empty; empty texts have no findings and the digest
of the empty string; whole texts are read, however long; repeated rows are
judged alike; of findings that begin at one place the kinds' order decides, and
of overlapping random ones the least like ordinary text; an empty table has an
empty result; other columns are ignored by ``scan`` and kept by ``redact``,
whatever their names. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import slices, table

#: Kinds in the order in which findings at one place are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Candidates of the battery.
MIN_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BETWEEN = re.compile(r"[^=]{20,}")
#: Runs of the signs that one alphabet joins.
JOINED = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))
#: Level of the tests for randomness, and of false discoveries in a document.
ALPHA, FDR = 0.001, 0.02
#: Alphabets by name, the narrowest first: fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "lower_digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
INDEX = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
SETS = {name: frozenset(chars) for name, chars in ALPHABETS.items()}


def upper_tail(z: float) -> float:
    """P(Z >= z) of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """P(X >= x) of chi-squared, by Wilson and Hilferty's cube root."""
    v = 2 / (9 * df)
    return upper_tail(((x / df) ** (1 / 3) - 1 + v) / math.sqrt(v))


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token."""
    used = set(token)
    return None if token.isdigit() else next((name for name, chars in SETS.items() if used <= chars), None)


def battery(symbols: list[int], k: int) -> tuple[float, float, float]:
    """P-values of uniformity, runs and serial correlation, for symbols below ``k``."""
    n = len(symbols)
    counts = Counter(symbols)
    p_uniform = chi_squared_tail(k / n * sum(c * c for c in counts.values()) - n, k - 1)
    median = sorted(symbols)[n // 2]
    high = [s >= median for s in symbols]
    a = sum(high)
    b = n - a
    p_runs = 1.0 if k > 1 and len(counts) > 1 else 0.0
    if a and b and n > 2:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * upper_tail(abs(runs - mean) / math.sqrt(var))
    mean = sum(symbols) / n
    spread = sum((s - mean) ** 2 for s in symbols)
    p_serial = 0.0
    if spread:
        r = sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:])) / spread
        p_serial = 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n))
    return p_uniform, p_runs, p_serial


def ordinary_tail(symbols: list[int], shares: list[float]) -> float:
    """P that ordinary text of this length has its symbols as evenly spread, or more so.

    The chi-squared statistic is linear in the number of equal pairs, whose
    mean and variance under independent draws with ``shares`` are exact.
    """
    n = len(symbols)
    two, three = sum(p * p for p in shares), sum(p**3 for p in shares)
    pairs = n * (n - 1) / 2
    seen = sum(c * (c - 1) / 2 for c in Counter(symbols).values())
    var = pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)
    return upper_tail((pairs * two - seen) / math.sqrt(max(var, 1e-12)))


def kinds(counts: Counter) -> list[int]:
    """Small letters, capitals, digits and signs among counted characters."""
    out = [0, 0, 0, 0]
    for c, n in counts.items():
        out[0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3] += n
    return out


def kinds_tail(token: str, usual: list[int]) -> float:
    """P of kinds of characters as odd as the token's in a text with the ``usual`` ones; capitals alone count as small."""
    own = kinds(Counter(token.lower() if token.upper() == token else token))
    total = sum(usual) + 4
    expected = [max(1.0, len(token) * (u + 1) / total) for u in usual]
    return chi_squared_tail(sum((o - e) ** 2 / e for o, e in zip(own, expected) if o > e), 3)


def parts(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    """What of the run is tested, with its encoding: all of it, or its parts where no alphabet holds it.

    Parts lie between "=" and, where "+" or "/" stand with "-" or "_", are the
    runs without the ones and the runs without the others.
    """
    out = []
    for m in BETWEEN.finditer(text, start, stop):
        if name := encoding(m[0]):
            out.append((m.start(), m.end(), name))
        else:
            runs = {(r.start(), r.end()) for signs in JOINED for r in signs.finditer(text, m.start(), m.end())}
            out += [(x, y, name) for x, y in sorted(runs) if (name := encoding(text[x:y]))]
    return [x for x in out if x[1] - x[0] >= MIN_LENGTH]


class Spans:
    """Spans that don't overlap, in order; those that touch or overlap are joined."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        for start, stop in sorted(spans):
            if self.stops and start <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def meets(self, start: int, stop: int) -> bool:
        """Whether any of them overlaps [start, stop)."""
        at = bisect.bisect_right(self.stops, start)
        return at < len(self.starts) and self.starts[at] < stop

    def add(self, start: int, stop: int) -> None:
        """One more that overlaps none."""
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.stops.insert(at, stop)


def random_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans that the battery finds outside of ``taken``, with their encodings; of those that overlap the one least like ordinary text."""
    found, letters, taken = [], None, Spans(taken)
    for m in CANDIDATE.finditer(text):
        for start, stop, name in parts(text, m.start(), m.end()):
            if taken.meets(start, stop):
                continue
            token = text[start:stop]
            if letters is None:
                letters = Counter(text)
                usual = kinds(Counter({c: n for c, n in letters.items() if not c.isspace()}))
            index = INDEX[name]
            symbols, k = [index[c] for c in token], len(index)
            total = sum(letters[c] for c in index) + k
            shares = [(letters[c] + 1) / total for c in index]
            p = min(1.0, 2 * min(ordinary_tail(symbols, shares), kinds_tail(token, usual)))
            found.append((p, min(1.0, 3 * min(battery(symbols, k))), start, stop, name))
    found.sort()
    last = max((i for i, x in enumerate(found, 1) if x[0] <= FDR * i / len(found)), default=0)
    out, own = [], Spans()
    for _, p_random, start, stop, name in found[:last]:
        if p_random >= ALPHA and not own.meets(start, stop):
            own.add(start, stop)
            out.append((start, stop, name))
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns' findings."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, encoding) of all findings; the base ones have an empty encoding."""
    if not text:
        return []
    base = base_spans(text)
    more = random_spans(text, [(a, b) for a, _, b in base])
    return sorted([(a, k, b, "") for a, k, b in base] + [(a, 3, b, name) for a, b, name in more])


FINDINGS = "array<struct<kind:string,start:bigint,stop:bigint,encoding:string>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col`` and its findings (kind, start, stop, encoding)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("encoding", pa.string())])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                rows = batch.slice(lo, hi - lo)
                found = [[{"kind": KINDS[k], "start": a, "stop": b, "encoding": e} for a, k, b, e in find(t)] for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found, pa.list_(item))], ["id", "findings"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, findings {FINDINGS}").withColumnRenamed("id", id_col)


def redacted(text: str | None, mark: str) -> str | None:
    """The text with ``mark`` in place of its findings; those that touch or overlap get one."""
    spans = Spans((a, b) for a, _, b, _ in find(text))
    if not spans.starts:
        return text
    return mark.join(text[a:b] for a, b in zip([0, *spans.stops], [*spans.starts, len(text)]))


def redact(docs: DataFrame, mark: str = "[SECRET]", *, text_col: str = "text") -> DataFrame:
    """The documents with each finding replaced by ``mark``; all other columns stay."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in slices(batch, text_col):
                rows = batch.slice(lo, hi - lo)
                yield rows.set_column(at, batch.schema.field(at), pa.array([redacted(t, mark) for t in rows.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_secret_scan: findings in all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("findings", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"), count("random").alias("n_random"))
