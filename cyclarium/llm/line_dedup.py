"""Line deduplication by a line's frequency within its site, in DataFrame functions alone.

For each host, the pages that hold a line are divided by all pages of the host;
lines above the ratio (and on a least number of pages) are boilerplate and go
from that host's pages. Each page counts a line once. Lines are known by two
64-bit hashes.

Counts are summed before they are shuffled, so neither a host with most of the
pages nor a line on all of them makes a large task. A host has at most (lines
per page) / ratio boilerplate lines. If all hosts' lines are few, they are
broadcast; beyond ``BROADCAST_ROWS`` a page's own lines are joined with them
instead, which gives the same texts.

Edge cases: null texts stay null with no lines; pages without a host are left
as they are; blank lines are always kept; a page of which every line goes stays
with an empty text; repeated rows count as pages each, as in the SQL, unless
``copies_count`` is false: then a host's rows with equal texts are one page, so
that copies of a page can't make its lines boilerplate. A ratio that is met
exactly is no boilerplate. Texts of any length are read whole. An empty table
has an empty result. All other columns stay, whatever their names, but those
with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, fresh, table

RATIO, MIN_PAGES = 0.08, 3
#: Boilerplate lines (of about 100 bytes in memory) that may be broadcast.
BROADCAST_ROWS = 100_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_count: bool = True) -> DataFrame:
    """(host, line): keys of the lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least."""
    pages = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    if copies_count:
        lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "").select("host", _key(F.col("line")).alias("line"))
    else:
        own = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: F.trim(x) != "")
        pages = pages.select("host", _key(F.col("text")).alias("page"), F.transform(own, _key).alias("lines"))
        lines = pages.dropDuplicates(["host", "page"]).select("host", F.explode("lines").alias("line"))
        pages = pages.select("host", "page").distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("total")).select("host", "line")


def clean(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_count: bool = True, broadcast_rows: int = BROADCAST_ROWS, counts: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """The pages without boilerplate lines, and the columns ``counts``: lines before, lines dropped. Without ``counts`` the columns stay as they are."""
    found = cut(boilerplate(pages, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages, copies_count=copies_count))
    columns = [c for c in pages.columns if c.lower() not in counts]
    host, drop, row, line = (fresh(f"_{x}", pages.columns) for x in ("host", "drop", "row", "line"))
    pages = pages.withColumn(host, F.col(host_col).cast("string"))
    if found.count() <= broadcast_rows:
        by_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(drop))
        pages = pages.join(F.broadcast(by_host), host, "left")
    else:
        pages = pages.withColumn(row, F.struct(_key(F.col(text_col)).alias("text"), F.col(host).alias("host")))
        own = pages.where(F.col(host).isNotNull()).select(row, host, F.explode(F.array_distinct(F.split(text_col, "\n"))).alias(line)).select(row, F.col(host).alias("host"), _key(F.col(line)).alias("line"))
        pages = pages.join(own.join(found, ["host", "line"], "left_semi").groupBy(row).agg(F.collect_set("line").alias(drop)), row, "left")
    lines = F.split(text_col, "\n")
    dropped = lambda x: F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)) & (F.trim(x) != "")
    kept = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x: ~dropped(x)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    n_dropped = F.when(F.col(text_col).isNull() | F.col(drop).isNull(), 0).otherwise(F.size(F.filter(lines, dropped)))
    told = [n.cast("bigint").alias(c) for n, c in zip((n_lines, n_dropped), counts)]
    return pages.select(*[kept.alias(c) if c == text_col else F.col(c) for c in columns], *told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_line_dedup: all documents without the boilerplate lines of their source."""
    return clean(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS row, doc_id, source, text FROM documents),
lines AS (SELECT row, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(DISTINCT row) AS n FROM lines WHERE source IS NOT NULL AND trim(line) <> '' GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM pages WHERE source IS NOT NULL GROUP BY source),
boilerplate AS (SELECT source, line, TRUE AS dropped FROM counts JOIN totals USING (source) WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * total),
judged AS (SELECT row, line, place, coalesce(dropped, FALSE) AS dropped FROM lines LEFT JOIN boilerplate USING (source, line)),
texts AS (SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '') AS text FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, texts.text AS text FROM pages LEFT JOIN texts USING (row)
"""
