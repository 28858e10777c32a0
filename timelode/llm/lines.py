"""Line deduplication by site-relative frequency.

A line is boilerplate of a host where the share of the host's pages that hold it exceeds a ratio. Lines
are counted by two 64-bit hashes (together 128 bits) per host, once per page, with partial sums before
the shuffle; no line text is shuffled. At most (lines per page) / ratio lines of a host can exceed the
ratio, so the boilerplate of a host is a bounded list, which is joined to the host's pages and
removed inside each row; texts are never taken apart and put together again by a shuffle.

Rules: lines are cut at newlines and compared without outer white space; blank lines are neither counted
nor dropped. A line on one page only is no repetition and stays, however few pages the host has;
`min_pages` and `min_copies` ask for larger hosts or more copies where that is wanted. Null hosts form one host of their own. A null text stays null and has no lines; it counts as a
page. Where every line of a text is boilerplate, an empty text is left. Repeated rows are pages each. A
share equal to the ratio does not exceed it. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import fresh, quoted, save

RATIO, MIN_PAGES, MIN_COPIES = 0.1, 1, 2
BROADCAST_BYTES = 8 << 20
BLANKS = "\t\n\x0b\x0c\r "


def _hash(line: Column) -> Column:
    plain = F.trim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(plain).alias("x"), F.xxhash64(F.lit(7), plain).alias("y"), (plain != "").alias("real"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES) -> DataFrame:
    """(host, bad): for every host that has any, the hashes of its boilerplate lines."""
    pages = docs.select(host.alias("host"), F.array_distinct(F.transform(_lines(text), _hash)).alias("lines"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    line = pages.select("host", F.explode("lines").alias("line")).filter("line.real")
    counts = line.groupBy("host", F.col("line.x").alias("x"), F.col("line.y").alias("y")).agg(F.count("*").alias("copies")).filter(F.col("copies") >= min_copies)
    same = F.col("c.host").eqNullSafe(F.col("s.host"))
    over = counts.alias("c").join(sizes.alias("s"), same).filter(F.col("copies") > F.col("pages") * F.lit(ratio))
    return over.groupBy(F.col("c.host").alias("host")).agg(F.collect_list(F.struct("x", "y")).alias("bad"))


def drop_boilerplate(docs: DataFrame, host_col: str | Column = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """The input with boilerplate lines removed from `text_col`, and the columns of `counts`: lines, and how many were removed."""
    host = quoted(host_col) if isinstance(host_col, str) else host_col
    text = quoted(text_col)
    key, listed = fresh(docs, "_host", "_bad")
    found = save(boilerplate(docs, host, text, ratio, min_pages, min_copies).withColumnsRenamed({"host": key, "bad": listed}), "boilerplate")
    lines = found.agg(F.coalesce(F.sum(F.size(listed)), F.lit(0)), F.count("*")).first()
    if 16 * lines[0] + 64 * lines[1] <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined, bad = docs.join(found, host.eqNullSafe(F.col(key)), "left"), F.col(listed)
    # hashing every line once more costs less than carrying lines through a shuffle; hosts without boilerplate skip it
    kept = F.filter(_lines(text), lambda x: ~_listed(bad, x))
    clean = F.when(bad.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")
    left = F.when(bad.isNull(), n).otherwise(F.coalesce(F.size(kept), F.lit(0)).cast("long"))
    return joined.select(*[clean.alias(c) if c == text_col else quoted(c) for c in docs.columns], n.alias(counts[0]), (n - left).alias(counts[1]))


def _listed(bad: Column, line: Column) -> Column:
    h = _hash(line)
    return F.array_contains(bad, F.struct(h["x"].alias("x"), h["y"].alias("y")))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), p AS (SELECT *, regexp_replace(line, '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g') AS plain FROM l),
c AS (SELECT source, plain, count(DISTINCT doc_id) AS copies FROM p WHERE plain <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
s AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT c.source, c.plain FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE copies > pages * 0.1)
SELECT d.doc_id, d.source, coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (b.plain IS NULL), CASE WHEN any_value(d.text) IS NOT NULL THEN '' END) AS text,
  count(p.pos) AS n_lines, count(b.plain) AS n_dropped
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.plain = p.plain
GROUP BY d.doc_id, d.source
"""
