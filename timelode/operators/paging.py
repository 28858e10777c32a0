"""Deep pages of large listings: a directory of where pages begin, and pages read between two of its keys.

`page_of` of `events` sorts all that lies before a page. A directory is written once for a listing: the keys alone are
sorted, in parts, and of every `size`-th row the key is kept, with the number of all rows. A page is then a range of keys,
of which both ends reach the scan as pushed filters; of a table that is laid out by its key, only that part is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Columns of the order, the most important first, and whether each descends; nulls are first where it ascends, last where it descends.
Order = list[tuple[str, bool]]


def _sorting(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def _beyond(c: str, down: bool, value, after: bool) -> Column:
    """Whether the column alone is strictly after (or before) the value in its direction."""
    col, nulls_here = F.col(c), down == after  # whether nulls lie on the side that is asked for
    if value is None:
        return F.lit(False) if nulls_here else col.isNotNull()
    far = col > F.lit(value) if down != after else col < F.lit(value)
    return far | col.isNull() if nulls_here else far


def _side(order: Order, key: Row, after: bool, or_equal: bool) -> Column:
    """Whether a row is after (or before) a key in the order, column by column."""
    return reduce(lambda rest, x: _beyond(*x, key[x[0]], after) | (F.col(x[0]).eqNullSafe(F.lit(key[x[0]])) & rest), reversed(order), F.lit(or_equal))


def write_page_directory(df: DataFrame, order: Order, size: int, path: str) -> DataFrame:
    """Writes and returns (page, total, key): the key of the first row of each page of `size` rows.

    Only the columns of the order are sorted, by ranges, so no task sorts the listing. An order that leaves ties makes
    pages that differ in size by the ties at their ends, yet each row stands on one page. An empty listing has no pages.
    """
    spark, names = df.sparkSession, [c for c, _ in order]
    by = _sorting(order)
    df.select(*names).repartitionByRange(*by).sortWithinPartitions(*by).select(F.monotonically_increasing_id().alias("_id"), *names).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # as many rows as the sort had tasks
    counts = sorted((r._part, r.n) for r in keys.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "_part bigint, _before bigint"))
    at = F.col("_before") + F.col("_at")
    first = keys.join(starts, "_part").filter(at % size == 0).select((at / size).cast("long").alias("page"), F.lit(total).alias("total"), F.struct(*names).alias("key"))
    first.write.parquet(f"{path}/pages")
    return spark.read.parquet(f"{path}/pages")


def page_from_directory(df: DataFrame, order: Order, directory: DataFrame, page: int) -> DataFrame:
    """The rows of a page in order, each with the `total` that the directory was written with; no row of a page that isn't there."""
    ends = {r.page: r for r in directory.filter(F.col("page").isin(page, page + 1)).collect()}
    if page not in ends:
        return df.filter(F.lit(False)).withColumn("total", F.lit(0).cast("long"))
    rows = df.filter(_side(order, ends[page].key, after=True, or_equal=True))
    if page + 1 in ends:
        rows = rows.filter(_side(order, ends[page + 1].key, after=False, or_equal=False))
    return rows.orderBy(*_sorting(order)).withColumn("total", F.lit(ends[page].total).cast("long"))


def page_after(df: DataFrame, order: Order, last: Row | None, size: int) -> DataFrame:
    """The next `size` rows behind the last one of a page (None: the first page), without a directory: each task keeps `size` rows."""
    rows = df if last is None else df.filter(_side(order, last, after=True, or_equal=False))
    return rows.orderBy(*_sorting(order)).limit(size)
