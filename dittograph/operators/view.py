"""What a result view does: sort, distinct, limit, search, page, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dittograph.functions.formatting import format_size
from dittograph.functions.paths import matches

#: Sorts within a group, as (column, descending).
SORTS = {"Name": ("name", False), "Size": ("size", True), "Modified": ("modified", True), "Path": ("path", False)}


def order_of(sort: str, *ties: str) -> list[Column]:
    column, down = SORTS[sort]
    return [F.col(column).desc() if down else F.col(column).asc(), *(F.col(t).asc() for t in ties)]


def ranked(rows: DataFrame, sort: str, group: list[str], *ties: str) -> DataFrame:
    """``rows`` with ``rank``, their place in their group by one of the four sorts; ``ties`` decide among equals."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order_of(sort, *ties))))


def path_distinct(rows: DataFrame, order: list[Column], path: str = "path") -> DataFrame:
    """The first row, in ``order``, of each path; case doesn't tell paths apart."""
    first = Window.partitionBy(F.upper(F.col(path))).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


def limited(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in ``order``; 0 is no limit."""
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows


def searched(rows: DataFrame, query: str) -> DataFrame:
    return rows.filter(matches(query, F.col("name"), F.col("path")))


def list_view(rows: DataFrame, order: list[Column], limit: int, query: str) -> DataFrame:
    """List: one row for each path, then the limit, then the search."""
    return searched(limited(path_distinct(rows, order), order, limit), query)


def grid_view(rows: DataFrame, order: list[Column], limit: int, query: str) -> DataFrame:
    """Grid: the limit, then the search, then one row for each path."""
    return path_distinct(searched(limited(rows, order, limit), query), order)


def page(rows: DataFrame, order: list[Column], first_row: int, visible_rows: int, columns: int, overscan: int = 2) -> DataFrame:
    """Rows of a grid's visible lines, and some lines before and after."""
    start = max(0, first_row - overscan) * columns
    return rows.orderBy(*order).offset(start).limit((first_row + visible_rows + overscan) * columns - start)


def sorted_by(rows: DataFrame, column: str, descending: bool = False, as_text: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """The whole view by any column, as a click on its header sorts it; sizes by value, or ``as_text`` by the text that is shown."""
    key = format_size(F.col(column)) if as_text else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc(), *ties)


def _not_before(a: str, b: str, keys: list[tuple[str, bool]]) -> Column:
    """Whether the keys of side ``a`` come after those of ``b``, or equal them; a null is less than all else."""
    out = F.lit(True)
    for name, down in reversed(keys):
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        if down:
            x, y = y, x
        after = (x.isNotNull() & y.isNull()) | F.coalesce(x > y, F.lit(False))
        out = after | (x.eqNullSafe(y) & out)
    return out


def range_selected(rows: DataFrame, order: list[tuple[str, bool]], key: str, a: object, b: object) -> DataFrame:
    """Rows between those with keys ``a`` and ``b`` in ``order``, both included, whichever comes first.

    ``order`` lists (column, descending). The two ends' sort keys are looked up; the
    range is then a filter on the sort columns, so no row is numbered over the whole table.
    """
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    names = [f"k{i}" for i in range(len(order))]
    keys = F.struct(*[F.col(c).alias(n) for (c, _), n in zip(order, names)])
    ends = rows.filter(F.col(key).isin(a, b)).select(keys.alias("k"), F.row_number().over(Window.orderBy(*by)).alias("n"))
    ends = ends.agg(F.min_by("k", "n").alias("_lo"), F.max_by("k", "n").alias("_hi"))
    directed = [(n, down) for n, (_, down) in zip(names, order)]
    inside = _not_before("_key", "_lo", directed) & _not_before("_hi", "_key", directed)
    return rows.withColumn("_key", keys).join(F.broadcast(ends), inside).drop("_key", "_lo", "_hi")
