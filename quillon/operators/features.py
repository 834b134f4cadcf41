"""Feature queries: filters, projection, paging, lookup and changes."""
from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillon.sources.scratch import materialise

DEFAULT_LIMIT, MAX_LIMIT = 20, 50


def bbox_filter(df: DataFrame, bbox: Sequence[float], envelope: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Features in ``minx, miny, maxx, maxy``, edges included; ``minx > maxx`` crosses the antimeridian.

    Points are compared by the stored columns ``lon`` and ``lat``, so the filter reaches the scan. With ``envelope``, the names of four
    columns, features count whose envelope meets the box.
    """
    if isinstance(bbox, str) or len(bbox) != 4:
        raise ValueError("bbox is a list of four numbers")
    minx, miny, maxx, maxy = map(float, bbox)
    if miny > maxy:
        raise ValueError("bbox has its south above its north")
    x0, y0, x1, y1 = map(F.col, envelope or ("lon", "lat", "lon", "lat"))
    across = ((x1 >= minx) & (x0 <= maxx)) if minx <= maxx else ((x1 >= minx) | (x0 <= maxx))
    return df.where(across & (y1 >= miny) & (y0 <= maxy))


def cell(depth: int, lon: str = "lon", lat: str = "lat") -> Column:
    """Number of a point's cell along a Z-order curve over the globe: ``2**depth`` cells to a side. Null where a coordinate is."""
    side = 1 << depth
    place = lambda name, low, width: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(name) - low) * (side / width)))).cast("long")
    bits = [F.shiftleft(F.shiftright(place(name, low, width), b).bitwiseAND(1), 2 * b + up) for b in range(depth) for up, (name, low, width) in enumerate(((lon, -180, 360), (lat, -90, 180)))]
    whole = functools.reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("long")
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), whole)


def cell_ranges(bbox: Sequence[float], depth: int) -> list[tuple[int, int]]:
    """First and last numbers of the runs of cells that a box touches, in order. A run is a part of the curve, so few describe any box."""
    minx, miny, maxx, maxy = map(float, bbox)
    boxes = [(minx, maxx)] if minx <= maxx else [(minx, 180.0), (-180.0, maxx)]
    found: list[tuple[int, int]] = []
    todo = [(0, 0, -180.0, -90.0)]
    while todo:
        level, number, west, south = todo.pop()
        width, height = 360 / (1 << level), 180 / (1 << level)
        # edges count, and points beyond the globe are in its outermost cells
        east, north = (x if x < most else float("inf") for x, most in ((west + width, 180), (south + height, 90)))
        west_, south_ = (x if x > least else float("-inf") for x, least in ((west, -180), (south, -90)))
        meet = [(a, b) for a, b in boxes if a <= east and b >= west_ and miny <= north and maxy >= south_]
        if not meet:
            continue
        inside = any(a <= west_ and b >= east for a, b in meet) and miny <= south_ and maxy >= north
        if level == depth or inside:
            shift = 2 * (depth - level)
            first, last = number << shift, ((number + 1) << shift) - 1
            if found and found[-1][1] == first - 1:
                found[-1] = (found[-1][0], last)
            else:
                found.append((first, last))
            continue
        half = [(level + 1, 4 * number + k, west + width / 2 * (k & 1), south + height / 2 * (k >> 1)) for k in range(4)]
        todo.extend(reversed(half))
    return found


def write_clustered(df: DataFrame, path: str, depth: int = 3) -> None:
    """Point features as Parquet in the order of the curve, in a folder for each of its ``4**depth`` cells. A cell with very many is several files, cut along the curve."""
    keyed = df.withColumns({"cell": cell(depth), "_key": cell(16)})
    order = ("cell", "_key")
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").write.partitionBy("cell").parquet(path)


def bbox_of_clustered(df: DataFrame, bbox: Sequence[float], depth: int = 3) -> DataFrame:
    """``bbox_filter`` over what ``write_clustered`` wrote: only files of cells that the box touches are read."""
    exact = bbox_filter(df, bbox)
    touched = [F.col("cell").between(a, b) for a, b in cell_ranges(bbox, depth)]
    return exact.where(functools.reduce(Column.__or__, touched)).drop("cell") if touched else exact.limit(0).drop("cell")


def _instant(text: str) -> datetime:
    try:
        out = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except (ValueError, OverflowError) as e:
        raise ValueError(f"not a date or time: {text!r}") from e
    return out.replace(tzinfo=timezone.utc) if out.tzinfo is None else out.astimezone(timezone.utc)


def parse_datetime(text: str) -> tuple[datetime | None, datetime | None]:
    """Bounds of an instant, ``a/b``, ``../b``, ``a/..``; anything else, values out of range included, is a ``ValueError``."""
    parts = text.split("/")
    if len(parts) > 2 or not text.strip():
        raise ValueError(f"not an instant or interval: {text!r}")
    lo, hi = (None if p.strip() in ("", "..") else _instant(p) for p in (parts * 2)[:2])
    if len(parts) == 2 and lo and hi and lo > hi:
        raise ValueError("the interval ends before it begins")
    return lo, hi


def datetime_filter(df: DataFrame, text: str, column: str = "ts") -> DataFrame:
    """Features within the bounds, both included. A null time does not match a bounded filter."""
    lo, hi = parse_datetime(text)
    if lo:
        df = df.where(F.col(column) >= F.lit(lo))
    return df.where(F.col(column) <= F.lit(hi)) if hi else df


def datetime_validity(column: str) -> Column:
    """Whether a column's text is an instant that a timestamp can hold; overflow is false, not an error."""
    return F.try_to_timestamp(F.col(column)).isNotNull()


def project(df: DataFrame, properties: Sequence[str], always: Sequence[str] = ("id", "lon", "lat")) -> DataFrame:
    """Some property columns, with id and geometry; rows are unchanged."""
    return df.select(*always, *[p for p in properties if p not in always])


def equals(df: DataFrame, name: str, value, queryables: Sequence[str]) -> DataFrame:
    if name not in queryables:
        raise ValueError(f"{name} is not a queryable")
    return df.where(F.col(name) == F.lit(value))


def predicate(df: DataFrame, text: str, queryables: Sequence[str]) -> DataFrame:
    """A boolean SQL expression over queryable columns: comparisons, and/or/not, null tests."""
    try:
        kind = df.select(*queryables).select(F.expr(text)).schema[0].dataType
    except (AnalysisException, ParseException) as e:
        raise ValueError(f"not a filter over the queryables: {text!r}") from e
    if not isinstance(kind, BooleanType):
        raise ValueError(f"not a condition: {text!r}")
    return df.where(F.expr(text))


def page(df: DataFrame, limit: int | None = None, offset: int = 0, id_field: str = "id") -> DataFrame:
    """One page by id: 20 rows by default, 50 at most. A top-k, not a sort of everything; it holds offset and limit rows, so for deep pages there is ``PageIndex``."""
    return df.orderBy(id_field).offset(offset).limit(_size(limit, offset))


def _size(limit: int | None, offset: int) -> int:
    size = DEFAULT_LIMIT if limit is None else limit
    if size < 1 or offset < 0:
        raise ValueError("limit is at least 1, offset at least 0")
    return min(size, MAX_LIMIT)


class PageIndex:
    """Pages of ``df`` at any depth. ``ranges (low, high, before, n)`` are ranges of ids in order, with the rows before each; equal ids are in one range, and rows without an id come first.

    Ids alone are dealt out once, and counted. A page then reads the few ranges that it touches: its filter on the id reaches the scan, and a task holds no more rows than
    a range has and the page.
    """

    def __init__(self, df: DataFrame, id_field: str = "id", ranges: int | None = None):
        self.df, self.id_field = df, id_field
        ids = df.select(F.col(id_field).alias("id"))
        dealt = ids.repartitionByRange(ranges, "id") if ranges else ids.repartitionByRange("id")
        counts = dealt.groupBy(F.spark_partition_id().alias("at")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("id")).alias("nulls"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
        self.ranges = materialise(materialise(counts, "counts").withColumn("before", before), "ranges")

    def page(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """The page of ``page``, with any offset."""
        size = _size(limit, offset)
        of = self.ranges.where((F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset))
        first = of.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("before").alias("before"), F.sum("nulls").alias("nulls")).first()
        if first.before is None:
            return self.df.limit(0)
        ident = F.col(self.id_field)
        within = ident.between(first.low, first.high) if first.high is not None else F.lit(False)
        return self.df.where(within | ident.isNull() if first.nulls else within).orderBy(self.id_field).offset(offset - first.before).limit(size)


def number_matched(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("number_matched"))


def by_id(df: DataFrame, ident, id_field: str = "id") -> DataFrame:
    return df.where(F.col(id_field) == F.lit(ident))


def by_ids(df: DataFrame, ids: DataFrame, id_field: str = "id") -> DataFrame:
    """Features whose id is listed. Spark broadcasts the list if its size allows."""
    return df.join(ids.select(id_field).distinct(), id_field, "left_semi")


def replace(base: DataFrame, changes: DataFrame, id_field: str = "id") -> DataFrame:
    """``changes`` in place of the features with their ids, and added where there are none."""
    return delete(base, changes, id_field).unionByName(changes)


def delete(base: DataFrame, ids: DataFrame, id_field: str = "id") -> DataFrame:
    return base.join(ids.select(id_field).distinct(), id_field, "left_anti")


@dataclass(frozen=True)
class ItemsQuery:
    """A feature query with typed arguments. All of them narrow one plan; page and count are taken from it."""

    bbox: Sequence[float] | None = None
    datetime: str | None = None
    properties: Sequence[str] | None = None
    filter: str | None = None
    equals: tuple[tuple[str, object], ...] = ()
    limit: int | None = None
    offset: int = 0

    def matching(self, df: DataFrame) -> DataFrame:
        names = df.columns
        if self.bbox is not None:
            df = bbox_filter(df, self.bbox)
        if self.datetime is not None:
            df = datetime_filter(df, self.datetime)
        for name, value in self.equals:
            df = equals(df, name, value, names)
        return predicate(df, self.filter, names) if self.filter else df

    def items(self, df: DataFrame) -> DataFrame:
        """The page, with ``number_matched`` and ``number_returned`` on every row."""
        found = self.matching(df)
        rows = page(found, self.limit, self.offset)
        rows = project(rows, self.properties) if self.properties is not None else rows
        size = min(DEFAULT_LIMIT if self.limit is None else self.limit, MAX_LIMIT)
        returned = F.least(F.lit(size), F.greatest(F.lit(0), F.col("number_matched") - self.offset)).cast("long")
        return rows.crossJoin(F.broadcast(number_matched(found).withColumn("number_returned", returned)))  # one row
