"""Sinks: features as GeoJSON or JSON-LD lines, and the document cache."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _point() -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))


def geojson(df: DataFrame, properties: list[str]) -> DataFrame:
    """One ``application/geo+json`` feature a row, in column ``value``. Null properties are written as null."""
    feature = F.struct(F.lit("Feature").alias("type"), "id", F.struct(*properties).alias("properties"), _point().alias("geometry"))
    return df.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def json_ld(df: DataFrame, properties: list[str], context: dict[str, str]) -> DataFrame:
    """One ``application/ld+json`` feature a row, with the collection's terms as ``@context``."""
    terms = F.struct(*[F.lit(v).alias(k) for k, v in context.items()])
    feature = F.struct(terms.alias("@context"), F.lit("Feature").alias("type"), F.col("id").alias("@id"), *properties, _point().alias("geometry"))
    return df.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_cache(documents: DataFrame, path: str, now: float) -> None:
    """Appends entries stamped with ``now``; the newest entry of a URL wins on reading (``newest_entry``)."""
    documents.select("url", F.lit(now).cast("double").alias("timestamp"), "document").write.mode("append").json(path)
