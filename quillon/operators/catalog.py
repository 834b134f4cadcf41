"""Catalogue: queryables, descriptions, localised text, extents and operation names."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"


def json_type(kind: T.DataType) -> tuple[str, str | None]:
    """JSON Schema type and format of a column."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "string", "date" if isinstance(kind, T.DateType) else "date-time"
    for kinds, name in (((T.BooleanType,), "boolean"), ((T.IntegralType,), "integer"), ((T.NumericType,), "number"), ((T.ArrayType,), "array"), ((T.StructType, T.MapType), "object")):
        if isinstance(kind, kinds):
            return name, None
    return "string", None


def queryables(collection: str, df: DataFrame) -> dict:
    """The schema document of a collection, without a wrapper key."""
    fields = {f.name: {k: v for k, v in zip(("type", "format"), json_type(f.dataType)) if v} for f in df.schema}
    return {"$schema": "https://json-schema.org/draft/2019-09/schema", "$id": f"/collections/{collection}/queryables", "type": "object", "properties": fields}


def queryables_table(spark: SparkSession, collections: dict[str, DataFrame]) -> DataFrame:
    """One row a column: ``collection, name, json_type, format``, from schemas alone."""
    rows = [F.struct(F.lit(c).alias("collection"), F.lit(f.name).alias("name"), F.lit(json_type(f.dataType)[0]).alias("json_type"), F.lit(json_type(f.dataType)[1]).cast("string").alias("format")) for c, df in collections.items() for f in df.schema]
    return spark.range(1).select(F.inline(F.array(*rows)))


def correct_queryables(docs: DataFrame, replacement: str, column: str = "body") -> DataFrame:
    """Documents whose ``components.schemas.queryables`` is replaced, where they have it; other documents stay as they are, byte by byte."""
    new = json.loads(replacement)

    @F.pandas_udf(T.StringType())
    def put(bodies: pd.Series) -> pd.Series:
        def one(body):
            if body is None:
                return None
            doc = json.loads(body)
            doc["components"]["schemas"]["queryables"] = new
            return json.dumps(doc, separators=(",", ":"))

        return bodies.map(one)

    has = F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(column, "$.components.schemas")), "queryables"), F.lit(False))
    # one pass: the function gets nulls for documents that stay
    return docs.withColumns({column: F.coalesce(put(F.when(has, F.col(column))), F.col(column)), "corrected": has})


def localised(text: str, language: str, default: str) -> Column:
    """A map's text in a language, else in the default language."""
    return F.coalesce(F.try_element_at(F.col(text), F.lit(language)), F.try_element_at(F.col(text), F.lit(default)))


def describe(collections: DataFrame, base: str, language: str = "en", default: str = "en") -> DataFrame:
    """Descriptions: title, description and keywords in a language, item type, crs, extent and links to self, items and queryables.

    ``collections`` has ``id`` and ``title``, and may have ``description`` (texts by language), ``keywords`` (lists by language) and the columns of
    ``extents``; what it lacks is null. A collection without times or coordinates has nulls in its extent.
    """
    link = lambda rel, tail: F.struct(F.lit(rel).alias("rel"), F.lit("application/json").alias("type"), F.concat(F.lit(base + "/collections/"), F.col("id"), F.lit(tail)).alias("href"))
    own = lambda name, kind: localised(name, language, default) if name in collections.columns else F.lit(None).cast(kind)
    has = lambda name, kind: F.col(name) if name in collections.columns else F.lit(None).cast(kind)
    extent = F.struct(F.array(*[has(n, "double") for n in ("minx", "miny", "maxx", "maxy")]).alias("bbox"), F.array(*[has(n, "timestamp") for n in ("begin", "end")]).alias("interval"), F.lit(CRS84).alias("crs"))
    return collections.select("id", own("title", "string").alias("title"), own("description", "string").alias("description"), own("keywords", "array<string>").alias("keywords"), F.lit("feature").alias("item_type"), F.array(F.lit(CRS84)).alias("crs"),
                              extent.alias("extent"), F.array(link("self", ""), link("items", "/items"), link("queryables", "/queryables")).alias("links"))


def extents(df: DataFrame) -> DataFrame:
    """Box and time interval of each collection: one partial and one final aggregation."""
    return df.groupBy("collection").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def outside_extent(df: DataFrame, declared: DataFrame) -> DataFrame:
    """Features beyond what their collection declares; a null end is open. ``declared`` has a row a collection."""
    inside = F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy"))
    inside &= (F.col("ts") >= F.coalesce("begin", "ts")) & (F.col("ts") <= F.coalesce("end", "ts"))
    return df.join(declared, "collection").where(~inside).select(*df.columns)


def tool_names(operations: DataFrame) -> DataFrame:
    return operations.withColumn("tool", F.translate("operation_id", "-", "_"))


def tool_inventory(operations: DataFrame) -> DataFrame:
    return tool_names(operations).groupBy("tag").agg(F.count(F.lit(1)).alias("n_operations"), F.count_distinct("tool").alias("n_tools"))

