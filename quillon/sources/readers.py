"""Sources: feature files, the resource registry and cached documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.scratch import materialise


def csv_features(spark: SparkSession, path: str, schema: T.StructType | str, id_field: str = "id", x_field: str = "lon", y_field: str = "lat") -> DataFrame:
    """CSV with a header as features. The schema is explicit: coordinates of whole degrees would be inferred as integers."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumnsRenamed({id_field: "id", x_field: "lon", y_field: "lat"})


def geojson_features(spark: SparkSession, path: str, properties: str, id_field: str = "id", collection: bool = False, title_field: str | None = None, by_line: bool = False, split: bool = False) -> DataFrame:
    """GeoJSON as features with the envelope of their geometry: ``id``, properties, ``geometry``, ``minx, miny, maxx, maxy``, and ``title`` if a field is named.

    ``properties`` is the DDL of the property columns. By default a file has a feature a line, which Spark can split; with ``collection`` it is
    one FeatureCollection, which is one task's work, or with ``by_line`` too, a FeatureCollection a line; with ``split`` it is one of any size, read by several tasks. Geometries of any depth are read as text of their
    coordinates; of each position, the innermost list, the first two numbers count, so altitudes are left out. A null geometry has a null envelope.
    """
    feature = f"type string, id bigint, properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    if split:
        kind = feature.replace(" string", ":string").replace(" bigint", ":bigint").replace("properties struct", "properties:struct").replace("geometry struct", "geometry:struct")
        rows = collection_lines(spark, path).select(F.from_json("value", f"struct<{kind}>").alias("f")).select("f.*")
    elif collection:
        rows = spark.read.schema(f"type string, features array<struct<{feature.replace(' string', ':string').replace(' bigint', ':bigint').replace('properties struct', 'properties:struct').replace('geometry struct', 'geometry:struct')}>>").json(path, multiLine=not by_line).select(F.inline("features"))
    else:
        rows = spark.read.schema(feature).json(path)
    positions = F.expr(r"transform(regexp_extract_all(geometry.coordinates, '\\[([^\\[\\]]+)\\]', 1), x -> split(x, ','))")
    rows = rows.where("type = 'Feature'").withColumn("_n", positions)
    xs, ys = (F.expr(f"transform(_n, x -> try_cast(trim(get(x, {i})) as double))") for i in (0, 1))
    out = rows.select("id", "properties.*", "geometry", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    out = out if title_field is None else out.withColumn("title", F.col(title_field).cast("string"))
    return out if id_field == "id" else out.withColumn("id", F.col(id_field))


def collection_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: the text of every object right below the root of JSON files, in particular of each feature of a FeatureCollection, however large a file is.

    Files are read in splits, as pieces that end at closing braces. How deep a piece begins, and whether within a string, are sums over the pieces before it: first over whole splits, then over
    the pieces of each. A piece that ends right below the root ends an object, and pieces up to there are put together.
    """
    raw = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    bare = F.regexp_replace("value", r"\\.", "")  # no escaped quotes are left
    raw = materialise(raw.withColumn("_bare", bare).withColumn("_quotes", (F.length("_bare") - F.length(F.replace("_bare", F.lit('"')))).cast("long")), "pieces")

    def before(rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the sum of a column over all rows of the file before each."""
        blocks = rows.groupBy("file", "block").agg(F.sum(column).alias("_s"))  # a row a split
        base = blocks.select("file", "block", F.coalesce(F.sum("_s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        inner = F.coalesce(F.sum(column).over(Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(base, ["file", "block"]).withColumn(f"{column}_before", F.col("_base") + inner).drop("_base")

    rows = before(raw, "_quotes")
    opened = F.when(F.col("_quotes_before") % 2 == 1, F.concat(F.lit('"'), F.col("_bare"))).otherwise(F.col("_bare"))
    outside = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    ends_outside = (F.col("_quotes_before") + F.col("_quotes")) % 2 == 0
    braces = (F.length(outside) - F.length(F.replace(outside, F.lit("{")))).cast("long")
    rows = rows.withColumns({"_deeper": braces - F.when(ends_outside, 1).otherwise(0), "_outside": ends_outside}).drop("_bare", "_quotes", "_quotes_before")
    rows = before(materialise(rows, "braces"), "_deeper")
    rows = rows.withColumn("_ends", F.when(F.col("_outside") & (F.col("_deeper_before") + F.col("_deeper") == 1), 1).otherwise(0).cast("long"))
    rows = before(materialise(rows.select("file", "block", "pos", "value", F.col("_deeper_before").alias("depth"), "_ends"), "depths"), "_ends")
    # what stands before an object's own brace: the root and its other members, or a comma
    lead = F.when(F.col("depth") == 0, F.regexp_replace("value", r'^\s*\{?(?:"(?:[^"\\]++|\\.)*+"|[^"{]++)*?"features"\s*:\s*\[\s*', "")).when(F.col("depth") == 1, F.regexp_replace("value", r'^(?:"(?:[^"\\]++|\\.)*+"|[^"{]++)*+', "")).otherwise(F.col("value"))
    whole = rows.groupBy("file", F.col("_ends_before").alias("nth")).agg(F.array_sort(F.collect_list(F.struct("block", "pos", lead.alias("text")))).alias("parts"), F.max("_ends").alias("done")).where("done = 1")
    return whole.select("file", F.concat(F.array_join(F.transform("parts", lambda x: x["text"]), "}"), F.lit("}")).alias("value"))


def registry(resources: DataFrame) -> DataFrame:
    """Resources with absent values filled in: type ``""``, no providers, and provider types ``""``."""
    providers = F.coalesce("providers", F.array().cast("array<struct<type:string,name:string>>"))
    return resources.select("service_id", "name", F.coalesce("type", F.lit("")).alias("type"), F.transform(providers, lambda p: F.coalesce(p["type"], F.lit(""))).alias("provider_types"))


def split_registry(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections and processes."""
    return resources.where("type <> 'process'"), resources.where("type = 'process'")


def cached_documents(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries ``(url, timestamp, document, readable)``; an unreadable line is a miss, kept so that it can be counted."""
    df = spark.read.schema("url string, timestamp double, document string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("url", "timestamp", "document", (F.col("_corrupt").isNull() & F.col("url").isNotNull()).alias("readable"))
