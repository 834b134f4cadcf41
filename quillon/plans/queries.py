"""Registered queries, one or more an operator, each with the SQL that gives the same rows in DuckDB."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import transforms as t
from quillon.operators import access as a
from quillon.operators import capabilities as c
from quillon.operators import catalog as q
from quillon.operators import docgraph as g
from quillon.operators import features as f
from quillon.operators import processes as p
from quillon.operators import reachability
from quillon.plans.views import APP, duck, view
from quillon.sources import readers, sinks
from quillon.sources.scratch import shared_path
from quillon.streaming import streams
from quillon.streaming.live import Live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BOX, WEEK = (-90, -45, 90, 45), "2024-01-05/2024-01-12"
IN_BOX = "lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45"
IN_WEEK = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'"
NOW = 1706000000


def query(sql: str | None = None, **views: str):
    """Registers a function ``(spark, sf_dir)``; in its SQL ``{name}`` stands for a view."""
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.format(**{n: duck(n) for n in ("features", "registry", "requests", "claims", "edges", "accesses", "responses", "operations", "specs", "deployments")})
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small table of fixed values (rules, classes), as a literal of the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in values])))


# ---------------------------------------------------------------- features

@query(f"SELECT id, collection, value, lon, lat FROM {{features}} WHERE {IN_BOX}")
def f1_bbox(spark, d):
    return f.bbox_filter(view(spark, d, "features"), BOX).select("id", "collection", "value", "lon", "lat")


@query(f"SELECT id, collection, value, lon, lat FROM {{features}} WHERE {IN_BOX}")
def f1_bbox_of_clustered(spark, d):
    """The same box over features that were written along a curve: only files of touched cells are read."""
    path = shared_path(spark, "clustered")
    f.write_clustered(view(spark, d, "features"), path)
    return f.bbox_of_clustered(spark.read.parquet(path), BOX).select("id", "collection", "value", "lon", "lat")


@query("SELECT id, lon FROM {features} WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -30 AND 30")
def f1_bbox_antimeridian(spark, d):
    return f.bbox_filter(view(spark, d, "features"), (150, -30, -150, 30)).select("id", "lon")


@query(f"SELECT id, value FROM {{features}} WHERE {IN_WEEK}")
def f2_datetime(spark, d):
    return f.datetime_filter(view(spark, d, "features"), WEEK).select("id", "value")


@query("SELECT id, value FROM {features} WHERE ts <= TIMESTAMP '2024-01-09 12:00:00'")
def f2_datetime_open(spark, d):
    return f.datetime_filter(view(spark, d, "features"), "../2024-01-09T12:00:00Z").select("id", "value")


_TEXT = "CASE WHEN id % 7 = 0 THEN '999999999999999999999999999999' WHEN id % 5 = 0 THEN '2024-13-45' WHEN id % 11 = 0 THEN NULL ELSE '2024-01-05' END"


@query("SELECT id, NOT (id % 7 = 0 OR id % 5 = 0 OR id % 11 = 0) AS valid FROM {features}")
def f3_validate_datetime(spark, d):
    df = view(spark, d, "features").withColumn("text", F.expr(_TEXT))
    return df.select("id", f.datetime_validity("text").alias("valid"))


@query(f"SELECT id, lon, lat, value FROM {{features}} WHERE {IN_BOX}")
def f4_projection(spark, d):
    return f.project(f.bbox_filter(view(spark, d, "features"), BOX), ["value"])


@query("SELECT id, user_id, value FROM {features} WHERE user_id = 35")
def f5_equality(spark, d):
    df = view(spark, d, "features")
    return f.equals(df, "user_id", 35, df.columns).select("id", "user_id", "value")


@query("SELECT id, value FROM {features} WHERE value > 10 AND (collection = 'purchase' OR NOT lon < 0) AND value IS NOT NULL")
def f6_predicate(spark, d):
    df = view(spark, d, "features")
    return f.predicate(df, "value > 10 AND (collection = 'purchase' OR NOT lon < 0) AND value IS NOT NULL", df.columns).select("id", "value")


@query(f"SELECT id, collection FROM {{features}} WHERE {IN_BOX} ORDER BY id LIMIT 50 OFFSET 20")
def f7_page(spark, d):
    return f.page(f.bbox_filter(view(spark, d, "features"), BOX), limit=1000, offset=20).select("id", "collection")


@query("SELECT id, collection FROM {features} ORDER BY id LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM events)")
def f7_deep_page(spark, d):
    df = view(spark, d, "features")
    return f.PageIndex(df, ranges=16).page(50, df.count() * 9 // 10).select("id", "collection")


@query(f"SELECT count(*) AS number_matched FROM {{features}} WHERE {IN_BOX} AND {IN_WEEK}")
def f8_number_matched(spark, d):
    return f.number_matched(f.ItemsQuery(bbox=BOX, datetime=WEEK).matching(view(spark, d, "features")))


@query("SELECT id, collection, value FROM {features} WHERE id = 297")
def f9_feature_by_id(spark, d):
    return f.by_id(view(spark, d, "features"), 297).select("id", "collection", "value")


@query("SELECT id, value FROM {features} WHERE id IN (SELECT o_custkey FROM orders)")
def f9_features_by_ids(spark, d):
    return f.by_ids(view(spark, d, "features"), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))).select("id", "value")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE CAST(o_totalprice AS DOUBLE) END AS value FROM orders WHERE o_orderstatus <> 'P'")
def f10_replace_delete(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("value"), "o_orderstatus")
    changed = base.where("o_orderstatus = 'F'").withColumn("value", F.lit(0.0))
    return f.delete(f.replace(base, changed), base.where("o_orderstatus = 'P'")).select("id", "value")


@query(f"""SELECT id, lon, lat, value, (SELECT count(*) FROM {{features}} WHERE {IN_BOX} AND {IN_WEEK}) AS number_matched, least(20, (SELECT count(*) FROM {{features}} WHERE {IN_BOX} AND {IN_WEEK})) AS number_returned
    FROM {{features}} WHERE {IN_BOX} AND {IN_WEEK} ORDER BY id LIMIT 20""")
def items(spark, d):
    return f.ItemsQuery(bbox=BOX, datetime=WEEK, properties=["value"]).items(view(spark, d, "features"))


# ---------------------------------------------------------------- sources and sinks

@query("SELECT id, lon, lat, value FROM {features}")
def s1_csv(spark, d):
    path = shared_path(spark, "csv")
    view(spark, d, "features").select("id", F.col("lon").alias("long"), "lat", "value").write.csv(path, header=True)
    return readers.csv_features(spark, path, "id bigint, long double, lat double, value double", x_field="long")


@query("SELECT id, value, lon AS minx, lat AS miny, lon AS maxx, lat AS maxy FROM {features}")
def s2_geojson_source(spark, d):
    path = shared_path(spark, "geojson")
    sinks.write_lines(sinks.geojson(view(spark, d, "features"), ["value"]), path)
    return readers.geojson_features(spark, path, "value double").select("id", "value", "minx", "miny", "maxx", "maxy")


@query("SELECT id, value, lon AS minx, lat AS miny, lon AS maxx, lat AS maxy FROM {features}")
def s2_split_collection(spark, d):
    """All features as one FeatureCollection on one line, read in splits."""
    path = shared_path(spark, "collection")
    lines = sinks.geojson(view(spark, d, "features"), ["value"]).coalesce(1)
    parts = lines.select(F.concat(F.when(F.monotonically_increasing_id() == 0, '{"type":"FeatureCollection","features":[').otherwise(","), "value").alias("value"))
    parts.union(spark.range(1).select(F.lit("]}"))).coalesce(1).write.text(path, lineSep=" ")
    return readers.geojson_features(spark, path, "value double", split=True).select("id", "value", "minx", "miny", "maxx", "maxy")


@query("SELECT id, value, concat('feature ', CAST(id AS VARCHAR)) AS title, lon AS minx, lat AS miny, lon + 1 AS maxx, lat + 2 AS maxy FROM {features}")
def s2_feature_collections(spark, d):
    """FeatureCollections, one a line, of line strings with altitude; title from a named field."""
    path = shared_path(spark, "collections")
    geometry = "named_struct('type', 'LineString', 'coordinates', array(array(lon, lat, 900.5D), array(lon + 1, lat + 2, -1e3D)))"
    features = view(spark, d, "features").selectExpr("id", f"named_struct('type', 'Feature', 'id', id, 'properties', named_struct('value', value, 'name', concat('feature ', id)), 'geometry', {geometry}) AS f")
    lines = features.groupBy(F.floor(F.col("id") / 500)).agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    lines.write.text(path)
    return readers.geojson_features(spark, path, "value double, name string", collection=True, by_line=True, title_field="name").select("id", "value", "title", "minx", "miny", "maxx", "maxy")


@query("SELECT resource_id, CASE WHEN resource_id % 9 = 0 THEN '' ELSE type END AS type, CASE WHEN resource_id % 4 = 0 THEN 0 ELSE 1 END AS n_providers, CASE WHEN resource_id % 4 = 0 THEN NULL WHEN resource_id % 6 = 0 THEN '' ELSE provider_type END AS first_provider FROM {registry}")
def s3_registry(spark, d):
    raw = view(spark, d, "registry").selectExpr("service_id", "cast(resource_id AS string) AS name", "CASE WHEN resource_id % 9 <> 0 THEN type END AS type",
                                                "CASE WHEN resource_id % 4 <> 0 THEN array(named_struct('type', CASE WHEN resource_id % 6 <> 0 THEN provider_type END, 'name', 'x')) END AS providers")
    return readers.registry(raw).select(F.col("name").cast("long").alias("resource_id"), "type", F.size("provider_types").alias("n_providers"), F.get("provider_types", F.lit(0)).alias("first_provider"))


@query("SELECT count(*) AS n_entries, count(*) FILTER (page_id % 10 <> 0) AS n_readable FROM pages")
def s4_document_scan(spark, d):
    path = shared_path(spark, "cache")
    pages = table(spark, d, "pages")
    good = F.to_json(F.struct("url", F.lit(1.0).alias("timestamp"), F.col("html").alias("document")))
    pages.select(F.when(F.col("page_id") % 10 == 0, F.lit('{"url": "cut')).otherwise(good)).write.text(path)
    return readers.cached_documents(spark, path).agg(F.count(F.lit(1)).alias("n_entries"), F.count_if("readable").alias("n_readable"))


@query("""SELECT id, concat('{{"type":"Feature","id":', CAST(id AS VARCHAR), ',"properties":{{"collection":"', collection, '","user_id":', CAST(user_id AS VARCHAR), '}},"geometry":{{"type":"Point","coordinates":[', CAST(lon AS VARCHAR), ',', CAST(lat AS VARCHAR), ']}}}}') AS value FROM {features}""")
def s5_geojson_sink(spark, d):
    return sinks.geojson(view(spark, d, "features"), ["collection", "user_id"])


@query("""SELECT id, concat('{{"@context":{{"user_id":"https://schema.org/identifier"}},"type":"Feature","@id":', CAST(id AS VARCHAR), ',"user_id":', CAST(user_id AS VARCHAR), ',"geometry":{{"type":"Point","coordinates":[', CAST(lon AS VARCHAR), ',', CAST(lat AS VARCHAR), ']}}}}') AS value FROM {features}""")
def s6_json_ld_sink(spark, d):
    return sinks.json_ld(view(spark, d, "features"), ["user_id"], {"user_id": "https://schema.org/identifier"})


@query("SELECT url, 2.0 AS timestamp, max(concat('new', CAST(page_id AS VARCHAR))) AS document FROM pages GROUP BY url")
def s7_cache_write(spark, d):
    path = shared_path(spark, "cache")
    pages = table(spark, d, "pages").groupBy("url").agg(F.max(F.concat(F.lit("new"), F.col("page_id").cast("string"))).alias("document"))
    sinks.write_cache(pages.withColumn("document", F.lit("old")), path, 1.0)
    sinks.write_cache(pages, path, 2.0)
    return g.newest(readers.cached_documents(spark, path).where("readable").drop("readable"))


# ---------------------------------------------------------------- catalogue

@query("""SELECT table_name AS collection, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'number' ELSE 'string' END AS json_type,
    CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'date-time' WHEN data_type = 'DATE' THEN 'date' END AS format FROM information_schema.columns WHERE table_name IN ('events', 'nation', 'orders')""")
def q1_queryables(spark, d):
    return q.queryables_table(spark, {n: table(spark, d, n) for n in ("events", "nation", "orders")})


_OLD = """'{"components":{"schemas":{"queryables":{"type":"array"},"n":', CAST(p_partkey AS STRING), '}}}'"""


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS corrected, CASE WHEN p_partkey % 3 = 0 THEN concat('{{"components":{{"schemas":{{"queryables":{{"type":"object"}},"n":', CAST(p_partkey AS VARCHAR), '}}}}}}') ELSE '{{"components":{{}}}}' END AS body FROM part""")
def q2_correct_queryables(spark, d):
    docs = table(spark, d, "part").selectExpr("p_partkey", f"""CASE WHEN p_partkey % 3 = 0 THEN concat({_OLD}) ELSE '{{"components":{{}}}}' END AS body""")
    return q.correct_queryables(docs, '{"type":"object"}').select("p_partkey", "corrected", "body")


@query("SELECT id, title, 3 AS n_links, concat('https://api.example.com/collections/', id, '/items') AS items FROM (SELECT DISTINCT event_type AS id, concat('Ev ', event_type) AS title FROM events)")
def q3_describe(spark, d):
    kinds = view(spark, d, "features").select(F.col("collection").alias("id")).distinct()
    kinds = kinds.withColumn("title", F.create_map(F.lit("en"), F.concat(F.lit("Ev "), "id"), F.lit("fr"), F.concat(F.lit("Év "), "id")))
    return q.describe(kinds, APP).select("id", "title", F.size("links").alias("n_links"), F.col("links")[1]["href"].alias("items"))


@query("""SELECT collection AS id, concat('Év ', collection) AS title, concat('All ', collection) AS description, concat('events ', collection) AS keywords, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy,
    CAST(floor(epoch(min(ts))) AS BIGINT) AS begin, CAST(floor(epoch(max(ts))) AS BIGINT) AS until, 'http://www.opengis.net/def/crs/OGC/1.3/CRS84' AS crs FROM {features} GROUP BY collection""")
def q3_describe_in_full(spark, d):
    """Title in French, description in the default language, keywords and computed extent."""
    kinds = q.extents(view(spark, d, "features")).withColumnRenamed("collection", "id")
    text = lambda en, fr=None: F.create_map(F.lit("en"), F.concat(F.lit(en), "id"), *([F.lit("fr"), F.concat(F.lit(fr), "id")] if fr else []))
    kinds = kinds.withColumns({"title": text("Ev ", "Év "), "description": text("All "), "keywords": F.create_map(F.lit("en"), F.array(F.lit("events"), "id"))})
    box, when = F.col("extent.bbox"), F.col("extent.interval")
    return q.describe(kinds, APP, "fr").select("id", "title", "description", F.array_join("keywords", " ").alias("keywords"), *[box[i].alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))],
                                               F.unix_seconds(when[0]).alias("begin"), F.unix_seconds(when[1]).alias("until"), F.col("crs")[0].alias("crs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('fr ', c_name) ELSE c_name END AS title FROM customer")
def q4_localised(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN map('en', c_name, 'fr', concat('fr ', c_name)) ELSE map('en', c_name) END AS title")
    return df.select("c_custkey", q.localised("title", "fr", "en").alias("title"))


@query("SELECT collection, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM {features} GROUP BY collection")
def q5_extents(spark, d):
    return q.extents(view(spark, d, "features")).select("collection", "minx", "miny", "maxx", "maxy", F.unix_seconds("begin").alias("first_s"), F.unix_seconds("end").alias("last_s"))


@query("SELECT id, collection FROM {features} WHERE NOT (lon BETWEEN -170 AND 170 AND lat BETWEEN -80 AND 80 AND ts >= TIMESTAMP '2024-01-03')")
def q6_outside_extent(spark, d):
    df = view(spark, d, "features")
    declared = df.select("collection").distinct().selectExpr("collection", "-170D AS minx", "-80D AS miny", "170D AS maxx", "80D AS maxy", "TIMESTAMP '2024-01-03' AS begin", "CAST(NULL AS TIMESTAMP) AS end")
    return q.outside_extent(df, declared).select("id", "collection")


@query("SELECT tag, count(*) AS n_operations, count(DISTINCT replace(operation_id, '-', '_')) AS n_tools FROM {operations} GROUP BY tag")
def q7_tool_names(spark, d):
    return q.tool_inventory(view(spark, d, "operations"))


# ---------------------------------------------------------------- capabilities

_SPEC = "http://www.opengis.net/spec/"
#: Conformance classes by group. Fixed values.
BASE = ["ogcapi-common-1/1.0/conf/core", "ogcapi-common-2/1.0/conf/collections", "ogcapi-common-1/1.0/conf/landing-page", "ogcapi-common-1/1.0/conf/json", "ogcapi-common-1/1.0/conf/html", "ogcapi-common-1/1.0/conf/oas30"]
CLASSES = {
    "feature": ["ogcapi-features-1/1.0/conf/core", "ogcapi-features-1/1.0/conf/oas30", "ogcapi-features-1/1.0/conf/html", "ogcapi-features-1/1.0/conf/geojson", "ogcapi-features-2/1.0/conf/crs", "ogcapi-features-3/1.0/conf/queryables",
                "ogcapi-features-3/1.0/conf/queryables-query-parameters", "ogcapi-features-4/1.0/conf/create-replace-delete", "ogcapi-common-3/1.0/conf/schemas", "ogcapi-common-3/1.0/conf/advanced-property-roles", "cql2/1.0/conf/cql2-text", "cql2/1.0/conf/basic-cql2"],
    "process": ["ogcapi-processes-1/1.0/conf/ogc-process-description", "ogcapi-processes-1/1.0/conf/core", "ogcapi-processes-1/1.0/conf/json", "ogcapi-processes-1/1.0/conf/oas30", "ogcapi-processes-1/1.0/conf/callback"],
    "coverage": ["ogcapi-coverages-1/1.0/conf/core", "ogcapi-coverages-1/1.0/conf/oas30", "ogcapi-coverages-1/1.0/conf/html", "ogcapi-coverages-1/1.0/conf/geodata-coverage", "ogcapi-coverages-1/1.0/conf/coverage-subset", "ogcapi-coverages-1/1.0/conf/coverage-rangesubset",
                 "ogcapi-coverages-1/1.0/conf/coverage-bbox", "ogcapi-coverages-1/1.0/conf/coverage-datetime"],
    "tile": ["ogcapi-tiles-1/1.0/conf/core", "ogcapi-tiles-1/1.0/conf/mvt", "ogcapi-tiles-1/1.0/conf/tileset", "ogcapi-tiles-1/1.0/conf/tilesets-list", "ogcapi-tiles-1/1.0/conf/oas30", "ogcapi-tiles-1/1.0/conf/geodata-tilesets"],
    "map": ["ogcapi-maps-1/1.0/conf/core"],
    "record": ["ogcapi-records-1/1.0/conf/core", "ogcapi-records-1/1.0/conf/sorting", "ogcapi-records-1/1.0/conf/opensearch", "ogcapi-records-1/1.0/conf/json", "ogcapi-records-1/1.0/conf/html"],
    "edr": ["ogcapi-edr-1/1.0/conf/core"],
    "pubsub": ["ogcapi-pubsub-1/1.0/conf/message-payload-cloudevents", "ogcapi-pubsub-1/1.0/conf/discovery"],
}


def _base(spark):
    return rows(spark, [(_SPEC + x,) for x in BASE], ["cls"])


def _classes(spark):
    return rows(spark, [(k, _SPEC + x) for k, xs in CLASSES.items() for x in xs], ["grp", "cls"])


def _values(pairs) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in pairs) + ")"


_BASE_SQL = f"{_values([(_SPEC + x,) for x in BASE])} AS base(cls)"
_CLASS_SQL = f"{_values([(k, _SPEC + x) for k, xs in CLASSES.items() for x in xs])} AS classes(grp, cls)"
_KIND = "CASE WHEN type = 'process' THEN 'process' ELSE provider_type END"
_FOUND_SQL = f"SELECT DISTINCT service_id, cls FROM {{registry}} JOIN {_CLASS_SQL} ON classes.grp = {_KIND}"
_PAIRS_SQL = f"SELECT DISTINCT service_id, cls FROM {{registry}} CROSS JOIN {_BASE_SQL} UNION {_FOUND_SQL}"


def _pairs(spark, d):
    reg = view(spark, d, "registry").withColumn("provider_types", F.array("provider_type"))
    return c.with_base(reg, c.provider_classes(c.provider_rows(reg), _classes(spark), {"feature": "feature", "record": "record"}), _base(spark))


@query(f"SELECT service_id, {_KIND} AS provider_type, count(*) AS n FROM {{registry}} GROUP BY 1, 2")
def c1_provider_rows(spark, d):
    reg = view(spark, d, "registry").withColumn("provider_types", F.array("provider_type"))
    return c.provider_rows(reg).groupBy("service_id", "provider_type").agg(F.count(F.lit(1)).alias("n"))


@query(_FOUND_SQL)
def c2_provider_classes(spark, d):
    reg = view(spark, d, "registry").withColumn("provider_types", F.array("provider_type"))
    return c.provider_classes(c.provider_rows(reg), _classes(spark), {"feature": "feature", "record": "record"}).distinct()


@query(_PAIRS_SQL)
def c3_with_base(spark, d):
    return _pairs(spark, d).distinct()


@query(f"SELECT DISTINCT service_id, cls FROM {{registry}} CROSS JOIN {_CLASS_SQL} WHERE p_size > 45 AND grp = 'pubsub'")
def c4_optional(spark, d):
    services = view(spark, d, "registry").groupBy("service_id").agg(F.bool_or(F.col("p_size") > 45).alias("has_pubsub"))
    return c.optional(services, "has_pubsub", _classes(spark).where("grp = 'pubsub'"))


@query(f"SELECT service_id, array_to_string(list_sort(list(cls)), ' ') AS conforms_to, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY service_id")
def c5_roll_up(spark, d):
    return c.roll_up(_pairs(spark, d)).select("service_id", F.array_join("conforms_to", " ").alias("conforms_to"), F.size("conforms_to").cast("long").alias("n"))


@query(f"SELECT DISTINCT service_id, classes.cls FROM {{registry}} CROSS JOIN {_CLASS_SQL} WHERE grp = 'record' EXCEPT ({_PAIRS_SQL})")
def c6_missing(spark, d):
    return c.missing(view(spark, d, "registry"), _classes(spark).where("grp = 'record'"), _pairs(spark, d))


_EACH = "(SELECT resource_id AS service_id, type, provider_type FROM {registry}) AS each"


@query(f"""SELECT service_id, classes.cls FROM {_EACH} CROSS JOIN {_CLASS_SQL} WHERE grp IN ('record', 'coverage')
    EXCEPT SELECT service_id, cls FROM {_EACH} JOIN {_CLASS_SQL} ON classes.grp = {_KIND}""")
def c6_missing_by_resource(spark, d):
    """Each resource as a service of its own, so that most lack something."""
    reg = view(spark, d, "registry").withColumns({"service_id": F.col("resource_id"), "provider_types": F.array("provider_type")})
    found = c.provider_classes(c.provider_rows(reg), _classes(spark), {})
    return c.missing(reg, _classes(spark).where("grp in ('record', 'coverage')"), found)


@query(f"SELECT service_id, cls FROM ({_PAIRS_SQL}) WHERE cls LIKE '%coverage%'")
def c7_forbidden(spark, d):
    return c.forbidden(_pairs(spark, d), _classes(spark).where("grp = 'coverage'"))


@query(f"""WITH a AS ({_FOUND_SQL} WHERE resource_id % 10 <> 0), b AS ({_FOUND_SQL} WHERE resource_id % 7 <> 0)
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def c8_changes(spark, d):
    reg = view(spark, d, "registry").withColumn("provider_types", F.array("provider_type"))
    snap = lambda cond: c.provider_classes(c.provider_rows(reg.where(cond)), _classes(spark), {})
    return c.changes(snap("resource_id % 10 <> 0"), snap("resource_id % 7 <> 0"))


def _live(spark, d):
    """All resources come, then those of every third number go, in two batches."""
    path = shared_path(spark, "resource-changes")
    every = view(spark, d, "registry").select("service_id", "resource_id", "type", F.array("provider_type").alias("provider_types"))
    every.withColumn("op", F.lit("insert")).coalesce(1).write.mode("append").parquet(path)
    every.where("resource_id % 3 = 0 OR service_id = 7").withColumn("op", F.lit("delete")).coalesce(1).write.mode("append").parquet(path)
    live = Live(every, _classes(spark), _base(spark), {"feature": "feature", "record": "record"})
    live.run(streams.read_parquet_stream(every.withColumn("op", F.lit("")), path, 1))
    return live


_LEFT = "(SELECT * FROM {registry} WHERE resource_id % 3 <> 0 AND service_id <> 7) AS registry"


@query(f"SELECT service_id, array_to_string(list_sort(list(cls)), ' ') AS conforms_to FROM ({_PAIRS_SQL.replace('{registry}', _LEFT)}) GROUP BY service_id")
def c5_live_roll_up(spark, d):
    return _live(spark, d).roll_up().select("service_id", F.array_join("conforms_to", " ").alias("conforms_to"))


@query(f"WITH a AS ({_PAIRS_SQL}), b AS ({_PAIRS_SQL.replace('{registry}', _LEFT)}) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def c8_live_changes(spark, d):
    return _live(spark, d).changes(0, 1)


# ---------------------------------------------------------------- document graph

@query("SELECT p_partkey, CAST(2 AS BIGINT) AS n_external, TRUE AS has_external FROM part")
def g1_g2_external_refs(spark, d):
    docs = view(spark, d, "specs").withColumn("refs", g.refs("body"))
    return docs.select("p_partkey", F.size(g.external()).cast("long").alias("n_external"), F.exists("refs", lambda r: ~F.startswith(r["ref"], F.lit("#"))).alias("has_external"))


@query("""SELECT url AS src_url, 'https://h' || (p_partkey % 3) || '.example.com/d/' || (p_partkey * 7 % 500) || '.json#/c/x' AS ref, TRUE AS sole_key FROM {specs}
    UNION ALL SELECT url, '#/c', TRUE FROM {specs} UNION ALL SELECT url, 'more.json#/q', FALSE FROM {specs}""")
def g3_edges(spark, d):
    return g.edges(view(spark, d, "specs"))


_LINKS = "SELECT page_id, url AS base, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) || CASE page_id % 3 WHEN 0 THEN '#a#b' WHEN 1 THEN '#' ELSE '' END AS ref FROM pages"


def _links(spark, d):
    tail = F.when(F.col("page_id") % 3 == 0, "#a#b").when(F.col("page_id") % 3 == 1, "#").otherwise("")
    return table(spark, d, "pages").select("page_id", F.col("url").alias("base"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref")).withColumn("ref", F.concat("ref", tail))


@query(f"SELECT page_id, ref, split_part(ref, '#', 1) AS url, CASE WHEN position('#' IN ref) > 0 THEN substr(ref, position('#' IN ref) + 1) ELSE '' END AS fragment FROM ({_LINKS.replace('{', '{{').replace('}', '}}')})")
def g4_split_ref(spark, d):
    url, fragment = g.split_ref("ref")
    return _links(spark, d).select("page_id", "ref", url.alias("url"), fragment.alias("fragment"))


@query(f"""SELECT page_id, ref, CASE WHEN ref LIKE 'http%' THEN ref ELSE regexp_extract(base, '^(https?://[^/]*)', 1) || ref END AS url FROM ({_LINKS.replace(" || CASE page_id % 3 WHEN 0 THEN '#a#b' WHEN 1 THEN '#' ELSE '' END", '')}) WHERE ref LIKE 'http%' OR ref LIKE '/%'""")
def g5_resolve(spark, d):
    links = table(spark, d, "pages").select("page_id", F.col("url").alias("base"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref"))
    return links.where("ref LIKE 'http%' OR ref LIKE '/%'").select("page_id", "ref", g.resolve("base", "ref")["url"].alias("url"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS value, CASE WHEN p_partkey % 2 = 1 THEN 'no key zz' END AS error FROM {specs} JOIN part USING (p_partkey)")
def g6_pointer(spark, d):
    docs = view(spark, d, "specs").withColumn("where", F.when(F.col("p_partkey") % 2 == 0, "/c//x").otherwise("/c/zz"))
    return docs.withColumn("_r", g.pointer("body", "where")).select("p_partkey", "_r.value", "_r.error")


@query("""SELECT CAST(url AS BIGINT) AS url, CAST(url AS BIGINT) % 3 = 0 AS hit FROM (SELECT DISTINCT user_id AS url FROM events)""")
def g7_lookups(spark, d):
    wanted = view(spark, d, "accesses").select(F.col("url_id").alias("url"))
    hits, fetch = g.lookups(wanted, wanted.distinct().where("url % 3 = 0").withColumn("body", F.lit("x")))
    return hits.select("url", F.lit(True).alias("hit")).union(fetch.select("url", F.lit(False)))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT src, dst FROM {edges} UNION SELECT r.src, e.dst FROM r JOIN (SELECT src, dst FROM {edges}) e ON r.dst = e.src)
    SELECT src, count(*) AS n_reached, bool_or(src = dst) AS in_cycle FROM r GROUP BY src""")
def g8_closure(spark, d):
    return reachability.reach(view(spark, d, "edges"))


#: A graph without cycles: every part points to the half of its number, every fifth to the third of it.
_HIERARCHY = "SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 1 UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) FROM {part} WHERE p_partkey % 5 = 0 AND p_partkey > 2"
_REACHED = "WITH RECURSIVE e AS ({}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


def _hierarchy(spark, d):
    return spark.sql(_HIERARCHY.format(part=f"parquet.`{d}/part.parquet`"))


@query(_REACHED.format(_HIERARCHY.format(part="part")) + " SELECT src, count(*) AS n_reached, FALSE AS in_cycle FROM r GROUP BY src")
def g8_reach_of_hierarchy(spark, d):
    return reachability.reach(_hierarchy(spark, d))


@query(_REACHED.format("SELECT src, dst FROM {edges}") + " SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def g8_components(spark, d):
    return reachability.components(view(spark, d, "edges"))


@query(_REACHED.format(_HIERARCHY.format(part="part")) + " SELECT p_partkey AS src, p_size AS dst, EXISTS (SELECT 1 FROM r WHERE r.src = p_partkey AND r.dst = p_size) AS reached FROM part")
def g8_reachable(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst"))
    return reachability.Labels(_hierarchy(spark, d)).reaches(wanted).withColumn("dst", F.col("dst").cast("int"))


#: The chain of a specification's first reference: on to the next while it names a fragment with a reference that is there and not yet open.
_INLINE = """WITH RECURSIVE s AS (SELECT p_partkey AS p, p_size, p_partkey * 7 % 500 AS q FROM part),
    r AS (SELECT p AS root, p AS cur, CAST([] AS BIGINT[]) AS seen, 0 AS n FROM s
        UNION ALL SELECT r.root, s.q, list_append(r.seen, s.q), r.n + 1 FROM r JOIN s ON s.p = r.cur JOIN s AS nxt ON nxt.p = s.q WHERE s.p % 2 = 0 AND s.p % 3 = s.q % 3 AND NOT list_contains(r.seen, s.q)),
    ends AS (SELECT root, arg_max(cur, n) AS cur FROM r GROUP BY root),
    found AS (SELECT ends.root, s.p, s.q, s.p % 2 = 1 AND s.p % 3 = s.q % 3 AND t.p IS NOT NULL AS ok, t.p_size AS size FROM ends JOIN s ON s.p = ends.cur LEFT JOIN s AS t ON t.p = s.q)
    SELECT concat('https://h', CAST(root % 3 AS VARCHAR), '.example.com/d/', CAST(root AS VARCHAR), '.json') AS url,
        concat('{"a":', CASE WHEN ok THEN CAST(size AS VARCHAR) ELSE concat('{"$ref":"https://h', CAST(found.p % 3 AS VARCHAR), '.example.com/d/', CAST(found.q AS VARCHAR), '.json#/', CASE WHEN found.p % 2 = 0 THEN 'a' ELSE 'c/x' END, '"}') END,
            ',"b":[{"$ref":"#/c"},{"$ref":"more.json#/q","note":1}],"c":{"x":', CAST(s.p_size AS VARCHAR), '}}') AS resolved,
        CASE WHEN ok THEN 0 ELSE 1 END AS n_unresolved FROM found JOIN s ON s.p = found.root"""


@query(_INLINE.replace("{", "{{").replace("}", "}}"))
def g8_inline(spark, d):
    """Every specification with its references replaced. Every other one refers to a fragment that holds a reference."""
    docs = view(spark, d, "specs")
    own = docs.select(F.concat(F.lit("https://h"), (F.col("p_partkey") % 3).cast("string"), F.lit(".example.com/d/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("url"),
                      F.when(F.col("p_partkey") % 2 == 0, F.replace("body", F.lit("#/c/x"), F.lit("#/a"))).otherwise(F.col("body")).alias("body"))
    return g.inline(own).select("url", "resolved", F.size("unresolved").alias("n_unresolved"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS cache_key FROM pages")
def g9_cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", g.cache_key("url").alias("cache_key"))


@query(f"SELECT event_id FROM {{accesses}} WHERE {NOW} - t <= 1036800")
def g10_fresh(spark, d):
    return g.fresh(view(spark, d, "accesses").withColumnRenamed("t", "timestamp"), NOW, 1036800).select("event_id")


@query("""WITH RECURSIVE a AS (SELECT url_id, t FROM {accesses}), f AS (SELECT url_id, min(t) AS t FROM a GROUP BY url_id
    UNION ALL SELECT f.url_id, min(a.t) FROM f JOIN a ON a.url_id = f.url_id AND a.t - f.t > 86400 GROUP BY f.url_id, f.t)
    SELECT url_id, count(*) AS n_fetches FROM f GROUP BY url_id""")
def g11_replay(spark, d):
    out = g.replay(view(spark, d, "accesses"), "url_id", "t", g.DAY)
    return out.groupBy("url_id").agg(F.count_if("fetched").alias("n_fetches"))


@query("SELECT url_id, t, event_id FROM {accesses} QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY t DESC, event_id DESC) = 1")
def l1_newest(spark, d):
    return g.newest(view(spark, d, "accesses"), "url_id", "t", "event_id").select("url_id", "t", "event_id")


@query(f"""SELECT regexp_extract(ref, '^https?://([^/:#]*)', 1) AS host, count(*) AS n_refs, count(DISTINCT ref) AS n_targets, count(DISTINCT page_id) AS n_documents FROM ({_LINKS.replace('{', '{{').replace('}', '}}')}) WHERE ref LIKE 'http%' GROUP BY 1""")
def l2_host_summary(spark, d):
    return g.host_summary(_links(spark, d).where("ref LIKE 'http%'"), "ref", "page_id")


@query("SELECT regexp_extract(url, '^https?://([^/:#]*)', 1) AS host, count(*) AS n_refs, count(DISTINCT url) AS n_targets, count(DISTINCT page_id % 97) AS n_documents FROM pages GROUP BY 1")
def l2_host_summary_of_pages(spark, d):
    """The pages' own addresses as targets, dealt to 97 documents that refer to them."""
    return g.host_summary(table(spark, d, "pages").select("url", (F.col("page_id") % 97).alias("src")), "url", "src")


# ---------------------------------------------------------------- access

PUBLIC = ["/openapi", "/static/(img|css)"]
_PUB = "regexp_matches(path, '^(/api/openapi|/static/(img|css))')"


def _public():
    return a.is_public("path", ["/api/openapi", "/static/(img|css)"])


@query(f"SELECT req_id, {_PUB} AS is_public FROM {{requests}}")
def a1_public(spark, d):
    return view(spark, d, "requests").select("req_id", _public().alias("is_public"))


@query(f"""SELECT decision, status, count(*) AS n FROM (SELECT CASE WHEN method = 'OPTIONS' OR {_PUB} OR "user" IS NOT NULL THEN 'pass' WHEN req_id % 9 = 0 THEN 'redirect' ELSE 'unauthenticated' END AS decision,
    CASE WHEN method = 'OPTIONS' OR {_PUB} OR "user" IS NOT NULL THEN 200 WHEN req_id % 9 = 0 THEN 302 ELSE 401 END AS status FROM {{requests}}) GROUP BY 1, 2""")
def a2_decision(spark, d):
    df = view(spark, d, "requests").withColumns({"kind": F.lit("http"), "has_claims": F.col("user").isNotNull(), "redirect": F.col("req_id") % 9 == 0})
    return df.select(a.decision(_public()).alias("x")).groupBy("x.decision", "x.status").agg(F.count(F.lit(1)).alias("n"))


AUD, ISS = "https://api.example.com", "https://idp.example.com"
_AUD = "CASE WHEN aud IS NOT NULL THEN aud WHEN client_id IS NOT NULL THEN [client_id] END"
_REASON = f"CASE WHEN {_AUD} IS NULL THEN 'missing_audience' WHEN NOT list_contains({_AUD}, '{AUD}') THEN 'wrong_audience' WHEN iss IS NULL THEN 'missing_issuer' WHEN iss <> '{ISS}' THEN 'wrong_issuer' WHEN exp < 1700012000 THEN 'expired' ELSE 'ok' END"


@query(f"SELECT sub, CASE WHEN aud IS NULL THEN 'missing_audience' WHEN NOT list_contains(aud, '{AUD}') THEN 'wrong_audience' ELSE 'ok' END AS reason FROM {{claims}}")
def a3_audience(spark, d):
    return view(spark, d, "claims").select("sub", a.token_reason(AUD, None, 0, F.col("aud")).alias("reason"))


@query(f"SELECT sub, {_REASON.replace(' WHEN exp < 1700012000 THEN ' + repr('expired'), '')} AS reason FROM {{claims}}")
def a3_audience_text(spark, d):
    """Claims whose audience is text: a plain string, or a JSON list where there are several."""
    df = view(spark, d, "claims").withColumn("aud", F.when(F.size("aud") == 1, F.col("aud")[0]).when(F.size("aud") > 1, F.to_json("aud")))
    return df.select("sub", a.token_reason(AUD, ISS, 0, a.audience(a.audience_list())).alias("reason"))


@query(f"SELECT sub, array_to_string({_AUD}, ' ') AS aud FROM {{claims}}")
def a4_audience_fallback(spark, d):
    return view(spark, d, "claims").select("sub", F.array_join(a.audience(), " ").alias("aud"))


@query(f"SELECT sub, CASE WHEN iss IS NULL THEN 'missing_issuer' WHEN iss <> '{ISS}' THEN 'wrong_issuer' ELSE 'ok' END AS reason FROM {{claims}}")
def a5_issuer(spark, d):
    return view(spark, d, "claims").select("sub", a.token_reason(None, ISS, 0).alias("reason"))


@query("SELECT sub, CASE WHEN exp < 1700012000 THEN 'expired' ELSE 'ok' END AS reason FROM {claims}")
def a6_expiry(spark, d):
    return view(spark, d, "claims").select("sub", a.token_reason(None, None, 1700012000).alias("reason"))


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM {{claims}} GROUP BY 1")
def a7_reasons(spark, d):
    return a.reasons(view(spark, d, "claims"), AUD, ISS, 1700012000)


@query("""SELECT jwks_uri, count(DISTINCT alg) AS n_algs, CASE count(DISTINCT alg) WHEN 1 THEN 'ok' WHEN 0 THEN 'none' ELSE 'multiple' END AS outcome FROM
    (SELECT 'https://idp' || (p_partkey % 97) AS jwks_uri, CASE WHEN p_partkey % 97 < 5 THEN NULL WHEN p_partkey % 97 < 50 THEN 'RS256' WHEN p_size % 2 = 0 THEN 'ES256' ELSE 'RS256' END AS alg FROM part) GROUP BY 1""")
def a8_key_sets(spark, d):
    keys = table(spark, d, "part").selectExpr("concat('https://idp', p_partkey % 97) AS jwks_uri", "CASE WHEN p_partkey % 97 < 5 THEN NULL WHEN p_partkey % 97 < 50 THEN 'RS256' WHEN p_size % 2 = 0 THEN 'ES256' ELSE 'RS256' END AS alg")
    return a.key_set_audit(keys)


#: Rules of the strict policy: method, first two parts of the path, company, number of parts. Fixed values.
RULES = [("GET", "", None, None, "0"), ("GET", "static", "img", None, None), ("GET", "static", "css", None, None), ("GET", "collections", None, None, "1"), (None, "collections", "obs", "osgeo", None), (None, "collections", "lakes", "acme", None)]
_ALLOWED = """(method = 'GET' AND (path LIKE '/static/img/%' OR path = '/collections')) OR (path LIKE '/collections/obs%' AND coalesce(company = 'osgeo', FALSE)) OR (path LIKE '/collections/lakes%' AND coalesce(company = 'acme', FALSE))"""


def _rules(spark):
    names = ["method", "p0", "p1", "company", "depth"]
    values = ", ".join("(" + ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in r) + ")" for r in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})").withColumn("depth", F.col("depth").cast("int"))


@query(f"SELECT req_id, {_ALLOWED} AS allowed FROM {{requests}}")
def a9_policy(spark, d):
    return a.policy(view(spark, d, "requests"), _rules(spark)).select("req_id", "allowed")


#: A rule for each part, any field of which may be open; and requests for collections named like them.
_PART_RULES = """SELECT CASE WHEN p_partkey % 3 > 0 THEN 'GET' END AS method, CASE WHEN p_partkey % 4 > 0 THEN 'collections' END AS p0, CASE WHEN p_partkey % 97 > 0 THEN concat('c', CAST(p_partkey AS STRING)) END AS p1,
    CASE p_partkey % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'osgeo' WHEN 2 THEN concat('x', CAST(p_size AS STRING)) END AS company, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 97 = 0 THEN 4 END AS depth FROM {part}"""
_PART_REQUESTS = "SELECT req_id, method, company, concat(CASE WHEN req_id % 11 = 0 THEN '/jobs/c' ELSE '/collections/c' END, CAST(req_id % 5000 AS STRING), CASE WHEN req_id % 2 = 0 THEN '/items' ELSE '' END) AS path FROM {requests}"


@query(f"""WITH r AS ({_PART_RULES.format(part='part')}), q AS ({_PART_REQUESTS}) SELECT req_id, EXISTS (SELECT 1 FROM r WHERE (r.method IS NULL OR r.method = q.method) AND (p0 IS NULL OR p0 = split_part(path, '/', 2)) AND (p1 IS NULL OR p1 = split_part(path, '/', 3))
    AND (r.company IS NULL OR r.company = q.company) AND (depth IS NULL OR depth = len(string_split(path, '/')) - 1)) AS allowed FROM q""")
def a9_open_rules(spark, d):
    view(spark, d, "requests").createOrReplaceTempView("quillon_requests")
    asked = spark.sql(_PART_REQUESTS.format(requests="quillon_requests"))
    return a.policy(asked, spark.sql(_PART_RULES.format(part=f"parquet.`{d}/part.parquet`"))).select("req_id", "allowed")


@query("SELECT id, collection FROM {features} WHERE collection IN (SELECT event_type FROM events WHERE user_id % 5 = 0 AND event_type <> 'click')")
def a10_visible(spark, d):
    grants = table(spark, d, "events").where("user_id % 5 = 0 AND event_type <> 'click'").select(F.col("event_type").alias("collection")).distinct()
    return a.visible(view(spark, d, "features"), grants).select("id", "collection")


@query(f"SELECT company, CASE WHEN {_ALLOWED} THEN 200 ELSE 401 END AS status, count(*) AS n FROM {{requests}} GROUP BY 1, 2")
def a11_denied_status(spark, d):
    return a.policy(view(spark, d, "requests"), _rules(spark)).groupBy("company", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT req_id, 401 AS status FROM {requests} WHERE NOT path LIKE '/api/openapi%' AND ("user" IS NULL OR sha256("user") NOT IN (SELECT sha256('u' || o_custkey) FROM orders))""")
def a12_api_keys(spark, d):
    known = table(spark, d, "orders").select(F.sha2(F.concat(F.lit("u"), F.col("o_custkey").cast("string")), 256).alias("key_hash"))
    df = view(spark, d, "requests").withColumn("key_hash", F.sha2("user", 256))
    return a.rejected_keys(df, known, a.is_public("path", ["/openapi"], "/api")).select("req_id", "status")


@query("""SELECT req_id, CASE WHEN "user" IS NOT NULL THEN 'ok' WHEN lower(authorization) LIKE 'bearer %' THEN 'invalid_token' ELSE 'unauthenticated' END AS outcome FROM {requests}""".replace("authorization", '"authorization"'))
def a13_bearer(spark, d):
    return view(spark, d, "requests").select("req_id", a.bearer_outcome().alias("outcome"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN 'write' ELSE 'read' END AS scope FROM customer""")
def a14_missing_scope(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", "array('read', 'write') AS required", "CASE c_custkey % 3 WHEN 0 THEN array('read') WHEN 1 THEN array('write', 'read', 'x') END AS granted")
    return df.select("c_custkey", a.missing_scope().alias("scope"))


@query("SELECT dep_id FROM {deployments} WHERE with_tools AND NOT (coalesce(jwks, FALSE) AND oidc IS NOT NULL) AND NOT coalesce(opt_in, FALSE)")
def a15_exposed(spark, d):
    return a.exposed(view(spark, d, "deployments")).select("dep_id")


@query("SELECT dep_id FROM {deployments} WHERE CAST(coalesce(policy_mode, FALSE) AS INT) + CAST(coalesce(jwks, FALSE) AS INT) + CAST(key_mode AS INT) > 1 OR (key_mode AND key_value IS NULL)")
def a16_conflicts(spark, d):
    return a.conflicting_modes(view(spark, d, "deployments")).select("dep_id")


# ---------------------------------------------------------------- transforms

_FWD = "coalesce(fwd_proto, '') <> '' AND content_type IN ('application/json', 'text/html')"


@query(f"""SELECT resp_id, CASE WHEN {_FWD} THEN replace(body, '{APP}', fwd_proto || '://' || fwd_host) ELSE body END AS body, CAST(octet_length(encode(CASE WHEN {_FWD} THEN replace(body, '{APP}', fwd_proto || '://' || fwd_host) ELSE body END)) AS BIGINT) AS content_length,
    CASE WHEN {_FWD} THEN fwd_proto || '://' || fwd_host END AS forwarded_url FROM {{responses}}""")
def t1_t2_t3_rewrite(spark, d):
    return t.rewrite_links(view(spark, d, "responses"), APP).select("resp_id", "body", "content_length", "forwarded_url")


@query("SELECT req_id, CASE WHEN path = '/collections' THEN '/collections/' ELSE path END AS path FROM {requests}")
def t4_mount_root(spark, d):
    return view(spark, d, "requests").select("req_id", t.mount_root("path", "/collections").alias("path"))


@query("SELECT page_id, u AS path FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '//' ELSE url END AS u FROM pages) UNION ALL SELECT page_id, rtrim(u, '/') FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '//' ELSE url END AS u FROM pages) WHERE u LIKE '%/'")
def t5_aliases(spark, d):
    return t.slashless_aliases(table(spark, d, "pages").selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN concat(url, '//') ELSE url END AS path"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a//b' ELSE split_part(url, '://', 1) || '://' || replace(replace(substr(url, position('://' IN url) + 3), '/', '///'), '//', '/') END AS url FROM pages")
def t6_single_slashes(spark, d):
    df = table(spark, d, "pages").selectExpr("page_id", "CASE WHEN page_id % 3 = 0 THEN 'a//b' ELSE concat(substring_index(url, '://', 1), '://', replace(substring(url, instr(url, '://') + 3), '/', '///')) END AS url")
    return df.select("page_id", t.single_slashes("url").alias("url"))


@query("SELECT page_id, url AS issuer FROM pages")
def t7_issuer(spark, d):
    df = table(spark, d, "pages").withColumn("url", F.concat("url", F.lit("/.well-known/openid-configuration")))
    return df.select("page_id", t.issuer("url").alias("issuer"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN rtrim(url, '/') || '/mcp/' ELSE 'http://h' || page_id || ':' || (8000 + page_id % 9) || '/mcp/' END AS base FROM pages")
def t8_base_url(spark, d):
    df = table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat(url, '//') WHEN 1 THEN '' END AS app_uri", "concat('h', page_id) AS host", "8000 + page_id % 9 AS port")
    return df.select("page_id", t.base_url("app_uri", "host", "port", "/mcp/").alias("base"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'always' WHEN o_orderkey % 4 = 1 THEN 'never' ELSE 'remember' END AS mode FROM orders")
def t9_consent_mode(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN ' Always ' WHEN 1 THEN 'NEVER' WHEN 2 THEN 'maybe' END AS value")
    return df.select("o_orderkey", t.consent_mode("value", ["always", "remember", "external", "never"], "remember").alias("mode"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 86400 WHEN o_custkey % 100 - 50 > 0 THEN o_custkey % 100 - 50 END AS ttl FROM orders")
def t10_ttl(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 100 - 50 END AS value")
    return df.select("o_orderkey", t.token_ttl("value").cast("long").alias("ttl"))


@query("SELECT o_orderkey, 'j' || o_orderkey || '-' || o_orderstatus AS job FROM orders")
def t11_job_id(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("j\n"), F.col("o_orderkey").cast("string"), F.lit("%0A-\r%0D"), "o_orderstatus").alias("job"))
    return df.select("o_orderkey", t.clean_job_id("job").alias("job"))


_OPS = "(SELECT CAST(doc_id % 40 AS BIGINT) AS doc, p_size, path, method FROM {operations})"


@query(f"""SELECT doc, path, method, CASE WHEN every OR method = 'put' THEN '200' WHEN method = 'options' THEN '200,401,404' ELSE '200,401' END AS responses, NOT every AND method <> 'put' AS secured
    FROM (SELECT *, bool_and(path LIKE '%openapi%') OVER (PARTITION BY doc) AS every FROM {_OPS}) WHERE every OR NOT path LIKE '%openapi%'""")
def t12_secure_operations(spark, d):
    ops = view(spark, d, "operations").selectExpr("doc_id % 40 AS doc_id", "path", "method", "array('200') AS responses")
    return t.secure_operations(ops).select(F.col("doc_id").alias("doc"), "path", "method", F.array_join("responses", ",").alias("responses"), "secured")


@query("""SELECT doc, max_by(kind, pos) AS scheme_type, bool_and(kind <> 'custom') AS applied FROM (SELECT o_custkey AS doc, o_orderkey AS pos, CASE WHEN o_orderkey % 17 = 0 THEN 'custom' WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'oauth2' END AS kind FROM orders) GROUP BY doc""")
def t13_last_scheme(spark, d):
    df = table(spark, d, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS position", "CASE WHEN o_orderkey % 17 = 0 THEN 'custom' WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'oauth2' END AS scheme_type")
    return t.last_scheme(df, ["http", "apiKey", "oauth2", "openIdConnect"]).withColumnRenamed("doc_id", "doc")


# ---------------------------------------------------------------- processes and streams

@query("SELECT c_custkey AS id, 'echo' AS output_id, 'Hello ' || c_name || '!' AS value FROM customer")
def p1_hello(spark, d):
    return p.execute("hello-world", table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")).select("id", "output_id", "value")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'MissingParameterValue' WHEN 1 THEN 'InvalidParameterValue' ELSE c_name END AS outcome FROM customer")
def p2_inputs(spark, d):
    body = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("name")))).when(F.col("c_custkey") % 3 == 1, F.lit('{"inputs":{}}')).otherwise(F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("inputs"))))
    good, bad = p.parse_inputs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), body.alias("body")))
    return good.select("id", F.col("name").alias("outcome")).union(bad.select("id", "reason"))


@query("SELECT DISTINCT type, CASE WHEN type = 'process' THEN 'hello-world' END AS process FROM {registry}")
def p3_registry(spark, d):
    kinds = view(spark, d, "registry").select("type").distinct()
    return kinds.join(p.registry(spark).select("type", F.col("name").alias("process")), "type", "left")


@query(f"SELECT req_id, {_PUB} AS is_public, {_ALLOWED} AS allowed FROM {{requests}}")
def r1_stream_decisions(spark, d):
    path = shared_path(spark, "requests")
    view(spark, d, "requests").write.parquet(path)
    stream = streams.read_parquet_stream(view(spark, d, "requests"), path)
    def rule(df):
        return a.policy(df, _rules(spark)).select("req_id", _public().alias("is_public"), "allowed")

    return streams.run_once(stream, rule, "decisions")


def _streamed(spark, df, rule, name):
    """What a rule gives on a stream of a view's rows."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return streams.run_once(streams.read_parquet_stream(df, path), rule, name)


@query("""SELECT req_id, CASE WHEN method = 'OPTIONS' OR {pub} OR "user" IS NOT NULL THEN 'pass' WHEN req_id % 9 = 0 THEN 'redirect' ELSE 'unauthenticated' END AS decision,
    CASE WHEN "user" IS NOT NULL THEN 'ok' WHEN lower("authorization") LIKE 'bearer %' THEN 'invalid_token' ELSE 'unauthenticated' END AS outcome,
    CASE WHEN path = '/collections' THEN '/collections/' ELSE path END AS path FROM {{requests}}""".replace("{{requests}}", "{requests}").replace("{pub}", _PUB))
def r1_stream_requests(spark, d):
    """Decision, bearer outcome and mount path of requests on a stream."""
    def rule(df):
        df = df.withColumns({"kind": F.lit("http"), "has_claims": F.col("user").isNotNull(), "redirect": F.col("req_id") % 9 == 0})
        return df.select("req_id", a.decision(_public())["decision"].alias("decision"), a.bearer_outcome().alias("outcome"), t.mount_root("path", "/collections").alias("path"))

    return _streamed(spark, view(spark, d, "requests"), rule, "request-rules")


@query(f"SELECT sub, {_REASON} AS reason, array_to_string({_AUD}, ' ') AS aud, CASE WHEN sub % 3 = 1 THEN NULL WHEN sub % 3 = 0 THEN 'write' ELSE 'read' END AS scope FROM {{claims}}")
def r1_stream_tokens(spark, d):
    """Audience, issuer, expiry and scope checks of tokens on a stream."""
    claims = view(spark, d, "claims").selectExpr("*", "array('read', 'write') AS required", "CASE sub % 3 WHEN 0 THEN array('read') WHEN 1 THEN array('write', 'read', 'x') END AS granted")

    def rule(df):
        return df.select("sub", a.token_reason(AUD, ISS, 1700012000).alias("reason"), F.array_join(a.audience(), " ").alias("aud"), a.missing_scope().alias("scope"))

    return _streamed(spark, claims, rule, "token-rules")


def r1_stream_rewrite(spark, d):
    """Forwarded links, body length and marker of responses on a stream."""
    return _streamed(spark, view(spark, d, "responses"), lambda df: t.rewrite_links(df, APP).select("resp_id", "body", "content_length", "forwarded_url"), "rewrites")


QUERIES["r1_stream_rewrite"], SQL["r1_stream_rewrite"] = r1_stream_rewrite, SQL["t1_t2_t3_rewrite"]


@query("SELECT req_id, 401 AS status FROM {requests} WHERE NOT {pub} AND req_id % 4 NOT IN (0, 1)".replace("{pub}", _PUB))
def r1_stream_keys(spark, d):
    """Requests beyond public paths without a known key, on a stream that meets a static table of keys."""
    def rule(df):
        known = rows(spark, [("0",), ("1",)], ["key_hash"])
        return a.rejected_keys(df.withColumn("key_hash", (F.col("req_id") % 4).cast("string")), known, _public()).select("req_id", "status")

    return _streamed(spark, view(spark, d, "requests"), rule, "key-rules")


def _stream_fetches(spark, d):
    path = shared_path(spark, "accesses")
    df = view(spark, d, "accesses").select("url_id", "t")
    df.write.parquet(path)
    return streams.run_once(streams.read_parquet_stream(df, path), lambda s: streams.first_per_ttl(s, "url_id"), "fetches")


@query("SELECT DISTINCT user_id AS url_id FROM events")
def r2_stream_fetches(spark, d):
    return _stream_fetches(spark, d).select("url_id").distinct()


@query()
def r2_stream_fetch_counts(spark, d):
    """The fetches of the stream for each URL, with the SQL of the replay."""
    return _stream_fetches(spark, d).groupBy("url_id").agg(F.count(F.lit(1)).alias("n_fetches"))


SQL["r2_stream_fetch_counts"] = SQL["g11_replay"]
