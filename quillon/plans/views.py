"""Views over the given tables that the queries read. ``SPARK`` and ``DUCK`` are the same text but for array literals."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

APP = "https://api.example.com"
_SQL = {
    "features": """SELECT event_id AS id, {ts} AS ts, event_type AS collection, value, user_id,
        CAST(((user_id * 37) % 360) - 180 AS DOUBLE) AS lon, CAST(((user_id * 17) % 180) - 90 AS DOUBLE) AS lat FROM {events}""",
    "registry": """SELECT p_partkey % 50 AS service_id, CASE WHEN p_size % 5 = 0 THEN 'process' ELSE 'collection' END AS type,
        CASE p_size % 4 WHEN 0 THEN 'feature' WHEN 1 THEN 'record' WHEN 2 THEN 'coverage' ELSE 'tile' END AS provider_type, p_partkey AS resource_id, p_size FROM {part}""",
    "requests": """SELECT event_id AS req_id, user_id, CASE WHEN event_type = 'signup' THEN 'OPTIONS' ELSE 'GET' END AS method,
        CASE event_type WHEN 'view' THEN '/api/openapi' WHEN 'error' THEN '/static/img/logo.png' WHEN 'signup' THEN '/collections'
            ELSE concat('/collections/', CASE WHEN user_id % 2 = 0 THEN 'obs' ELSE 'lakes' END) END AS path,
        CASE WHEN user_id % 3 = 0 THEN 'osgeo' WHEN user_id % 3 = 1 THEN 'acme' END AS company,
        CASE event_id % 4 WHEN 0 THEN 'Bearer marker' WHEN 1 THEN 'bEARER marker' WHEN 2 THEN 'Basic marker' END AS authorization,
        CASE WHEN event_id % 5 = 0 THEN concat('u', CAST(user_id AS STRING)) END AS user FROM {events}""",
    "claims": """SELECT c_custkey AS sub, CASE WHEN c_custkey % 7 = 0 THEN 'https://evil.example.com' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'https://idp.example.com' END AS iss,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN {open}'https://api.example.com', 'https://other.example.com'{close} ELSE {open}'https://other.example.com'{close} END AS aud,
        CASE WHEN c_custkey % 10 = 0 THEN 'https://api.example.com' END AS client_id, 1700000000 + CAST(c_nationkey AS BIGINT) * 1000 AS exp FROM {customer}""",
    "edges": "SELECT p_partkey AS src, (p_partkey * 7 + 3) % 2000 AS dst FROM {part}",
    "accesses": "SELECT user_id AS url_id, {seconds} AS t, event_id FROM {events}",
    "responses": """SELECT page_id AS resp_id, CASE page_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html' ELSE 'application/geo+json' END AS content_type,
        CASE WHEN page_id % 5 <> 0 THEN 'https' WHEN page_id % 2 = 0 THEN '' END AS fwd_proto, 'maps.example.org' AS fwd_host,
        concat('<a href="https://api.example.com/x">', url, '</a> https://api.example.com/y') AS body FROM {pages}""",
    "operations": """SELECT p_partkey AS doc_id, p_size, CASE WHEN p_size % 3 = 0 THEN '/openapi' ELSE concat('/collections/', CAST(p_size AS STRING)) END AS path,
        CASE p_partkey % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'options' WHEN 3 THEN 'delete' ELSE 'put' END AS method,
        concat('get-', replace(lower(p_brand), '#', '-'), '-', CAST(p_size AS STRING)) AS operation_id, p_type AS tag FROM {part}""",
    "specs": """SELECT concat('https://h', CAST(p_partkey % 7 AS STRING), '.example.com/d/', CAST(p_partkey AS STRING), '.json') AS url, p_partkey,
        concat('{{"a":{{"$ref":"https://h', CAST(p_partkey % 3 AS STRING), '.example.com/d/', CAST(p_partkey * 7 % 500 AS STRING), '.json#/c/x"}},"b":[{{"$ref":"#/c"}},{{"$ref":"more.json#/q","note":1}}],"c":{{"x":', CAST(p_size AS STRING), '}}}}') AS body FROM {part}""",
    "deployments": """SELECT s_suppkey AS dep_id, s_suppkey % 2 = 0 AS with_tools, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 2 = 0 END AS jwks, CASE WHEN s_suppkey % 5 < 3 THEN 'https://idp.example.com' END AS oidc,
        CASE WHEN s_suppkey % 7 = 0 THEN TRUE END AS opt_in, CASE WHEN s_suppkey % 11 < 3 THEN TRUE END AS policy_mode, s_suppkey % 13 = 0 AS key_mode, CASE WHEN s_suppkey % 2 = 0 THEN 'hash' END AS key_value FROM {supplier}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "part", "customer", "pages", "supplier")}
    return spark.sql(_SQL[name].format(ts="CAST(ts AS TIMESTAMP)", seconds="unix_seconds(CAST(ts AS TIMESTAMP))", open="array(", close=")", **tables))


def duck(name: str) -> str:
    """The view as a subquery for DuckDB."""
    tables = {t: t for t in ("events", "part", "customer", "pages", "supplier")}
    return f"({_SQL[name].format(ts='CAST(ts AS TIMESTAMP)', seconds='CAST(floor(epoch(ts)) AS BIGINT)', open='[', close=']', **tables)}) AS {name}"
