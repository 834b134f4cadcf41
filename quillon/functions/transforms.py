"""URL, body and text rules as column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content types whose bodies are rewritten; others are left alone. Fixed values.
REWRITTEN_TYPES = ("application/json", "application/ld+json", "application/schema+json", "application/vnd.oai.openapi+json;version=3.0", "text/html")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def forwarded(base: str, types: Sequence[str] = REWRITTEN_TYPES, proto: str = "fwd_proto", host: str = "fwd_host", content_type: str = "content_type") -> Column:
    """Whether a response's links are rewritten: both headers there, and exactly one of the content types."""
    return _filled(proto) & _filled(host) & F.coalesce(F.col(content_type).isin(*types), F.lit(False))


def rewrite_links(df: DataFrame, base: str, types: Sequence[str] = REWRITTEN_TYPES) -> DataFrame:
    """Responses with ``body`` rewritten, ``content_length`` in bytes, and ``forwarded_url`` where something was rewritten."""
    target, cond = F.concat("fwd_proto", F.lit("://"), "fwd_host"), forwarded(base, types)
    return df.withColumn("forwarded_url", F.when(cond, target)).withColumn("body", F.when(cond, F.replace("body", F.lit(base), target)).otherwise(F.col("body"))).withColumn("content_length", F.octet_length("body").cast("long"))


def mount_root(path: str, root: str) -> Column:
    """The exact mount path gets its slash; nothing else changes."""
    return F.when(F.col(path) == root, root + "/").otherwise(F.col(path))


def slashless_aliases(routes: DataFrame, path: str = "path") -> DataFrame:
    """Routes, and for each that ends in a slash one without."""
    return routes.union(routes.where(F.col(path).endswith("/")).withColumn(path, F.rtrim(F.col(path), F.lit("/"))))


def single_slashes(url: str) -> Column:
    """Double slashes behind the scheme made single, in one pass from the left; without a scheme nothing changes."""
    at = F.instr(F.col(url), "://")
    rest = F.substring(F.col(url), at + 3, F.length(url))
    return F.when(at > 0, F.concat(F.substring(F.col(url), F.lit(1), at + 2), F.replace(rest, F.lit("//"), F.lit("/")))).otherwise(F.col(url))


def issuer(url: str) -> Column:
    return F.replace(F.col(url), F.lit("/.well-known/openid-configuration"), F.lit(""))


def base_url(app_uri: str, host: str, port: str, mount: str) -> Column:
    """The public address with the mount path, or else host and port."""
    return F.coalesce(F.concat(F.rtrim(F.nullif(F.col(app_uri), F.lit("")), F.lit("/")), F.lit(mount)), F.concat(F.lit("http://"), F.col(host), F.lit(":"), F.col(port).cast("string"), F.lit(mount)))


def consent_mode(value: str, known: Sequence[str], default: str) -> Column:
    """Trimmed and lower-cased, or the default for null and unknown values."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*known), v).otherwise(default)


def token_ttl(value: str, default: int = 86400) -> Column:
    """Null: the default; zero and below: null; else the value."""
    return F.when(F.col(value).isNull(), default).when(F.col(value) > 0, F.col(value))


def clean_job_id(value: str) -> Column:
    out = F.translate(value, "\n\r", "")
    for code in ("%0A", "%0D"):
        out = F.replace(out, F.lit(code), F.lit(""))
    return out


def secure_operations(operations: DataFrame) -> DataFrame:
    """Operations ``(doc_id, path, method, responses)`` with security: get, post, options and delete require it and answer 401, options 404 too.

    Paths that contain ``openapi`` are dropped, unless every path of a document does; such documents stay untouched.
    """
    secured = F.col("method").isin("get", "post", "options", "delete")
    per_doc = operations.groupBy("doc_id").agg(F.bool_and(F.contains("path", F.lit("openapi"))).alias("_all"))
    out = operations.join(per_doc, "doc_id").where(F.col("_all") | ~F.contains("path", F.lit("openapi")))
    added = F.when(F.col("method") == "options", F.array(F.lit("401"), F.lit("404"))).otherwise(F.array(F.lit("401")))
    change = secured & ~F.col("_all")
    return out.select("doc_id", "path", "method", F.when(change, F.array_sort(F.array_union("responses", added))).otherwise(F.array_sort("responses")).alias("responses"), change.alias("secured"))


def last_scheme(schemes: DataFrame, known: Sequence[str]) -> DataFrame:
    """Schemes share a key, so that the last of a document wins; only documents whose types are all known have one."""
    return schemes.groupBy("doc_id").agg(F.max_by("scheme_type", "position").alias("scheme_type"), F.bool_and(F.col("scheme_type").isin(*known)).alias("applied"))
