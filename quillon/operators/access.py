"""Access decisions over request logs, token claims and deployments: rules as column expressions and joins."""
from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule may ask for, and the rules of one shape that are broadcast at most.
RULE, BROADCAST_RULES = ("method", "p0", "p1", "company", "depth"), 1_000_000


def is_public(path: str, patterns: Sequence[str], context: str = "") -> Column:
    """Whether a pattern, behind the context path, matches at the start of the path (not the whole of it)."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.col(path).rlike("^(?:" + "|".join(f"(?:{context}{p})" for p in patterns) + ")"), F.lit(False))


def decision(public: Column, kind: str = "kind", method: str = "method", claims: str = "has_claims", redirect: str = "redirect") -> Column:
    """``(decision, status)`` of a request, checks in order of cost: life cycle, OPTIONS, public path, claims, redirect, else 401."""
    def row(name, status):
        return F.struct(F.lit(name).alias("decision"), F.lit(status).cast("int").alias("status"))

    return (F.when(F.col(kind) == "lifespan", row("pass", 200)).when(F.col(method) == "OPTIONS", row("pass", 200)).when(public, row("pass", 200))
            .when(F.coalesce(F.col(claims), F.lit(False)), row("pass", 200)).when(F.coalesce(F.col(redirect), F.lit(False)), row("redirect", 302)).otherwise(row("unauthenticated", 401)))


def audience_list(aud: str = "aud") -> Column:
    """The audiences of a claim kept as text: a plain string, or a JSON list of strings."""
    text = F.trim(F.col(aud))
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).when(text != "", F.array(text))


def audience(aud: str | Column = "aud", client_id: str = "client_id") -> Column:
    """The audience list, ``aud`` being a list or ``audience_list`` of a text; the client's id stands in where there is none."""
    given = F.filter(F.col(aud) if isinstance(aud, str) else aud, lambda x: x != "")
    return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).when(F.coalesce(F.col(client_id), F.lit("")) != "", F.array(client_id))


def token_reason(expected_aud: str | None, expected_iss: str | None, now: int, aud: Column | None = None) -> Column:
    """The first failing check of a token, or ``ok``: audience, issuer, expiry. A check without an expectation is left out."""
    aud = audience() if aud is None else aud
    out = F.when(F.lit(False), F.lit(""))
    if expected_aud:
        out = out.when(aud.isNull(), "missing_audience").when(~F.array_contains(aud, expected_aud), "wrong_audience")
    if expected_iss:
        out = out.when(F.coalesce(F.col("iss"), F.lit("")) == "", "missing_issuer").when(F.col("iss") != expected_iss, "wrong_issuer")
    return out.when(F.col("exp") < now, "expired").otherwise("ok")


def reasons(claims: DataFrame, expected_aud: str | None, expected_iss: str | None, now: int) -> DataFrame:
    return claims.groupBy(token_reason(expected_aud, expected_iss, now).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def key_set_audit(keys: DataFrame) -> DataFrame:
    """Algorithms of each key set: exactly one is right, several or none are errors."""
    n = F.count_distinct("alg")
    return keys.groupBy("jwks_uri").agg(n.alias("n_algs"), F.when(n == 1, "ok").when(n > 1, "multiple").otherwise("none").alias("outcome"))


def path_parts(path: str = "path") -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def policy(requests: DataFrame, rules: DataFrame, default: bool = False) -> DataFrame:
    """Requests with ``allowed`` and ``status``. A rule has ``method``, ``p0``, ``p1`` and ``company``, null where it does not matter, and ``depth``, the
    exact number of path parts, or null. Any rule that matches allows; a denial is 401. ``rules`` has one row a rule. A request without a path has no parts, and meets only rules that ask for none or for an empty first one.

    Rules are indexed by which fields they ask for: 32 shapes at most. Within a shape, a rule is an exact key, so a request makes one lookup for each shape that occurs, however many rules
    there are; shapes of up to ``BROADCAST_RULES`` rules are broadcast, and then requests are read once and not shuffled. Requests may be a stream.
    """
    own = requests.columns
    of = {f"_is_{c}": F.col(c) for c in ("method", "company")} | {"_parts": path_parts()}
    asked = requests.withColumns(of).withColumns({"_is_p0": F.coalesce(F.get("_parts", F.lit(0)), F.lit("")), "_is_p1": F.get("_parts", F.lit(1)), "_is_depth": F.size("_parts")})
    shapes = rules.groupBy(*(F.col(c).isNotNull().alias(c) for c in RULE)).agg(F.count(F.lit(1)).alias("n")).collect()
    allowed = F.lit(default)
    for k, shape in enumerate(shapes):
        fields = [c for c in RULE if shape[c]]
        if not fields:
            allowed = F.lit(True)
            continue
        such = functools.reduce(Column.__and__, (F.col(c).isNotNull() if c in fields else F.col(c).isNull() for c in RULE))
        keys = rules.where(such).select(*(F.col(c).alias(f"_rule{k}_{c}") for c in fields)).distinct().withColumn(f"_hit{k}", F.lit(True))
        meets = functools.reduce(Column.__and__, (F.col(f"_is_{c}") == F.col(f"_rule{k}_{c}") for c in fields))
        asked = asked.join(F.broadcast(keys) if shape.n <= BROADCAST_RULES else keys, meets, "left")
        allowed = allowed | F.coalesce(F.col(f"_hit{k}"), F.lit(False))
    return asked.select(*own, allowed.alias("allowed"), F.when(allowed, 200).otherwise(401).alias("status"))


def visible(features: DataFrame, grants: DataFrame) -> DataFrame:
    """Features of collections that are granted."""
    return features.join(grants, "collection", "left_semi")


def rejected_keys(requests: DataFrame, known: DataFrame, public: Column) -> DataFrame:
    """Requests beyond public paths whose key's hash is not known. Keys are compared by hash and never returned."""
    return requests.where(~public).join(known.select("key_hash").distinct(), "key_hash", "left_anti").withColumn("status", F.lit(401))


def bearer_outcome(user: str = "user", authorization: str = "authorization") -> Column:
    """``ok``, ``invalid_token`` (a bearer token without a user) or ``unauthenticated`` (neither)."""
    bearer = F.coalesce(F.startswith(F.lower(authorization), F.lit("bearer ")), F.lit(False))
    return F.when(F.col(user).isNotNull(), "ok").when(bearer, "invalid_token").otherwise("unauthenticated")


def missing_scope(required: str = "required", granted: str = "granted") -> Column:
    """The first required scope that is not granted, in the order required; null if all are."""
    return F.get(F.array_except(F.col(required), F.coalesce(F.col(granted), F.array().cast("array<string>"))), F.lit(0))


def _on(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def exposed(deployments: DataFrame) -> DataFrame:
    """Deployments that offer tools to anyone without having opted in."""
    return deployments.where(_on("with_tools") & ~(_on("jwks") & F.col("oidc").isNotNull()) & ~_on("opt_in"))


def conflicting_modes(deployments: DataFrame) -> DataFrame:
    """Deployments with more than one access mode, or with key mode and no key. Nulls are off."""
    several = sum(_on(m).cast("int") for m in ("policy_mode", "jwks", "key_mode")) > 1
    return deployments.where(several | (_on("key_mode") & (F.coalesce("key_value", F.lit("")) == "")))
