"""Capability roll-up over a table of many services.

``rows`` has ``service_id, resource_type, provider_type``; ``classes`` has ``grp, cls``. Class tables have a few hundred rows and are
small enough for Spark to broadcast by itself.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def provider_rows(resources: DataFrame) -> DataFrame:
    """One row a resource and provider type. A process has the type ``process`` once, whatever its providers."""
    kinds = F.when(F.col("type") == "process", F.array(F.lit("process"))).otherwise(F.col("provider_types"))
    return resources.select("service_id", F.explode(kinds).alias("provider_type"))


def provider_classes(rows: DataFrame, classes: DataFrame, item_groups: dict[str, str]) -> DataFrame:
    """Classes of each provider type, and for some types those of another group too; unknown types add nothing."""
    extra = F.create_map(*[x for k, v in item_groups.items() for x in (F.lit(k), F.lit(v))]) if item_groups else F.lit(None).cast("map<string,string>")
    groups = F.array_distinct(F.array_compact(F.array(F.col("provider_type"), F.try_element_at(extra, F.col("provider_type")))))
    return rows.select("service_id", F.explode(groups).alias("grp")).distinct().join(classes, "grp").select("service_id", "cls")


def with_base(services: DataFrame, found: DataFrame, base: DataFrame) -> DataFrame:
    """Base classes for every service, those without resources included. ``base`` is one group's list."""
    return services.select("service_id").distinct().crossJoin(base.select("cls")).union(found)


def optional(services: DataFrame, flag: str, classes: DataFrame) -> DataFrame:
    """Classes that a service has only where its flag is set."""
    return services.where(F.coalesce(flag, F.lit(False))).select("service_id").distinct().crossJoin(classes.select("cls"))


def roll_up(pairs: DataFrame) -> DataFrame:
    """Sorted distinct classes of each service; sets are combined before the shuffle."""
    return pairs.groupBy("service_id").agg(F.array_sort(F.collect_set("cls")).alias("conforms_to"))


def missing(services: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    return services.select("service_id").distinct().crossJoin(expected.select("cls")).exceptAll(pairs.select("service_id", "cls").distinct())


def forbidden(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return pairs.join(classes.select("cls"), "cls", "left_semi").select("service_id", "cls").distinct()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classes added and removed between two snapshots of ``(service_id, cls)``."""
    a, b = (x.select("service_id", "cls").distinct() for x in (before, after))
    key = ["service_id", "cls"]
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))
