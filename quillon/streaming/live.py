"""Capability roll-ups that follow a stream of changed resources.

A change adds or withdraws a resource: ``op`` (``insert`` or ``delete``) and the columns of ``capabilities.provider_rows``, a deletion with those that were inserted. Spark's state holds how
many resources give a service each class, so a class goes when the last resource that gives it does. What a batch changed is written once, under its number; the roll-ups
of ``operators.capabilities`` then hold after any batch.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import capabilities as c
from quillon.sources.scratch import shared_path


def counted(changes: DataFrame, classes: DataFrame, item_groups: dict[str, str]) -> DataFrame:
    """``(service_id, cls, n)``: resources that give a service each class, and with ``cls`` null all of its resources. A stream or a batch; a change without a
    known ``op`` or a service counts for nothing."""
    delta = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1)
    known = changes.withColumn("_delta", delta.cast("long")).where("_delta is not null and service_id is not null")
    extra = F.create_map(*[x for k, v in item_groups.items() for x in (F.lit(k), F.lit(v))]) if item_groups else F.lit(None).cast("map<string,string>")
    kinds = known.select("service_id", "_delta", F.explode(F.array_distinct(F.when(F.col("type") == "process", F.array(F.lit("process"))).otherwise(F.col("provider_types")))).alias("kind"))
    groups = kinds.select("service_id", "_delta", F.explode(F.array_distinct(F.array_compact(F.array(F.col("kind"), F.try_element_at(extra, F.col("kind")))))).alias("grp"))
    given = groups.join(classes.select("grp", "cls").distinct(), "grp").select("service_id", "cls", "_delta")
    every = given.union(known.select("service_id", F.lit(None).cast("string"), "_delta"))
    return every.groupBy("service_id", "cls").agg(F.sum("_delta").alias("n"))


class Live:
    """Runs the changes that are there through ``counted``, and gives the roll-ups after the last batch or any before it. Batches are numbered from 0."""

    def __init__(self, like: DataFrame, classes: DataFrame, base: DataFrame, item_groups: dict[str, str] | None = None):
        self.spark, self.classes, self.base, self.item_groups = like.sparkSession, classes, base, item_groups or {}
        self.out, self.mark = shared_path(self.spark, "live"), shared_path(self.spark, "live-offsets")

    def run(self, stream: DataFrame) -> None:
        """Takes all that is there. May be called again with the same source; state and batches go on."""
        def put(changed: DataFrame, batch: int) -> None:  # written again as a whole if a batch is run again
            changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.out}/of={batch}")

        found = counted(stream, self.classes, self.item_groups)
        found.writeStream.outputMode("update").option("checkpointLocation", self.mark).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()

    def counts(self, batch: int | None = None) -> DataFrame:
        """``(service_id, cls, n)`` above 0 after a batch."""
        held = self.spark.read.schema("service_id long, cls string, n long, batch long, of int").parquet(self.out)
        held = held if batch is None else held.where(F.col("of") <= batch)
        return held.groupBy("service_id", "cls").agg(F.max_by("n", "batch").alias("n")).where("n > 0")

    def services(self, batch: int | None = None) -> DataFrame:
        return self.counts(batch).where("cls is null").select("service_id")

    def pairs(self, batch: int | None = None) -> DataFrame:
        """``(service_id, cls)`` with the base classes of every service that has a resource."""
        return c.with_base(self.services(batch), self.counts(batch).where("cls is not null").select("service_id", "cls"), self.base).distinct()

    def roll_up(self, batch: int | None = None) -> DataFrame:
        return c.roll_up(self.pairs(batch))

    def missing(self, expected: DataFrame, batch: int | None = None) -> DataFrame:
        return c.missing(self.services(batch), expected, self.pairs(batch))

    def changes(self, before: int, after: int | None = None) -> DataFrame:
        """Classes that services gained and lost between two batches."""
        return c.changes(self.pairs(before), self.pairs(after))
