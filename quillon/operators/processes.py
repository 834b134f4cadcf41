"""Processes: named functions from DataFrame to DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hello_world(inputs: DataFrame) -> DataFrame:
    """``name`` in, ``(id, value)`` out; further columns pass through."""
    return inputs.withColumns({"output_id": F.lit("echo"), "value": F.concat(F.lit("Hello "), F.col("name"), F.lit("!"))})


#: The extension point: a process is registered under its name.
PROCESSES: dict[str, Callable[[DataFrame], DataFrame]] = {"hello-world": hello_world}


def parse_inputs(requests: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Requests with an ``inputs`` object that has a name, with that ``name``, and rejects with a ``reason``."""
    parsed = requests.withColumn("_in", F.from_json(column, "inputs struct<name:string>"))
    good = parsed.where("_in.inputs.name is not null").withColumn("name", F.col("_in.inputs.name")).drop("_in")
    reason = F.when(F.col("_in.inputs").isNull(), "MissingParameterValue").otherwise("InvalidParameterValue")
    return good, parsed.where("_in.inputs.name is null").withColumn("reason", reason).drop("_in")


def execute(name: str, inputs: DataFrame) -> DataFrame:
    if name not in PROCESSES:
        raise ValueError(f"no process {name!r}")
    return PROCESSES[name](inputs)


def registry(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(PROCESSES)))).alias("name")).withColumn("type", F.lit("process"))
