"""Bounded samples of labelled rows, for fitting models."""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, save

#: Different labels at most.
VALUES = 50


def sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int, where=None) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled ids, spread evenly over the values of ``column``.

    ``where`` is a condition on ``doc_id``. Ids are chosen by hash, so the choice does not depend on the order of rows.
    Null ids and null labels do not count; an id that is labelled twice has the larger value. Ids that ``docs`` lacks do
    not count. Only the id list is sorted; texts are fetched by a broadcast of at most ``max_rows`` ids.
    """
    from pyspark.sql import Window

    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = save(rows.withColumn("at", F.xxhash64("doc_id")), "labelled")
    values = [r.label for r in rows.select("label").distinct().limit(VALUES + 1).collect()]
    if len(values) > VALUES:
        raise ValueError(f"{column} has more than {VALUES} values")
    if not values:
        return documents(docs).withColumn("label", F.lit(0)).limit(0)
    # the first of each value, by a partial choice in every task; what is ranked then is bounded
    first = functools.reduce(DataFrame.union, [rows.where(F.col("label") == v).orderBy("at", "doc_id").limit(max_rows) for v in sorted(values)])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    chosen = first.withColumn("rank", rank).orderBy("rank", "label").limit(max_rows).select("doc_id", "label")
    return documents(docs).join(F.broadcast(chosen), "doc_id")
