"""Helpers that several operators share: scratch tables, hashing constants, connected components."""
from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import materialise

#: Ids that are broadcast as a join side at most (16 MB of longs); larger sides are shuffled.
BROADCAST_IDS = 2_000_000


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder as Parquet and reads it back.

    The written table survives the loss of any executor.
    """
    return materialise(df, name)


def give_back() -> None:
    """Returns memory that Python no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def given_back(fit):
    """A function on the driver, which lives on, that gives its memory back when it returns."""
    @functools.wraps(fit)
    def run(*args, **named):
        try:
            return fit(*args, **named)
        finally:
            give_back()

    return run


def released(run):
    """A function over Arrow batches that gives its memory back at the end of a task: workers outlive tasks, and later stages use them too."""
    def over(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def slices(batch: pa.RecordBatch, at: int, most: int = 4_000_000):
    """Parts of a batch whose column ``at`` has about ``most`` bytes, or one longer value."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(size):
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` (null: empty); other columns are not read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small(df: DataFrame, rows: int = BROADCAST_IDS // 2) -> DataFrame:
    """A join side of a few numbers a row: broadcast below a checked count of rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of those names renamed, and the renaming that gives them back."""
    renamed = {c: fresh(df, f"own_{c}") for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(renamed), {v: k for k, v in renamed.items()}


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``. The id list is broadcast only below a checked count."""
    ids = ids.select(column).distinct()
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, column, "left_semi")


def _closer(links: DataFrame, side) -> DataFrame:
    """One round over the edges ``(u, v)``. Edges are doubled within their rows, so that each join is planned and run once: a
    union of two uses would have both sides' joins, broadcasts and shuffles twice, which the driver pays for in threads and memory."""
    def doubled(df: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
        ends = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (one, two)]
        return df.select(F.explode(F.array(*ends)).alias("e")).select("e.*")

    # large-star: every larger neighbour of u joins the smallest of u's neighbourhood
    low = doubled(links, ("u", "v"), ("v", "u")).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small-star: every smaller neighbour of u, and u, join the smallest of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return doubled(large.join(side(least), "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list, as ``(node, root)``.

    Alternates large-star and small-star steps until a round changes nothing. Each step is a grouped minimum and an
    equi-join, so no component is ever gathered in one task; each round is written to the shared folder. The side with the
    minima is broadcast where a count of its rows allows it, so that the many edges of one node stay where they are; beyond that
    count, Spark splits skewed joins.
    Self-edges and repeated edges are allowed. Nodes that only have self-edges get themselves.
    """
    pairs = save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct(), "cc")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links, before = pairs.where("u <> v"), None
    while True:
        n = before[0] if before else links.limit(BROADCAST_IDS // 4 + 1).count()  # edges; twice as many nodes at most
        side = F.broadcast if n <= BROADCAST_IDS // 4 else (lambda df: df)
        links = save(_closer(links, side), "cc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("root"))


__all__ = ["BROADCAST_IDS", "connected_components", "documents", "fresh", "give_back", "given_back", "only_ids", "released", "save", "set_aside", "slices", "small"]
