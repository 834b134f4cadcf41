"""Hard negatives from candidate blocks in the order of a Hilbert curve, with zone maps.

Vectors become whole numbers and are laid out as Parquet blocks of bounded size, label by label in the order of a Hilbert curve through their main
directions. A zone map has the least and largest component of a block in every dimension; interval arithmetic over it bounds every inner product with
the block's rows. An anchor looks for the best scores within a window, and reads only blocks whose interval meets it:

* its positives: best scores of its own label, from the k-th best of its own block on;
* its negatives: best scores of other labels, between two shares of a positive's score.

The curve is fitted on at most ``SAMPLE`` rows; it decides the order of blocks only, and results are exact whatever the order. Anchors and zone maps meet
in packs of many rows, in a grid of cells, and no label, vector or anchor is gathered: blocks and packs have bounded sizes, and the best of a window are chosen in each task before
tasks meet.

Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows that repeat an id are rows of their own, as anchors too, and no partners of
each other. Shorter vectors end in zeros. Scores are 64-bit; components too large for that are an error. An empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import released, save

#: Rows of a candidate block; anchors, or zone maps, of a pack; rows that the curve is fitted on.
BLOCK, PACK, SAMPLE = 256, 256, 2000
#: Main directions that the curve goes through, and bits of each.
AXES, BITS = 8, 8
#: Cells on a side of the grid in which packs of anchors and packs of zone maps meet.
GRID = 16
LEAST, MOST = -(2**62), 2**62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as big-endian bytes, of points with whole coordinates below ``2**bits`` (rows of ``cells``)."""
    x = cells.astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for axis in x:
            inverted = (axis & q) != 0
            x[0] ^= np.where(inverted, q - 1, 0)
            swap = np.where(inverted, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= swap
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    digits = np.stack([(axis >> b) & 1 for b in range(bits - 1, -1, -1) for axis in x], axis=1)
    return np.packbits(digits.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows that end in zeros."""
    length = column.value_lengths().to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = column.flatten().to_numpy()
    return out


def _stacked(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exactly; in doubles where these hold every sum."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if largest >= 2**62:
        raise OverflowError("components are too large for scores of 64 bits")
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if largest < 2**53 else a.astype(np.int64) @ b.T.astype(np.int64)


def _bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each vector with anything between ``low`` and ``high``."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return _times(up, low) + _times(down, high), _times(up, high) + _times(down, low)


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each group by descending score and ascending id."""
    order = np.lexsort((ids, -score, group))
    group, score, ids = group[order], score[order], ids[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    taken = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k
    return group[taken], score[taken], ids[taken]


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), names.values())], list(names))


def _runs(batches: Iterator[pa.RecordBatch], label: int, most: int) -> Iterator[dict[str, list]]:
    """Rows that follow each other and agree in a column, at most so many at a time, as lists by name."""
    held: dict[str, list] = {}
    for batch in batches:
        own = batch.to_pydict()
        values = batch.column(label).to_pylist()
        first = 0
        while first < len(values):
            n = len(held[batch.schema.names[label]]) if held else 0
            if n and (n == most or held[batch.schema.names[label]][0] != values[first]):
                yield held
                held, n = {}, 0
            last = first
            while last < len(values) and last - first < most - n and values[last] == values[first]:
                last += 1
            held = {name: held.get(name, []) + column[first:last] for name, column in own.items()}
            first = last
    if held:
        yield held


class Blocks:
    """The candidate blocks of a table ``(vec_id, label, q array<long>, anchor boolean)``, written as Parquet in the shared folder."""

    def __init__(self, rows: DataFrame, dims: int, largest: int):
        self.dims, self.kind = dims, "<i2" if largest < 2**15 else "<i8"
        kind, sample = self.kind, rows.orderBy(F.xxhash64("vec_id", "q")).limit(SAMPLE).select("q").collect()
        fit = np.zeros((len(sample), dims))
        for i, r in enumerate(sample):
            fit[i, :len(r.q)] = r.q
        mean = fit.mean(axis=0)
        axes = np.linalg.svd(fit - mean, full_matrices=False)[2][:AXES].T
        edges = np.quantile((fit - mean) @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)

        def keyed(batches):
            for batch in batches:
                q = _matrix(batch.column(2), dims)
                at = (q - mean) @ axes
                cells = np.stack([np.searchsorted(edges[:, i], at[:, i]) for i in range(at.shape[1])], axis=1)
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), binary(hilbert(cells, BITS)), binary(q.astype(kind))], ["vec_id", "label", "anchor", "key", "vec"])

        def packed(batches):
            for run in _runs(batches, 1, BLOCK):
                q = _stacked(run["vec"], kind)
                yield _rows({"label": pa.int64(), "ids": pa.binary(), "anchors": pa.binary(), "vecs": pa.binary(), "low": pa.binary(), "high": pa.binary()},
                            [(run["label"][0], np.array(run["vec_id"], "<i8").tobytes(), np.array(run["anchor"], bool).tobytes(), q.tobytes(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes())])

        order = ("label", "key", "vec_id")
        keys = rows.select("vec_id", "label", "q", "anchor").mapInArrow(released(keyed), "vec_id long, label long, anchor boolean, key binary, vec binary")
        blocks = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(packed), "label long, ids binary, anchors binary, vecs binary, low binary, high binary")
        self.table = save(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")

    def anchors(self, k: int) -> DataFrame:
        """``(anchor, anchor_id, label, vec, low, high)``: each anchor with its window for the best ``k`` of its label: from the k-th best of its block on."""
        kind, dims = self.kind, self.dims

        def run(batches):
            for batch in batches:
                for label, ids, flags, vecs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    ids, q, at = np.frombuffer(ids, "<i8"), np.frombuffer(vecs, kind).reshape(-1, dims), np.flatnonzero(np.frombuffer(flags, bool))
                    score = np.where(ids[at][:, None] == ids, LEAST, _times(q[at], q))
                    least = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(at), LEAST)
                    yield _rows({"anchor_id": pa.int64(), "label": pa.int64(), "vec": pa.binary(), "low": pa.int64(), "high": pa.int64()}, [(int(ids[i]), label, q[i].tobytes(), int(x), MOST) for i, x in zip(at, least)])

        found = self.table.select("label", "ids", "anchors", "vecs").where(F.locate("\x01", F.decode("anchors", "ISO-8859-1")) > 0)
        return found.mapInArrow(released(run), "anchor_id long, label long, vec binary, low long, high long").withColumn("anchor", F.monotonically_increasing_id())

    def best(self, windows: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``(window, rank, vec_id, score)``: the first ``k`` rows of each of ``windows (window, anchor, anchor_id, label, vec, low, high)`` among those of the same, or of other labels."""
        packs = save(self._packs(windows), "windows")
        reads = self._reads(packs, same_label)
        found = reads.join(self.table.select("block", "ids", "vecs"), "block").join(packs, "pack").sortWithinPartitions("pack", F.desc("most")).select("pack", "need", "ids", "vecs", *PACKED)
        own = found.mapInArrow(released(_search(k, self.kind, self.dims)), "window long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
        return own.withColumn("rank", rank).where(F.col("rank") <= k).select("window", "rank", "vec_id", "score")

    def _packs(self, windows: DataFrame) -> DataFrame:
        """Windows of one label, many to a row: the distinct anchors' vectors, and of each window its anchor's place and its borders."""
        kind = self.kind

        def run(batches):
            for x in _runs(batches, 0, PACK):
                _, first, place = np.unique(x["anchor"], return_index=True, return_inverse=True)
                number = lambda name: np.array(x[name], "<i8").tobytes()
                yield _rows({"label": pa.int64(), "vectors": pa.binary(), "place": pa.binary(), **dict.fromkeys(("window", "anchor_id", "from", "to"), pa.binary())},
                            [(x["label"][0], b"".join(x["vec"][i] for i in first), place.astype("<i8").tobytes(), number("window"), number("anchor_id"), number("low"), number("high"))])

        parts = 1 + windows.count() // (8 * PACK)
        dealt = windows.select("label", "anchor", "window", "anchor_id", "vec", "low", "high").repartitionByRange(parts, "label", "anchor", "window").sortWithinPartitions("label", "anchor", "window")
        return dealt.mapInArrow(released(run), "label long, " + ", ".join(f"`{c}` binary" for c in PACKED)).withColumn("pack", F.monotonically_increasing_id())

    def _reads(self, packs: DataFrame, same_label: bool) -> DataFrame:
        """``(pack, block, need, most)``: the blocks that a window of a pack must read, which windows, and the largest bound."""
        kind, dims = self.kind, self.dims

        def zones(batches):
            for x in _runs(batches, 0, PACK):
                yield _rows({"label": pa.int64(), "blocks": pa.binary(), "low": pa.binary(), "high": pa.binary()}, [(x["label"][0], np.array(x["block"], "<i8").tobytes(), b"".join(x["low"]), b"".join(x["high"]))])

        def choose(batches):
            for batch in batches:
                for pack, blocks, low, high, vectors, place, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                    low, high, vectors = (np.frombuffer(x, kind).reshape(-1, dims) for x in (low, high, vectors))
                    place, begin, end, blocks = (np.frombuffer(x, "<i8") for x in (place, begin, end, blocks))
                    least, most = (x[place] for x in _bounds(vectors, low, high))
                    need = (most >= begin[:, None]) & (least <= end[:, None])
                    yield _rows({"pack": pa.int64(), "block": pa.int64(), "need": pa.binary(), "most": pa.int64()},
                                [(pack, int(blocks[i]), np.packbits(need[:, i]).tobytes(), int(most[need[:, i], i].max())) for i in np.flatnonzero(need.any(axis=0))])

        side = F.array(*map(F.lit, range(GRID)))
        deal = lambda *names: F.pmod(F.xxhash64(*names), F.lit(GRID))
        pages = self.table.select("label", "block", "low", "high").mapInArrow(released(zones), "label long, blocks binary, low binary, high binary")
        pages = pages.withColumns({"_row": F.explode(side), "_column": deal("blocks").cast("int")})
        asked = packs.select("pack", "vectors", "place", "from", "to", F.col("label").alias("_label"), deal("pack").cast("int").alias("_row"), F.explode(side).alias("_column"))
        alike: Column = F.col("label") == F.col("_label")
        met = asked.join(pages, ["_row", "_column"]).where(alike if same_label else ~alike)
        return met.select("pack", "blocks", "low", "high", "vectors", "place", "from", "to").mapInArrow(released(choose), "pack long, block long, need binary, most long")


#: What a pack holds beside its label.
PACKED = ("vectors", "place", "window", "anchor_id", "from", "to")


def _search(k: int, kind: str, dims: int):
    def run(batches):
        names = {"window": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        pack, top, window, least = None, None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in (window[top[0]], top[2], top[1])], list(names))
        for batch in batches:
            for of, need, ids, vecs, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if of != pack:
                    if pack is not None:
                        yield out()
                    vectors = np.frombuffer(rest[0], kind).reshape(-1, dims)
                    place, window, own, begin, end = (np.frombuffer(x, "<i8") for x in rest[1:])
                    pack, top, least = of, [np.zeros(0, np.int64)] * 3, begin.copy()
                needed = np.flatnonzero(np.unpackbits(np.frombuffer(need, np.uint8), count=len(place)))
                ids, at = np.frombuffer(ids, "<i8"), place[needed]
                used, row = np.unique(at, return_inverse=True)
                score = _times(vectors[used], np.frombuffer(vecs, kind).reshape(-1, dims))[row]
                w, j = np.nonzero((score >= least[needed][:, None]) & (score <= end[needed][:, None]) & (ids != own[needed][:, None]))
                if len(w):
                    top = _first(k, np.r_[top[0], needed[w]], np.r_[top[1], score[w, j]], np.r_[top[2], ids[j]])
                    full = np.flatnonzero(np.bincount(top[0], minlength=len(place)) == k)
                    least[full] = np.maximum(least[full], top[1][np.searchsorted(top[0], full, side="right") - 1])
        if pack is not None:
            yield out()

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``(vec_id, label, embedding)``.

    A component ``x`` counts as ``floor(scale * x)``. For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels whose score is at least ``low`` and at most ``high`` per cent of the positive's. Higher scores come first, then smaller ids.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(finite)
    own = own.select("vec_id", "label", "anchor", F.transform("e", lambda x: F.floor(x * scale)).alias("q"))
    dims, largest = own.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    if dims is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = Blocks(own, max(1, dims), int(largest or 0))
    anchors = save(blocks.anchors(positives), "anchors")
    near = blocks.best(anchors.withColumn("window", F.col("anchor")), positives, same_label=True)
    whole = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")  # noqa: E731  rounds down
    near = near.join(anchors.drop("low", "high"), near["window"] == anchors["anchor"]).select(
        "anchor", "anchor_id", "label", "vec", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (-whole(f"(-{low} * score)")).alias("low"), whole(f"({high} * score)").alias("high"))
    windows = save(near.where("low <= high").withColumn("window", F.monotonically_increasing_id()), "negative-windows")
    found = blocks.best(windows, negatives, same_label=False)
    return found.join(windows.select("window", "anchor_id", "positive_id", "positive_score"), "window").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
