"""Ranked lexical search for many items at once, by common subexpressions of their scores.

An item's score of a document is a sum over the item's terms, so items that share terms share parts of the sum. Terms that stand together in
several items are mined into nodes, nodes into larger nodes; each node is an accumulator over the documents of a batch, worked out once, and
items are sums of nodes. What no two items share is added by each item alone.

Documents are read twice and never shuffled: once for the counts of the items' terms, which are written, and once over those for scores. Only the
best rows of each task meet. Items come in blocks of bounded size, one pass each.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased. Null and empty texts have no terms: such
documents do not count and such items return nothing. Rows that repeat an id are documents, or items, of their own; rows without an id come last among equal scores.
Empty tables give no rows, and no other column is read.
"""
from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import released, save, slices

#: Terms with repeats in a block of items, about: what is held of the items at one time. A longer item is a block alone.
BLOCK_TERMS = 50_000
#: Accumulator cells of a batch of documents (32 MB of longs).
CELLS = 4_000_000
#: Share of a document's length in its weight, and the largest part of one term (fixed values of the score).
B, SCALE = 75, 1_000_000_000

#: A-Z lower, other ASCII but digits and a-z to blanks; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in their order, as UTF-8."""
    return ((text.encode() if isinstance(text, str) else text) or b"").translate(_FOLD).split() if text else []


class Plan:
    """The sharing graph of a block of items.

    Leaves are pairs of a term and its repeats within an item. ``levels`` are arrays ``(node, left, right)``, each over nodes of lower levels only; ``children`` of
    item ``i`` are ``parts[starts[i]:starts[i + 1]]``. Items without terms are left out; ``items`` are the positions of the others.
    """

    def __init__(self, texts: list[str | None]):
        counts = {i: c for i, t in enumerate(texts) if (c := Counter(terms(t)))}
        spread = Counter(t for c in counts.values() for t in c.items())
        self.leaves = sorted(spread, key=lambda leaf: (-spread[leaf], leaf))
        number = {leaf: k for k, leaf in enumerate(self.leaves)}
        self.vocabulary = sorted({t for t, _ in self.leaves})
        # most shared first, so that shared sets stand side by side in all their items
        runs = [sorted(number[x] for x in c.items()) for c in counts.values()]
        self.size, self.levels = len(self.leaves), []
        while True:
            found = Counter(p for run in runs for p in set(pairwise(run)))
            nodes: dict[tuple[int, int], int] = {}
            runs = [self._merged(run, found, nodes) for run in runs]
            if not nodes:
                break
            self.levels.append(np.array([(n, a, b) for (a, b), n in nodes.items()], np.int64).T)
        self.items, self.parts = list(counts), np.array([x for run in runs for x in run], np.int64)
        self.starts = np.cumsum([0, *map(len, runs)])[:-1]

    def _merged(self, run: list[int], found: Counter, nodes: dict) -> list[int]:
        """The run with neighbours joined that stand together in another item too, where neither neighbour has a more frequent partner."""
        out, at = [], 0
        while at < len(run):
            pair = (run[at], run[at + 1]) if at + 1 < len(run) else None
            following = (run[at + 1], run[at + 2]) if at + 2 < len(run) else None
            if pair and found[pair] > 1 and not (following and found[following] > found[pair]):
                if pair not in nodes:
                    nodes[pair], self.size = self.size, self.size + 1
                out.append(nodes[pair])
                at += 2
            else:
                out.append(run[at])
                at += 1
        return out

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Scores of all items (rows) from the parts of the vocabulary's terms in each document (columns)."""
        acc = np.empty((self.size, parts.shape[1]), np.int64)
        at = {t: k for k, t in enumerate(self.vocabulary)}
        acc[:len(self.leaves)] = parts[[at[t] for t, _ in self.leaves]] * np.array([n for _, n in self.leaves], np.int64)[:, None]
        for node, left, right in self.levels:
            acc[node] = acc[left] + acc[right]
        return np.add.reduceat(acc[self.parts], self.starts, axis=0)


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, at, tf)``: terms of each document with at least one, and the places in the vocabulary that it holds, with their counts."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches):
        place = known.value
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, rows = part.column(0), part.column(1), []
                for k in range(len(texts)):
                    words = terms(texts[k].as_py())
                    if words:
                        held = {place[w]: n for w, n in Counter(words).items() if w in place}
                        rows.append((k, len(words), [*held], [*held.values()]))
                if rows:
                    taken, n, at, tf = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(taken, pa.int32())), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "at", "tf"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(released(run), "doc_id long, n long, at array<int>, tf array<long>")


def _best(counted: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the first ``k`` documents of each item among those of each task."""
    shared = counted.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches):
        plan, w = shared.value
        step = max(1, CELLS // (plan.size + len(plan.vocabulary) + len(plan.parts)))
        top = pd.DataFrame({"item": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        least = np.zeros(len(plan.items), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                length = np.diff(part.column(2).offsets.to_numpy())
                doc, at = np.repeat(np.arange(part.num_rows), length), part.column(2).flatten().to_numpy()
                tf, n = part.column(3).flatten().to_numpy(), part.column(1).to_numpy()
                m = 100 - B + (B * n * n_docs) // n_terms
                parts = np.zeros((len(plan.vocabulary), part.num_rows), np.int64)
                parts[at, doc] = w[at] * ((SCALE * tf) // (1000 * tf + 8 * m[doc]))
                score = plan.scores(parts)
                item, doc = np.nonzero((score > 0) & (score >= least[:, None]))
                if len(item):
                    ids = pd.Series(part.column(0).to_pandas(integer_object_nulls=True), dtype="Int64")
                    new = pd.DataFrame({"item": item, "doc_id": ids.take(doc).to_numpy(), "score": score[item, doc]}).astype({"doc_id": "Int64"})
                    top = pd.concat([top, new]).sort_values(["item", "score", "doc_id"], ascending=[True, False, True]).groupby("item").head(k)
                    full = top.groupby("item")["score"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    least[full.index] = full["min"]
        top["item"] = np.array(plan.items, np.int64)[top["item"]]
        yield pa.RecordBatch.from_pandas(top, pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]), preserve_index=False)

    return counted.mapInArrow(released(run), "item long, doc_id long, score long")


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """The first ``k`` documents of each of a block's items."""
    spark, plan = docs.sparkSession, Plan([r.text for r in items])
    if not plan.items:
        return None
    counted = save(count_terms(docs, plan.vocabulary), "terms")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(plan.vocabulary), np.int64)
    for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # at most a row for each of the block's terms
        weights[r.at] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    found = _best(counted, plan, weights, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item long, item_id long")
    return save(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item its ``k`` documents of highest score above 0, equal scores by id."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = own.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) / 4)).first()[0] or 0
    blocks = 1 + int(total // BLOCK_TERMS)
    own = own.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = [df for b in range(blocks) if (rows := own.where(F.col("_block") == b).collect()) and (df := _block(docs, rows, k)) is not None]
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole
