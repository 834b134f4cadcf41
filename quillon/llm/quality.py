"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(score - threshold_k): one set of weights over hashed text features is shared by all grades, and the
thresholds are ordered. Both the expected grade and the probability of a grade in the upper tail follow.
"""
from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, given_back, released, set_aside, slices
from quillon.llm.labelled import sample

#: Hash buckets of words and of shapes; the last bucket of all counts words equal to the one before.
WORDS, SHAPES = 1 << 15, 1 << 10
REPEAT = WORDS + SHAPES
CACHE_CHUNKS, CACHE_CHARS = 400_000, 64
_CORE = re.compile(r"\w+")


def features(chunk: str) -> tuple[int, int]:
    """Hash buckets of a chunk's word and of its shape: case, and what surrounds the word."""
    core = _CORE.search(chunk)
    word = core[0] if core else ""
    case = "" if not word else "0" if word.isdigit() else "U" if word.isupper() and len(word) > 1 else "T" if word.istitle() else "l"
    shape = f"{chunk[:core.start()]}{case}{chunk[core.end():]}" if core else chunk
    h = xxhash.xxh3_64_intdigest
    return h(word.lower().encode()) % WORDS, WORDS + h(shape[:16].encode()) % SHAPES


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -50, 50)))


def _counted(text: str) -> tuple[dict[int, int], int]:
    chunks = text.split()
    counts: dict[int, int] = {}
    for c in chunks:
        for f in features(c):
            counts[f] = counts.get(f, 0) + 1
    if again := sum(map(operator.eq, chunks, chunks[1:])):
        counts[REPEAT] = again
    return counts, len(chunks)


@given_back
def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = 6000, where=None, steps: int = 200, rate: float = 0.3, decay: float = 1e-4) -> OrdinalModel:
    """Fits on at most ``max_rows`` labelled rows (the documented bound); their features are counted by Spark, and only those
    counts reach the driver. Without labelled rows, or with one grade only, every document gets that grade."""
    def count(batches):
        for batch in batches:
            ids, n = [], []
            for text in batch.column(0).to_pylist():
                c, total = _counted(text)
                ids.append(list(c))
                n.append([x / total for x in c.values()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["label", "ids", "shares"])

    rows = sample(docs, labels, column, max_rows, where).select("text", "label").mapInArrow(released(count), "label int, ids array<int>, shares array<float>").toArrow()
    grade = rows["label"].to_numpy()
    grades = sorted(set(grade.tolist())) or [0]
    weights = np.zeros(REPEAT + 1)
    if len(grades) < 2:
        return OrdinalModel(weights, np.zeros(0), grades)
    doc = np.repeat(np.arange(len(grade)), pc.list_value_length(rows["ids"].combine_chunks()).to_numpy())
    ids = rows["ids"].combine_chunks().flatten().to_numpy()
    share = rows["shares"].combine_chunks().flatten().to_numpy().astype(float) * SCALE
    above = grade[:, None] > np.array(grades[:-1])
    balance = np.where(above, 0.5 / above.mean(axis=0), 0.5 / (1 - above.mean(axis=0)))
    # thresholds as a first value and positive gaps, so that they stay ordered
    gaps = np.zeros(len(grades) - 1)
    m, v = np.zeros(len(weights) + len(gaps)), np.zeros(len(weights) + len(gaps))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.append(gaps[:1], np.exp(gaps[1:])))
        score = np.bincount(doc, weights=share * weights[ids], minlength=len(grade))
        error = (1 / (1 + np.exp(np.clip(theta - score[:, None], -50, 50))) - above) * balance / len(grade)
        d_theta = -error.sum(axis=0)
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(ids, weights=share * error.sum(axis=1)[doc], minlength=len(weights)) + decay * weights, tail * np.append(1.0, np.exp(gaps[1:]))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (1 - t / (steps + 1)) * m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        weights, gaps = weights - move[:len(weights)], gaps - move[len(weights):]
    return OrdinalModel(weights, np.cumsum(np.append(gaps[:1], np.exp(gaps[1:]))), grades)


#: Shares of a document are multiplied by this, so that weights stay moderate.
SCALE = 10.0


class Scorer:
    """Scores of whole texts; each worker remembers the sum of weights of a chunk."""

    def __init__(self, model: OrdinalModel):
        self.model, self.known, self.weights = model, {}, model.weights.tolist()

    def score(self, text: str) -> float:
        chunks = text.split()
        if not chunks:
            return 0.0
        found = list(map(self.known.get, chunks))
        if None in found:
            if len(self.known) > CACHE_CHUNKS:
                self.known.clear()
            for i, x in enumerate(found):
                if x is None:
                    a, b = features(chunks[i])
                    found[i] = self.weights[a] + self.weights[b]
                    if len(chunks[i]) <= CACHE_CHARS:
                        self.known[chunks[i]] = found[i]
        return SCALE * (sum(found) + self.weights[REPEAT] * sum(map(operator.eq, chunks, chunks[1:]))) / len(chunks)


def grade(docs: DataFrame, model: OrdinalModel, tail_from: int | None = None, cutoff: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of a grade of at least ``tail_from``; the highest by default)
    and ``keep`` (that probability is at least ``cutoff``).

    All columns pass through, those three names replaced. Texts of any length are counted whole. Null and empty texts have the score 0 and are graded by the
    thresholds alone. Repeated rows get equal results; an empty table gives an empty result. Per row, no shuffle.
    """
    new = ("expected_grade", "tail_probability", "keep")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    kept = docs.select(*columns)
    at = kept.columns.index("text")
    schema = "".join(f"`{c.replace('`', '``')}` {t}, " for c, t in kept.dtypes) + "expected_grade double, tail_probability double, keep boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = model.grades[-1] if tail_from is None else tail_from

    def run(batches):
        scorer = Scorer(shared.value)
        grades = np.array(scorer.model.grades, float)
        for batch in (p for b in batches for p in slices(b, at)):
            tails = scorer.model.tails(np.array([scorer.score(x.as_py() or "") for x in batch.column(at)]))
            expected = grades[0] + (tails * np.diff(grades)).sum(axis=1)
            which = int(np.searchsorted(grades, first))
            tail = np.ones(batch.num_rows) if which == 0 else tails[:, which - 1] if which < len(grades) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail), pa.array(tail >= cutoff)], [*batch.schema.names, *new])

    return kept.mapInArrow(released(run), schema)


def select(docs: DataFrame, labels: DataFrame, column: str = "quality", cutoff: float = 0.5) -> DataFrame:
    """Documents whose text belongs to the highest grade with at least ``cutoff``; columns unchanged, whatever their names."""
    own, back = set_aside(docs, ("expected_grade", "tail_probability", "keep"))
    kept = grade(own, fit(docs, labels, column), cutoff=cutoff).where("keep")
    return kept.select(*[F.col(f"`{c}`") for c in own.columns]).withColumnsRenamed(back)


def graded_documents(docs: DataFrame, labels: DataFrame, column: str = "quality", cutoff: float = 0.5) -> DataFrame:
    """``doc_id`` and grading of every document."""
    return grade(documents(docs), fit(docs, labels, column), cutoff=cutoff).drop("text")
