"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of its own vector (words known from training) and the mean vector of its hashed character
n-grams, so that altered and unknown words count by their spelling. Texts are cut into overlapping windows, every window is
scored, and the highest window decides. Scores are calibrated on the training rows.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents, give_back, given_back, released, set_aside, slices
from quillon.llm.labelled import sample

#: Words of a window and from one window to the next; sizes of word vectors and of each direction's state.
WINDOW, STRIDE = 24, 12
SIZE, STATE, ATTEND = 8, 8, 8
NGRAMS = 8192
#: Words whose inputs a worker remembers (about 300 bytes each).
CACHE_WORDS = 200_000
#: Bytes of text that are scored together, but for a longer one.
STEP_BYTES = 1_000_000
#: Windows of one numpy step, and words whose inputs are made in one. Both are filled up, so that results do not depend on neighbours.
STEP, WORDS_STEP = 2048, 4096
#: Windows of a text that one pass of training scores.
PASS_WINDOWS = 100
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(n: int) -> list[tuple[int, int]]:
    """Start and end of the windows that cover n words."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words' byte 3- and 4-grams, with begin and end marks, and the first n-gram of each word."""
    data = np.frombuffer(b"".join(b"\x02" + w.encode() + b"\x03\0\0\0" for w in words), np.uint8).astype(np.uint32)
    size = np.array([len(w.encode()) + 5 for w in words])
    start = np.cumsum(size) - size
    d = data[:-3], data[1:-2], data[2:-1], data[3:]
    three = (d[0] * np.uint32(2654435761) ^ d[1] * np.uint32(2246822519) ^ d[2] * np.uint32(3266489917))
    four = (three ^ d[3] * np.uint32(668265263)) * np.uint32(374761393) ^ np.uint32(0x5BD1E995)
    n3 = np.maximum(1, size - 5)  # marks included there are size - 3 bytes, so size - 5 trigrams
    at = np.repeat(start - (np.cumsum(n3) - n3), n3) + np.arange(n3.sum())
    h3, h4 = (three[at] >> 7) % (NGRAMS // 2), (four[at] >> 9) % (NGRAMS // 2) + NGRAMS // 2
    return np.stack([h3, h4], axis=1).ravel().astype(np.int64), 2 * n3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Parameters and the two passes. ``p`` maps names to arrays; word 0 is any unknown word."""

    def __init__(self, words: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.p = {"word": r(len(words) + 1, SIZE), "char": r(NGRAMS, SIZE), "att": r(2 * STATE, ATTEND), "pick": r(ATTEND), "out": r(2 * STATE), "bias": np.zeros(1, np.float32)}
        self.p["word"] *= 0  # what the spelling does not tell is learned
        self.p["char"] *= np.float32(0.3)
        for d in "fb":
            self.p |= {f"W{d}": r(2 * SIZE, 3 * STATE), f"U{d}": r(STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of distinct words, with the word numbers, n-grams and n-gram counts they come from."""
        ids = np.array([self.words.get(w, 0) for w in words])
        grams, n = _ngrams(words)
        first = np.cumsum(n) - n
        chars = np.add.reduceat(self.p["char"][grams], first, axis=0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1), ids, grams, n

    def projected(self, words: list[str]) -> np.ndarray:
        """What the gates get from each word. Words are filled up to whole steps: products of one shape do not depend on what stands beside."""
        out = np.empty((len(words), 6 * STATE), self.p["Wf"].dtype)
        for i in range(0, len(words), WORDS_STEP):
            x = self.inputs(words[i: i + WORDS_STEP])[0]
            part = np.zeros((WORDS_STEP, x.shape[1]), x.dtype)
            part[: len(x)] = x
            out[i: i + WORDS_STEP] = np.concatenate([part @ self.p["Wf"] + self.p["bf"], part @ self.p["Wb"] + self.p["bb"]], axis=1)[: len(x)]
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from projected inputs (windows, words, 6 x STATE); mask 1 for words."""
        n, w = mask.shape
        states, trace = np.empty((n, w, 2 * STATE), np.float32), {"f": [None] * w, "b": [None] * w}
        for d, off, order in (("f", 0, range(w)), ("b", STATE, range(w - 1, -1, -1))):
            h, u = np.zeros((n, STATE), np.float32), self.p[f"U{d}"]
            for t in order:
                g = gates[:, t, 3 * off: 3 * off + 3 * STATE]
                a = h @ u
                zr = _sigmoid(g[:, : 2 * STATE] + a[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(g[:, 2 * STATE:] + r * a[:, 2 * STATE:])
                m = mask[:, t, None]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    trace[d][t] = (h, z, r, c, a[:, 2 * STATE:], m)
                h = new
                states[:, t, off: off + STATE] = h
        q = np.tanh(states @ self.p["att"])
        e = np.exp(np.clip(q @ self.p["pick"], -30, 30)) * mask
        a = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, trace, q, a, pooled)) if keep else logit

    def backward(self, gates, mask, kept, error):
        """Gradients of the parameters and of the projected inputs, for d loss / d logit in ``error``."""
        states, trace, q, a, pooled = kept
        n, w = mask.shape
        g = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_pool = error[:, None] * self.p["out"]
        d_state = a[:, :, None] * d_pool[:, None, :]
        d_a = np.einsum("nh,nth->nt", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        g["pick"] = np.einsum("nt,ntk->k", d_e, q)
        d_q = d_e[:, :, None] * self.p["pick"] * (1 - q * q)
        g["att"] = np.einsum("nth,ntk->hk", states, d_q)
        d_state += d_q @ self.p["att"].T
        d_gates = np.zeros_like(gates)
        for d, off, order in (("f", 0, range(w - 1, -1, -1)), ("b", STATE, range(w))):
            u, du, back = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"]), np.zeros((n, STATE), np.float32)
            for t in order:
                h, z, r, c, ac, m = trace[d][t]
                dh = back + d_state[:, t, off: off + STATE]
                dn = dh * m
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                pre = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                d_gates[:, t, 3 * off: 3 * off + 3 * STATE] = pre
                du += h.T @ rec
                back = dh * (1 - m) + dn * z + rec @ u.T
            g[f"U{d}"] = du
        return g, d_gates


@given_back
def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_rows: int = 3000, steps: int = 1000, where=None, max_bytes: int = 24_000_000) -> BiGru:
    """Trains on at most ``max_rows`` labelled rows and ``max_bytes`` of text, half of each label where there are enough, of any length: rows come in the order of a hash of their ids, and the first
    that would go beyond the bound ends the sample. A text is held whole.

    A document's label belongs to its highest window: each pass scores windows, then learns from the highest of
    each document and one at random (the first pass: at random only). A pass scores all windows of a text, or where it has more than
    ``PASS_WINDOWS`` so many at random and the highest so far. There
    are about ``steps`` steps, more passes where there are few rows, from 8 to 60. Afterwards score and label of whole documents, by
    all windows, are calibrated by a logistic fit. Without rows of both labels, every score is the share of label 1.
    """
    def cut(batches):
        for batch in batches:
            rows = [(lab, " ".join(w)) for text, lab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (w := words_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["label", "words"])

    # windows over no more than max_rows rows
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.octet_length("text"), "text"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("rank", "label").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sample(docs, labels, column, max_rows, where).select("text", "label", rank.alias("rank")).withColumn("upto", upto).where(F.col("upto") <= max_bytes)
    got = chosen.select("text", "label").mapInArrow(released(cut), "label int, words string").toArrow()
    rows = sorted(zip(got["label"].to_pylist(), got["words"].to_pylist()))
    del got
    give_back()
    return train(np.array([r[0] for r in rows], np.float32), [r[1] for r in rows], steps)


def train(label: np.ndarray, texts: list[str], steps: int = 1000) -> BiGru:
    """The network for labelled texts, words with blanks between them, on one thread."""
    seen: dict[str, int] = {}
    for t in texts:
        for w in set(t.split()):
            seen[w] = seen.get(w, 0) + 1
    net = BiGru(sorted(w for w, n in seen.items() if n >= 3))
    if len(set(label.tolist())) < 2:
        net.p["out"][:] = 0
        share = float(np.clip(label.mean() if len(label) else 0.0, 0.01, 0.99))
        net.shift = float(np.log(share / (1 - share)))
        return net
    vocab = sorted(seen)
    number = {w: i for i, w in enumerate(vocab)}
    grids, sizes = [], []
    for t in texts:
        x = np.array([number[w] for w in t.split()], np.int32)
        spans = windows(len(x))
        g = np.zeros((len(spans), WINDOW), np.int32)
        for k, (a, b) in enumerate(spans):
            g[k, : b - a] = x[a:b]
        grids.append(g)
        sizes.append([b - a for a, b in spans])
    count = np.array([len(g) for g in grids])
    first = np.cumsum(count) - count
    total, grid = int(count.sum()), np.concatenate(grids)
    del grids
    mask = (np.arange(WINDOW) < np.concatenate(sizes)[:, None]).astype(np.float32)
    rng = np.random.default_rng(3)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, top = 0, first.copy()

    def highest(places: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and logit of the highest of each text's ``size`` windows at ``places``."""
        table = net.projected(vocab)
        z = np.concatenate([net.forward(table[grid[p]], mask[p]) for p in np.array_split(places, -(-len(places) // STEP))])
        at = np.cumsum(size) - size
        best = np.array([a + int(z[a: a + n].argmax()) for a, n in zip(at, size)])
        return places[best], z[best]

    def some_windows() -> tuple[np.ndarray, np.ndarray]:
        rows = [np.arange(a, a + n) if n <= PASS_WINDOWS else np.append(a + rng.choice(n, PASS_WINDOWS, replace=False), b) for a, n, b in zip(first, count, top)]
        return np.concatenate(rows), np.array(list(map(len, rows)))

    batch = 64 if len(texts) >= 1500 else 24
    epochs = min(60, max(8, -(-steps * batch // (2 * len(texts)))))
    for epoch in range(epochs):
        some = first + rng.integers(0, count)
        if epoch:
            top, _ = highest(*some_windows())
            picks, goal = np.concatenate([top, some[label == 0]]), np.concatenate([label, label[label == 0]])
        else:
            picks, goal = some, label
        weight = np.where(goal > 0, 0.5 / max(goal.mean(), 1e-6), 0.5 / max(1 - goal.mean(), 1e-6)).astype(np.float32)
        shuffled = rng.permutation(len(picks))
        for part in np.array_split(shuffled, max(1, len(picks) // batch)):
            k = picks[part]
            used, inverse = np.unique(grid[k], return_inverse=True)
            x, ids, grams, n = net.inputs([vocab[i] for i in used])
            known = (rng.random(len(used)) < 0.5)[:, None].astype(np.float32)  # half of the words count by their spelling alone
            x[:, :SIZE] *= known
            table = np.concatenate([x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"]], axis=1)
            inverse = inverse.reshape(len(k), WINDOW)
            gates = table[inverse]
            logit, kept = net.forward(gates, mask[k], keep=True)
            error = ((_sigmoid(logit) - goal[part]) * weight[part] / len(part)).astype(np.float32)
            g, d_gates = net.backward(gates, mask[k], kept, error)
            d_table = np.zeros_like(table)
            np.add.at(d_table, inverse.ravel(), d_gates.reshape(-1, 6 * STATE))
            df, db = d_table[:, : 3 * STATE], d_table[:, 3 * STATE:]
            g |= {"Wf": x.T @ df, "bf": df.sum(axis=0), "Wb": x.T @ db, "bb": db.sum(axis=0)}
            dx = df @ net.p["Wf"].T + db @ net.p["Wb"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], ids, dx[:, :SIZE] * known)
            g["word"][0] = 0
            np.add.at(g["char"], grams, np.repeat(dx[:, SIZE:] / n[:, None], n, axis=0).astype(np.float32))
            t += 1
            for name, value in g.items():
                m[name] = 0.9 * m[name] + 0.1 * value
                v2[name] = 0.995 * v2[name] + 0.005 * value * value
                net.p[name] -= (0.01 * (1 - 0.7 * epoch / epochs) * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v2[name] / (1 - 0.995 ** t)) + 1e-7)).astype(np.float32)
    _, z = highest(np.arange(total), count)
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration, lightly held to a slope of 1
        e = _sigmoid(a * z + b) - label
        a, b = a - 0.05 * (float((e * z).mean()) + 0.02 * (a - 1)), b - 0.3 * float(e.mean())
    net.scale, net.shift = a, b
    return net


class Scorer:
    def __init__(self, net: BiGru):
        self.net, self.known = net, {}
        self.table = np.zeros((CACHE_WORDS, 6 * STATE), np.float32)

    def _numbers(self, words: list[list[str]]) -> tuple[list[list[int]], np.ndarray]:
        """Rows of the returned table for each word."""
        found = [list(map(self.known.get, w)) for w in words]
        new = list({w for ws, fs in zip(words, found) if None in fs for w, f in zip(ws, fs) if f is None})
        if not new:
            return found, self.table
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            every = list({w for ws in words for w in ws})
            if len(every) > CACHE_WORDS:
                own = {w: i for i, w in enumerate(every)}
                return [[own[w] for w in ws] for ws in words], self.net.projected(every)
            new = every
        at = len(self.known)
        self.table[at: at + len(new)] = self.net.projected(new)
        self.known.update(zip(new, range(at, at + len(new))))
        get = self.known.__getitem__
        return [list(map(get, ws)) if self.known and (None in fs or at == 0) else fs for ws, fs in zip(words, found)], self.table

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated score of each text: its highest window's."""
        words = [words_of(t) for t in texts]
        numbers, table = self._numbers(words)
        flat = np.fromiter((x for r in numbers for x in r), np.int64, sum(map(len, numbers)))
        sizes = np.array([len(r) for r in numbers], np.int64)
        at = np.cumsum(sizes) - sizes
        count = np.maximum(1, -(-np.maximum(0, sizes - WINDOW) // STRIDE) + 1)
        first = np.cumsum(count) - count
        step = np.arange(count.sum()) - np.repeat(first, count)
        begin, left = np.repeat(at, count) + STRIDE * step, np.minimum(WINDOW, np.repeat(sizes, count) - STRIDE * step)
        best = np.empty(len(begin), np.float32)
        cols = np.arange(WINDOW)
        for i in range(0, len(begin), STEP):
            fill = STEP - len(begin[i: i + STEP])  # each step has the same shape, so that a window's logit does not depend on others
            b, n = np.append(begin[i: i + STEP], np.zeros(fill, np.int64))[:, None], np.append(left[i: i + STEP], np.zeros(fill, np.int64))[:, None]
            mask = (cols < n).astype(np.float32)
            grid = flat[np.minimum(b + cols, len(flat) - 1)] if len(flat) else np.zeros(mask.shape, np.int64)
            grid[mask == 0] = 0
            best[i: i + STEP] = self.net.forward(table[grid], mask)[: STEP - fill]
        z = np.maximum.reduceat(best, first) if len(first) else np.zeros(0)
        return np.round(_sigmoid(self.net.scale * z.astype(float) + self.net.shift), 6)


def score(docs: DataFrame, net: BiGru, cutoff: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least ``cutoff``).

    All columns pass through, those two names replaced. Null, empty and wordless texts are scored as a window without
    words. Texts of any length are scored by all their windows. Equal texts get equal scores, whatever stands beside them; an empty table
    gives an empty result. Per row, no shuffle.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*columns)
    at = kept.columns.index("text")
    schema = "".join(f"`{c.replace('`', '``')}` {t}, " for c, t in kept.dtypes) + "score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value)
        for part in (p for b in batches for p in slices(b, at, STEP_BYTES)):
            s = scorer.score([x or "" for x in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= cutoff).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(released(run), schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by a network that learned from rows with crc32(doc_id) mod 4 other than 2 only."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = score(documents(docs), fit(docs, labels, where=~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def select(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Documents that are not predicted toxic; columns unchanged, whatever their names. Learns from the same rows as ``scored_documents``."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    own, back = set_aside(docs, ("score", "predicted"))
    kept = score(own, fit(docs, labels, where=~held), cutoff).where("predicted = 0")
    return kept.select(*[F.col(f"`{c}`") for c in own.columns]).withColumnsRenamed(back)
