"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct word shingles. Three stages, all without loss:

1. Shingles that occur again and again are counted over the whole corpus. All shingles are put into one order, the rarest first.
2. Routing. Of equal sets one is routed. Of two sets of similarity t, one of the first ``n - ceil(t n) + 1`` shingles of the larger in that order, its keys, is among the first
   ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller, those by which it is found. Where few documents have a key, all their pairs are counted over the keys, and those with too few keys in
   common for the threshold are dropped. Where many have it, documents meet only those of allowed sizes that are found by it. So texts of a template, which have their own words as first
   keys, do not meet unless those are so few that they may link. What is left is joined into blocks: each pair that may link lies in one.
3. Signature trees find the links. A block's different sets become a tree whose nodes hold the OR of their members' token bitmaps and a
   range of sizes. Two trees (or a tree and itself) are traversed together: a pair of nodes whose greatest possible overlap
   cannot reach the threshold is dropped, as is one whose members are already connected. Surviving pairs are compared exactly.

Blocks above a size are cut into chunks. Every chunk's tree also holds the block's first document, which connects large
groups of near copies; the documents that are still apart from the block's main component are then compared with all chunks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_IDS, connected_components, fresh, only_ids, released, save, slices, small

#: Words whose hashes a worker remembers; keys that are combined, and shingles that are counted, before they leave a task.
CACHE_WORDS, COMBINE_KEYS, COUNT_HASHES = 200_000, 700_000, 2_000_000
#: Rows of a batch that goes from a task's Python to Spark.
SKETCH_ROWS = 50_000
#: Documents of a key in one task from which on those of a size class are joined there; documents of a key in all up to which their pairs are counted. Above that, keys bring together
#: what they have in common by chance, which at millions of documents connects most long ones.
MANY, COUNTED = 32, 128
#: Shingles that are ordered by their frequency at most, and the least count that makes one frequent.
FREQUENT, LEAST_COUNT = 1_000_000, 2
#: A chunk's documents and hashes of shingles at most (a single larger set is a chunk's own size).
CHUNK_DOCS, CHUNK_HASHES = 2000, 4_000_000
#: Bitmap words of 64 bits; members of a leaf and children of a node.
BITMAP, FAN = 64, 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's shingles: k words each, or all words where there are fewer."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(found, np.uint64)
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mixed(out * _MIX[0] + h[j: len(h) - k + 1 + j])
        return np.unique(out)


# ---------------------------------------------------------------- routing

class Frequent:
    """Classes of frequent shingles: the binary logarithm of their count; 0 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.classes = np.append(np.log2(np.maximum(counts[order], 2)).astype(np.int8), np.int8(0))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def classes_of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int8)
        maybe = np.flatnonzero(self.maybe[s >> np.uint64(44)])
        if len(maybe):
            at = np.searchsorted(self.hashes, s[maybe])
            same = self.hashes[np.minimum(at, len(self.hashes) - 1)] == s[maybe]
            out[maybe[same]] = self.classes[at[same]]
        return out


def found_by(n, num: int, den: int):
    """Of how many of its first keys a set of size n shares at least one with each larger set, or one of its size, that links with it."""
    return n - -(-2 * num * n // (num + den)) + 1


def size_class(n, num: int, den: int):
    """Sets that may link have sizes of one class or of neighbours."""
    return np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(np.int64) if num < den else np.asarray(n, np.int64)


def prefix_keys(s: np.ndarray, frequent: Frequent, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the common order (class, hash): any two sets of similarity num/den have one in common.

    The larger of two such sets shares at least ``ceil(num n / den)`` of its n shingles with the other, and so does the smaller one.
    """
    first = len(s) - -(-num * len(s) // den) + 1
    kind = frequent.classes_of(s)
    return s[np.argsort(kind, kind="stable")[:first]] if kind.any() else s[:first]


def _counts(k: int):
    """``(g, c)``: hashes of shingles that several different sets of a stretch of a task have, and how many."""
    def run(batches):
        shingle = Shingler(k)
        held, total, seen = [], 0, set()

        def counted():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            g, c = g[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle(text.as_py() or "")
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    total += len(s)
                if total > COUNT_HASHES:
                    yield counted()
                    held, total, seen = [], 0, set()
        if held:
            yield counted()

    return run, "g long, c long"


def frequent_shingles(texts: DataFrame, k: int) -> Frequent:
    """The most frequent shingles of all texts, at most ``FREQUENT``: the bound of what reaches the driver and the tasks (16 MB).

    Counts are summed over all stretches of all tasks in which a shingle repeats. They decide about the order of keys only: any
    order gives the same links.
    """
    run, schema = _counts(k)
    counts = save(texts.select("text").mapInArrow(released(run), schema).groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_COUNT), "frequent")
    kinds = {r.kind: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 1 + max(kinds, default=0)
    for kind in sorted(kinds, reverse=True):  # as many classes from the top as the bound allows
        total += kinds[kind]
        if total > FREQUENT:
            break
        least = kind
    rows = counts.where(F.floor(F.log2("c")) >= least).toArrow()
    return Frequent(rows["g"].to_numpy().view(np.uint64), rows["c"].to_numpy())


#: Kinds of rows of the second pass.
KEY, HOT, MET, EQUAL, SIZE = range(5)


def _sketch(k: int, num: int, den: int, frequent):
    """Rows ``(kind, a, b, n, other, found)``. KEY (key, id, set size, keys of this id that many have) and HOT (key, id, set size), the latter for a key that more than ``MANY`` documents of a
    task have, ``found`` if the key is one by which the id is found; of those of one key and size class that has such a row, only the first has one, and MET (id, id) joins the others to it. EQUAL
    (id, id) for equal sets within a task, of which only the first gets keys; SIZE (id, set size), with a digest (``d``, ``e``) if the set gets keys."""
    names = ["kind", "a", "b", "n", "other", "found", "d", "e"]

    def run(batches):
        shingle, order = Shingler(k), frequent.value
        keys, owners, sizes, total = [], [], [], 0
        seen: dict[bytes, int] = {}

        def batches_of(kind, a, b, n=None, other=None, found=None, digest=None):
            none = np.zeros(len(a), np.int32)
            digest = digest or [pa.nulls(len(a), pa.int64())] * 2
            n, other, found = (none if n is None else n), (none if other is None else other), (none > 0 if found is None else found)
            for i in range(0, max(1, len(a)), SKETCH_ROWS):  # in small batches, which need little memory on both sides
                x = slice(i, i + SKETCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[x]), kind, np.int8)), pa.array(a[x], pa.int64()), pa.array(b[x], pa.int64()), pa.array(n[x], pa.int32()), pa.array(other[x], pa.int32()), pa.array(found[x], pa.bool_()), *(c[x] for c in digest)], names)

        def combined():
            count = np.fromiter(map(len, keys), np.int64, len(keys))
            key, owner, place = np.concatenate(keys), np.repeat(np.arange(len(keys)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            size, ids = np.array(sizes, np.int32), np.array(owners)
            found = place < found_by(size.astype(np.int64), num, den)[owner]
            at = np.lexsort((owner, ~found, size_class(size, num, den)[owner], key))
            key, owner, found = key[at], owner[at], found[at]
            of_key = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            many = np.bincount(of_key)[of_key] > MANY
            hot = np.bincount(owner[many], minlength=len(ids)).astype(np.int32)
            yield from batches_of(KEY, key[~many].view(np.int64), ids[owner[~many]], size[owner[~many]], hot[owner[~many]], found[~many])
            key, owner, found = key[many], owner[many], found[many]
            kind = size_class(size, num, den)[owner]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))[:len(key)])
            head = np.repeat(first, np.diff(np.append(first, len(key))))
            lone = ~found[head] | (head == np.arange(len(key)))  # no row of the class is found by the key, or this is the first
            yield from batches_of(HOT, key[lone].view(np.int64), ids[owner[lone]], size[owner[lone]], None, found[lone])
            pairs = np.unique(np.stack([owner[head[~lone]], owner[~lone]], axis=1), axis=0)
            yield from batches_of(MET, ids[pairs[:, 0]], ids[pairs[:, 1]])

        for batch in batches:
            ids, every, same, digests = batch.column(0).to_pylist(), [], [], []
            for doc, text in zip(ids, batch.column(1)):
                s = shingle(text.as_py() or "")
                every.append(len(s))
                digests.append(None)
                if doc is None or not len(s):
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if (other := seen.setdefault(digest, doc)) != doc:
                    same.append((other, doc))
                    continue
                digests[-1] = digest
                keys.append(prefix_keys(s, order, num, den))
                owners.append(doc)
                sizes.append(len(s))
                total += len(keys[-1])
                if total > COMBINE_KEYS:
                    yield from combined()
                    keys, owners, sizes, total, seen = [], [], [], 0, {}
            yield from batches_of(SIZE, ids, every, digest=[pa.array([x and int.from_bytes(x[y], "little", signed=True) for x in digests], pa.int64()) for y in (slice(8), slice(8, 16))])
            yield from batches_of(EQUAL, [x for x, _ in same], [x for _, x in same])
        if keys:
            yield from combined()

    return run, "kind byte, a long, b long, n int, other int, found boolean, d long, e long"


def _equal(sketch: DataFrame) -> DataFrame:
    """``(a, b)``: of equal sets of several tasks, the smallest id with each other one. Ids with several sets are left out, since their rows of keys do not tell of which set they are."""
    sets = sketch.where((F.col("kind") == SIZE) & F.col("d").isNotNull()).groupBy("a").agg(F.first("d").alias("d"), F.first("e").alias("e"), F.count(F.lit(1)).alias("n"))
    sets = save(sets.where("n = 1").select("a", "d", "e"), "sets")
    several = sets.groupBy("d", "e").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "e", "least")
    return save(sets.join(small(save(several, "several")), ["d", "e"]).where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b")), "equal")


def _met(sketch: DataFrame, equal: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` that bring together all that may link: at a frequent key, the first document of those found by it in a size class with the
    others of this class and the next; and pairs of rare keys that may have enough keys in common.

    Of two sets with c common keys, the one whose keys end first in the common order has ``ceil(t n) - 1`` shingles behind them. So the overlap is at
    most c and the larger of these two numbers, and it has to be ``t / (1 + t)`` of the sum of the sizes. Keys that many have are not compared, and all count as common.

    Of ``equal`` sets, the first has these keys alone. HOT rows stay, as they stand for other sets of their task.
    """
    keys = sketch.where(F.col("kind").isin(KEY, HOT)).select("kind", "a", "b", "n", "other", "found")
    copies = equal.select(F.col("b").alias("copy"))
    side = small(copies, BROADCAST_IDS)
    keys = keys.join(side, (F.col("b") == F.col("copy")) & (F.col("kind") == KEY), "left_anti")
    keys = save(keys, "keys") if side is copies else keys  # shuffled once
    many = small(save(keys.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.max("kind").alias("k")).where((F.col("c") > COUNTED) | (F.col("k") == HOT)).select("a"), "many"))
    hot = save(keys.join(many, "a", "left_semi"), "hot")
    base = F.floor(F.log("n") / float(np.log(den / num)) + 1e-9) if num < den else F.col("n").cast("long")
    heads = hot.where("found").groupBy("a", base.alias("class")).agg(F.min("b").alias("head"))
    meets = hot.select("a", "b", F.explode(F.array(base, base - 1)).alias("class")).join(small(save(heads, "heads")), ["a", "class"])
    frequent = meets.where("head <> b").select(F.col("head").alias("a"), "b")
    lost = hot.where(F.col("kind") == KEY).groupBy(F.col("b").alias("_b")).agg(F.count(F.lit(1)).cast("int").alias("more"))
    rare = keys.where(F.col("kind") == KEY).join(many, "a", "left_anti").join(small(save(lost, "lost")), F.col("b") == F.col("_b"), "left")
    lists = rare.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "n", (F.col("other") + F.coalesce("more", F.lit(0))).alias("h")))).alias("l")).where("size(l) > 1")
    may = f"l[i - 1].b < y.b and least(l[i - 1].n, y.n) * {den}L >= greatest(l[i - 1].n, y.n) * {num}L"
    pairs = lists.select(F.expr(f"inline(flatten(transform(sequence(1, size(l) - 1), i -> transform(filter(slice(l, i + 1, size(l)), y -> {may}), y -> struct(l[i - 1] as x, y as y)))))"))
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    up = lambda x, d: f"floor((({x}) * {num}L + {d - 1}) / {d})"
    enough = f"c + least(x.h, y.h) >= {up('x.n + y.n', num + den)} - greatest({up('x.n', den)}, {up('y.n', den)}) + 1"
    return frequent.union(pairs.where(enough).select("x.b", "y.b"))


# ---------------------------------------------------------------- signature trees

class SignatureTree:
    """Levels of nodes over sets in order: OR-combined bitmaps, size ranges, and the most hashes that share bits in one member."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITMAP), np.uint64)
        for i, s in enumerate(sets):
            bit = s % np.uint64(64 * BITMAP)
            np.bitwise_or.at(bits[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        lost = self.size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, self.size, self.size, lost)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, lost = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(lost, at)))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def possible(x, i, y, j, num: int, den: int) -> np.ndarray:
    """Whether members of nodes i of level x and j of level y may link: by sizes, and by the overlap that bitmaps allow."""
    (xb, xlo, xhi, xlost), (yb, ylo, yhi, ylost) = x, y
    common = np.bitwise_count(xb[i][:, None] & yb[j][None]).sum(axis=2).astype(np.int64)
    xlo, xhi, xlost, ylo, yhi, ylost = xlo[i][:, None], xhi[i][:, None], xlost[i][:, None], ylo[j][None], yhi[j][None], ylost[j][None]
    most = np.minimum(np.minimum(xhi, yhi), common + np.minimum(xlost, ylost))
    return (most * (num + den) >= num * (xlo + ylo)) & (xhi * den >= num * ylo) & (yhi * den >= num * xlo)


def links(one: SignatureTree, two: SignatureTree, union: Union, shift: int, num: int, den: int, seen: dict | None = None):
    """Pairs (member of one, member of two) that link and connect what was apart. ``shift``: where two's members begin in union;
    0 for a tree with itself. ``seen``, if given, counts node pairs that were ``pruned`` by their bound, and pairs ``compared``."""
    seen = {} if seen is None else seen
    own = one is two
    top = max(len(one.levels), len(two.levels)) - 1
    level = lambda tree, k: min(k, len(tree.levels) - 1)
    stack = [(top, 0, 0)]
    while stack:
        k, a, b = stack.pop()
        if k:
            def below(tree, node):
                if level(tree, k) == level(tree, k - 1):
                    return np.array([node])
                return np.arange(FAN * node, min(FAN * node + FAN, len(tree.levels[k - 1][0])))

            i, j = below(one, a), below(two, b)
            ok = possible(one.levels[level(one, k - 1)], i, two.levels[level(two, k - 1)], j, num, den)
            seen["pruned"] = seen.get("pruned", 0) + ok.size - int(ok.sum())
            # the diagonal comes last onto the stack: neighbours in order, which are most alike, are connected first
            for u, v in sorted(((int(i[p]), int(j[q])) for p, q in zip(*np.nonzero(ok))), key=lambda x: -abs(x[0] - x[1])):
                if (not own or u <= v) and not _connected(union, one, u, two, v, k - 1, shift):
                    stack.append((k - 1, u, v))
        elif (not own or a < b) and union.find(a) != union.find(b + shift):
            seen["compared"] = seen.get("compared", 0) + 1
            if similar(one.sets[a], two.sets[b], num, den):
                union.join(a, b + shift)
                yield a, b


def _connected(union: Union, one, u, two, v, k: int, shift: int) -> bool:
    """All members below two nodes are in one component already."""
    def members(tree, node):
        deep = min(k, len(tree.levels) - 1)
        return range(node * FAN ** deep, min((node + 1) * FAN ** deep, len(tree.sets)))

    root = union.find(members(one, u)[0])
    return k > 0 and all(union.find(i) == root for i in members(one, u)) and all(union.find(i + shift) == root for i in members(two, v))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) * den < num * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _order(sets: list[np.ndarray]) -> list[int]:
    """Sets with equal least hashes stand together, so that nodes cover what is alike."""
    return sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))


def _groups(batches, width: int):
    """Rows with equal first ``width`` columns, which come together."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != last:
                if rows:
                    yield rows
                last, rows = row[:width], []
            rows.append(row)
    if rows:
        yield rows


def _edge_batches(pairs):
    pairs = list(pairs)
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _hashing(k: int):
    """Batches whose last column, the text, becomes the hashes of its set; texts without words are left out."""
    def run(batches):
        shingle = Shingler(k)
        for part in (p for b in batches for p in slices(b, b.num_columns - 1)):
            hashes = pa.array([shingle(x.as_py() or "").tobytes() or None for x in part.column(part.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], hashes], [*part.schema.names[:-1], "hashes"]).filter(hashes.is_valid())

    return run


def _within(num: int, den: int):
    """Connecting links within each chunk: ``(block, chunk, id, hashes)`` in, ``(a, b)`` out."""
    def found(rows):
        first: dict[bytes, int] = {}
        for _, _, doc, hashes in rows:  # equal sets of several tasks: one of them goes into the tree
            if first.setdefault(hashes, doc) != doc:
                yield first[hashes], doc
        sets = [np.frombuffer(h, np.uint64) for h in first]
        order, ids = _order(sets), list(first.values())
        tree = SignatureTree([sets[i] for i in order])
        for i, j in links(tree, tree, Union(len(ids)), 0, num, den):
            yield ids[order[i]], ids[order[j]]

    def run(batches):
        for rows in _groups(batches, 2):
            if len(rows) > 1:
                yield from _edge_batches(found(rows))

    return run


def _across(num: int, den: int):
    """Connecting links between a chunk and a slice of the documents that are apart: ``(block, chunk, slice, probe, id, label, hashes)``."""
    def found(rows):
        trees, ids, labels = [], [], []
        for probe in (False, True):
            mine = [r for r in rows if r[3] == probe]
            if not mine:
                return
            sets = [np.frombuffer(r[6], np.uint64) for r in mine]
            order = _order(sets)
            trees.append(SignatureTree([sets[i] for i in order]))
            ids.append([mine[i][4] for i in order])
            labels += [mine[i][5] for i in order]
        union, first = Union(len(labels)), {}
        for i, lab in enumerate(labels):  # what the first pass has connected
            union.join(first.setdefault(lab, i), i)
        for i, j in links(trees[0], trees[1], union, len(ids[0]), num, den):
            yield ids[0][i], ids[1][j]

    def run(batches):
        for rows in _groups(batches, 3):
            yield from _edge_batches(found(rows))

    return run


# ---------------------------------------------------------------- the job

def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: the size of its set of distinct k-word shingles, and the smallest
    ``doc_id`` that links reach. Documents link when ``den * |intersection| >= num * |union|``.

    A-Z are lower-cased and words are runs of anything but ASCII white space. Texts with fewer words than k have one
    shingle, all their words; texts without words (empty, null) have none and link with nothing. Rows that repeat an id
    are one node with several sets: their links add up. A null id gives a null component and links with nothing.
    Ties do not arise: the result does not depend on the order of rows. An empty table gives an empty result.

    Shuffled are: counts of shingles that repeat; the key shingles (one in ten at t = 0.9, one in five at 0.8), after equal keys
    and equal sets of a task are combined; digests; edges; and the texts that may link with another, the first of equal ones. Texts of any
    length are taken whole. Equality of shingles is that of 64-bit hashes, of sets that of 128-bit ones.
    """
    (sizes, equal), members = _routed(docs, k, num, den)
    hashing, within = _hashing(k), _within(num, den)
    single = members.where("chunks = 1").select("block", F.lit(0).alias("chunk"), "doc_id", "text")  # texts take less of the shuffle than their hashes
    near = save(single.repartition("block").sortWithinPartitions("block").mapInArrow(released(lambda batches: within(hashing(batches))), "a long, b long"), "links")
    members = _chunked(members.where("chunks > 1"), k)
    if not members.isEmpty():
        heads = members.where("doc_id = block").withColumn("chunk", _upto("chunks"))
        chunked = members.unionByName(heads).select("block", "chunk", "doc_id", "hashes")
        near = near.union(save(chunked.repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(released(within), "a long, b long"), "links"))
        near = near.union(_apart(members, near, num, den))
    near = near.union(equal)
    roots = connected_components(near, "a", "b")
    return sizes.join(roots, sizes.doc_id == roots.node, "left").select("doc_id", F.col("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _routed(docs: DataFrame, k: int, num: int, den: int) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """The sizes ``(doc_id, n_shingles)`` and ``(a, b)`` for equal sets, and ``(doc_id, block, chunks, text)`` of documents that may link with another."""
    if not 0 < num <= den:
        raise ValueError("the threshold is not between 0 and 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, k))
    run, schema = _sketch(k, num, den, frequent)
    sketch = save(texts.mapInArrow(released(run), schema), "sketch")
    frequent.unpersist()
    equal = _equal(sketch)
    met = _met(sketch, equal, num, den).union(sketch.where(F.col("kind") == MET).select("a", "b"))
    blocks = connected_components(met, "a", "b").select(F.col("node").alias("doc_id"), F.col("root").alias("block"))
    sizes = sketch.where(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    size = sizes.join(blocks, "doc_id").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("hashes"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_DOCS), F.ceil(F.col("hashes") / CHUNK_HASHES)).cast("long")
    large = save(size.select("block", chunks.alias("chunks")).where("chunks > 1"), "large")
    blocks = blocks.join(small(large), "block", "left").select("doc_id", "block", F.coalesce("chunks", F.lit(1).cast("long")).alias("chunks"))
    # block numbers go to the texts where their count allows it, so that texts are not shuffled for this join
    members = texts.join(small(save(blocks, "blocks")), "doc_id").select("doc_id", "block", "chunks", "text")
    return (sizes, equal.union(sketch.where(F.col("kind") == EQUAL).select("a", "b"))), members


def _chunked(members: DataFrame, k: int) -> DataFrame:
    """``(doc_id, block, chunks, hashes, chunk)``: the members with their sets, dealt out over the chunks of their blocks."""
    sets = members.mapInArrow(released(_hashing(k)), "doc_id long, block long, chunks long, hashes binary")
    return save(sets.withColumn("chunk", F.pmod(F.xxhash64("hashes"), F.col("chunks"))), "members")  # equal sets meet in a chunk


def representatives(docs: DataFrame, k: int = 5) -> DataFrame:
    """``(doc_id, representative)``: the smallest id of a document with an equal set. Documents without words, and rows without an id, have no row;
    rows that repeat an id have one for each different set."""
    def digests(batches):
        shingle = Shingler(k)
        for batch in batches:
            sets = [shingle(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())], ["doc_id", "digest"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = save(texts.mapInArrow(released(digests), "doc_id long, digest binary").where("digest is not null").distinct(), "digests")
    return found.join(found.groupBy("digest").agg(F.min("doc_id").alias("representative")), "digest").select("doc_id", "representative")


def linked_pairs(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(a, b)``, a < b: every link between documents with different sets, each set being represented by its smallest id (``representatives`` says
    for which others). Ids are unique.

    Nothing is left out and copies are not expanded; yet m texts that are all near copies of each other have m (m - 1) / 2 links, and each
    is a row. Where such groups are large, ``components`` is what scales. An empty table gives an empty result.
    """
    own = representatives(docs, k).where("doc_id = representative").select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = _chunked(_routed(only_ids(rows, save(own, "own"), "doc_id"), k, num, den)[1], k)
    # each chunk meets each of its block once, itself included
    both = members.withColumn("other", _upto("chunks")).withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    both = both.select("block", "lo", "hi", "chunk", "doc_id", "hashes").repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi", "chunk")
    return both.mapInArrow(released(_every(num, den)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class Apart(Union):
    """Members that are never taken as connected, so that a traversal gives all links."""

    def join(self, i: int, j: int) -> bool:
        return True


def _every(num: int, den: int):
    """All links within a chunk or between two: ``(block, lo, hi, chunk, id, hashes)`` in, ``(a, b)`` out."""
    def found(rows):
        trees, ids = [], []
        for chunk in dict.fromkeys(r[3] for r in rows):
            mine = [r for r in rows if r[3] == chunk]
            sets = [np.frombuffer(r[5], np.uint64) for r in mine]
            order = _order(sets)
            trees.append(SignatureTree([sets[i] for i in order]))
            ids.append([mine[i][4] for i in order])
        if rows[0][1] != rows[0][2] and len(trees) < 2:
            return
        for i, j in links(trees[0], trees[-1], Apart(sum(map(len, ids))), len(ids[0]) * (len(trees) - 1), num, den):
            yield ids[0][i], ids[-1][j]

    def run(batches):
        for rows in _groups(batches, 3):
            yield from _edge_batches(found(rows))

    return run


def _apart(members: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """Links across the chunks of large blocks, whose members these are, where documents are still apart from their block's main component."""
    large = members.select("block", "chunks", "doc_id", "chunk")
    roots = connected_components(only_ids(near.select(F.col("a").alias("doc_id"), "b"), large, "doc_id"), "doc_id", "b")
    labels = large.join(roots, large.doc_id == roots.node, "left").select("block", "chunks", "doc_id", F.coalesce("root", "doc_id").alias("label"))
    main = labels.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    main = small(save(main, "main"))
    labels = save(labels.distinct().join(main, "block"), "labels")
    rest = small(save(labels.where("label <> main").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS).cast("long").alias("slices")), "rest"))
    rows = members.join(small(labels.select("doc_id", "label", "main")), "doc_id").join(rest, "block")
    cols = ["block", "chunk", "slice", "probe", "doc_id", "label", "hashes"]
    there = rows.withColumn("slice", _upto("slices")).withColumn("probe", F.lit(False)).select(cols)
    probes = rows.where("label <> main").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices"))).withColumn("chunk", _upto("chunks")).withColumn("probe", F.lit(True)).select(cols)
    both = there.union(probes).repartition("block", "chunk", "slice").sortWithinPartitions("block", "chunk", "slice")
    return save(both.mapInArrow(released(_across(num, den)), "a long, b long"), "links")


def _node(ident: Column, text: Column) -> Column:
    return F.xxhash64(ident, text)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of texts that link: the one with the smallest id, and of those the one whose id and text have the least hash.

    Columns are unchanged. Rows without an id stay, and so do texts without words. Rows that share an id but whose texts do not link
    all stay; of rows that repeat both id and text, the one with the least other columns stays. The result does
    not depend on the order of rows. An empty table gives an empty result. Columns may have any names.
    """
    node, ident, winner, check = (fresh(docs, x) for x in ("node", "ident", "winner", "check"))
    rows = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumns({node: _node(F.col(ident), F.col("text")), check: F.xxhash64(F.lit(1), "text", ident)})
    # a row's name is a hash of 64 bits; where different rows have the same, as a second hash tells, it is that one
    again = rows.where(F.col(ident).isNotNull()).groupBy(node).agg(F.count(F.lit(1)).alias("n"), F.min(check).alias("lo"), F.max(check).alias("hi")).where("n > 1")
    again = save(again.select(node, (F.col("lo") != F.col("hi")).alias("clash")), "again")
    clash = again.where("clash")
    if clash.isEmpty():
        again = again.select(node)
    else:
        rows = rows.join(small(clash), node, "left").withColumn(node, F.when(F.col("clash"), F.col(check)).otherwise(F.col(node))).drop("clash")
        again = save(rows.where(F.col(ident).isNotNull()).groupBy(node).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(node), "again")
    named = rows.where(F.col(ident).isNotNull())
    found = save(components(named.select(F.col(node).alias("doc_id"), "text"), k, num, den).distinct(), "components")
    several = save(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id"), "several")
    group = save(found.join(small(several), "component_id").select(F.col("doc_id").alias(node), "component_id"), "group")
    group = save(named.select(ident, node).join(small(group), node), "named")
    best = group.groupBy("component_id").agg(F.min(F.struct(ident, node)).alias("best"))
    best = save(best.select("component_id", F.col("best").getField(ident).alias(winner), F.col("best").getField(node).alias(winner + "_node")), "best")
    apart = (F.col(ident) != F.col(winner)) | (F.col(node) != F.col(winner + "_node"))
    gone = save(group.join(small(best), "component_id").where(apart).select(node, ident).distinct(), "gone")
    kept = rows.join(small(gone), [node, ident], "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return kept.select(*columns)
    repeated = kept.where(F.col(ident).isNotNull()).join(small(again), node, "left_semi")
    one = repeated.groupBy(node, ident, "text").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(winner)).select(f"{winner}.*")
    other = small(again.withColumnRenamed(node, winner))
    rest = kept.join(other, (F.col(node) == F.col(winner)) & F.col(ident).isNotNull(), "left_anti")
    return rest.select(*columns).unionByName(one)
