"""Jaccard join and repeated passages against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard, suffix


def linked(rows, k, num, den):
    """Set size and component of each id, by comparing all pairs that share a shingle."""
    up, inverted, sets = {i: i for i, _ in rows}, {}, []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j: j + k]) for j in range(len(w) - k + 1)]))
    for a, s in enumerate(sets):
        for b, n in Counter(b for x in s for b in inverted.get(x, ())).items():
            if den * n >= num * (len(s) + len(sets[b]) - n):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
        for x in s:
            inverted.setdefault(x, []).append(a)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def near_copies(seed, n):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[random.choice(words) for _ in range(random.choice([3, 8, 12, 20, 30, 60, 200]))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 1, 1, 2, 4])):
            j = random.randrange(len(w))
            w[j: j + random.randint(0, 1)] = [random.choice(words)]
        rows.append((i * 3 + 1, " ".join(w)))
    return rows + [(5000, None), (5003, ""), (5006, " \n"), (5009, "a"), (5012, "A"), (5015, "É"), (5018, "é"), (5021, "x" * 20000), (5009, "q r"), (5024, "Q\tr")]


@pytest.mark.parametrize(("k", "num", "chunk"), [(3, 90, 2000), (3, 70, 2000), (5, 80, 2000), (3, 90, 7), (3, 70, 7)])
def test_components(spark, monkeypatch, k, num, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", chunk)
    rows = near_copies(k * num, 250)
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, block int")
    found = jaccard.components(df, k, num, 100)
    assert sorted(tuple(r) for r in found.collect()) == linked(rows, k, num, 100)


@pytest.mark.parametrize("chunk", [2000, 8])
def test_linked_pairs(spark, monkeypatch, chunk):
    """Every link between different sets, and whom their representatives stand for."""
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", chunk)
    rows = list(dict(near_copies(21, 150)).items())
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[j: j + 3]) for j in range(len(w) - 2)])
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.representatives(df, 3).collect()} == {(i, first[x]) for i, x in sets.items() if x}
    own = sorted(i for x, i in first.items() if x)
    expected = [(a, b) for n, a in enumerate(own) for b in own[n + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(tuple(r) for r in jaccard.linked_pairs(df, 3, 80, 100).collect()) == expected and len(expected) > 50
    assert jaccard.linked_pairs(df.limit(0)).count() == 0


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted(map(str, jaccard.components(df, 3, 90, 100).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=None)"] * 2 + ["Row(doc_id=3, n_shingles=2, component_id=3)"])
    assert jaccard.components(df.limit(0)).count() == 0
    assert jaccard.keep_one(df, 3, 90, 100).count() == 3


def test_keep_one(spark):
    rows = [(i, t) for i, t in near_copies(4, 120)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100)
    groups = {}
    for (n, _, c), (i, _) in zip(linked([(n, t) for n, (_, t) in enumerate(rows)], 3, 80, 100), rows):
        groups.setdefault(c, []).append(i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_prefixes_always_meet():
    rng = np.random.default_rng(5)
    few = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    order = jaccard.Frequent(few, rng.integers(4, 5000, 400))
    for num in (70, 80, 90, 95):
        for n in (1, 2, 5, 9, 10, 17, 40, 150, 600):
            for _ in range(25):
                a = np.unique(np.concatenate([rng.integers(0, 1 << 63, n - n // 3), rng.choice(few, n // 3)]).astype(np.uint64))
                b = set(a.tolist())
                while True:  # change as much as the threshold allows
                    c = set(b)
                    if rng.random() < 0.5 and len(c) > 1:
                        c.remove(rng.choice(sorted(c)))
                    else:
                        c.add(int(rng.integers(0, 1 << 63)))
                    both = len(c & set(a.tolist()))
                    if 100 * both < num * (len(a) + len(c) - both):
                        break
                    b = c
                keys = jaccard.prefix_keys(a, order, num, 100), jaccard.prefix_keys(np.array(sorted(b), np.uint64), order, num, 100)
                assert len(np.intersect1d(*keys))
                large, small = sorted(((len(a), tuple(keys[0])), (len(b), tuple(keys[1]))), reverse=True)
                assert set(large[1]) & set(small[1][:jaccard.found_by(small[0], num, 100)])
                assert jaccard.size_class(large[0], num, 100) - jaccard.size_class(small[0], num, 100) in (0, 1)


@pytest.mark.parametrize(("k", "num", "chunk"), [(3, 90, 2000), (5, 80, 2000), (5, 80, 9), (3, 70, 9)])
def test_common_passage(spark, monkeypatch, k, num, chunk):
    """A passage that all texts share, as a small and as a large part of them, next to near copies."""
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", chunk)
    random.seed(num + chunk)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} {t}") for i, t in near_copies(11, 150) if t]
    rows += [(9000 + i, f"{passage} {' '.join(f'u{i}x{j}' for j in range(i % 60))}") for i in range(120)]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100)
    assert sorted(tuple(r) for r in found.collect()) == linked(rows, k, num, 100)


@pytest.mark.parametrize("many", [32, 4])
def test_template_pages(spark, monkeypatch, many):
    """Texts of a template do not meet unless they may link, however many they are; those that do are found."""
    monkeypatch.setattr(jaccard, "MANY", many)
    template = [f"t{i}" for i in range(180)]
    page = lambda i, n, cut=180: (i, " ".join([*template[:cut], *(f"own{i}x{j}" for j in range(n))]))
    apart = [page(i, 28) for i in range(400)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, members = jaccard._routed(df(apart), 5, 80, 100)
    assert members.count() == 0
    near = apart[:60] + [page(1000 + i, i % 30, 180 - i % 7) for i in range(90)] + [page(2000 + i, 3, 90 + i) for i in range(90)]
    found = jaccard.components(df(near), 5, 80, 100)
    assert sorted(tuple(r) for r in found.collect()) == linked(near, 5, 80, 100)


def test_chance_keys_bring_nothing_together(spark, monkeypatch):
    """Keys that a hundred documents of several tasks have, few of them each, are counted and bring none into a block; near copies among them are found."""
    monkeypatch.setattr(jaccard, "FREQUENT", 0)  # no order: keys are the least hashes, whatever has them
    passage = [f"p{i}" for i in range(24)]
    page = lambda i, own: (i, " ".join([*passage, *(f"own{own}x{j}" for j in range(176))]))
    apart = [page(i, i) for i in range(100)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shingle = jaccard.Shingler(5)
    none = jaccard.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert set.intersection(*(set(jaccard.prefix_keys(shingle(t), none, 80, 100).tolist()) for _, t in apart))  # keys of all
    _, members = jaccard._routed(df(apart), 5, 80, 100)
    assert members.count() == 0
    rows = apart + [(i, t + " more") for i, (_, t) in enumerate(apart[:9], 500)]
    _, members = jaccard._routed(df(rows), 5, 80, 100)
    assert members.count() == 18
    assert sorted(tuple(r) for r in jaccard.components(df(rows), 5, 80, 100).collect()) == linked(rows, 5, 80, 100)


@pytest.mark.parametrize("broadcast", [2_000_000, 3])
def test_equal_sets_of_several_tasks(spark, monkeypatch, broadcast):
    """Of equal sets one is routed, whatever tasks they come from; an id with several sets keeps them all."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", broadcast)
    texts = [" ".join(f"w{i}x{j}" for j in range(20 + i)) for i in range(12)]
    copies = [[(100 * n + i, t.upper() if n % 2 else t) for i, t in enumerate(texts)] for n in range(4)]
    rows = sum(copies, []) + [(500 + i, t + " z") for i, t in enumerate(texts)] + [(501, texts[4] + " y"), (302, texts[7]), (600, None), (601, "")]
    df = spark.createDataFrame(copies[0], "doc_id long, text string").coalesce(1)
    for more in (copies[1], copies[2], copies[3], rows[48:]):
        df = df.union(spark.createDataFrame(more, "doc_id long, text string").coalesce(1))
    _, members = jaccard._routed(df.where("doc_id not in (302, 501)"), 5, 80, 100)
    assert members.count() == 22  # the first of four copies, and the near copy, of each text; that of one text was left out
    assert sorted(tuple(r) for r in jaccard.components(df, 5, 80, 100).collect()) == linked(rows, 5, 80, 100)


def test_frequent_shingles_go_last(spark, monkeypatch):
    rows = [(f"common words of every text here {i} {i + 1} {i + 2}",) for i in range(50)]
    frequent = jaccard.frequent_shingles(spark.createDataFrame(rows, "text string").repartition(2), 3)
    kinds = frequent.classes_of(jaccard.Shingler(3)("common words of every text here 7 8 9"))
    assert sorted(kinds.tolist()) == [0] * 3 + [5] * 4
    assert len(jaccard.prefix_keys(jaccard.Shingler(3)("common words of every text here 7 8 9"), frequent, 80, 100)) == 2
    monkeypatch.setattr(jaccard, "FREQUENT", 3)  # more of one class than fit: none of that class
    assert len(jaccard.frequent_shingles(spark.createDataFrame(rows, "text string"), 3).hashes) == 0


def test_keep_one_keeps_unlike_rows_of_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "x", 1), (1, "quite another text of its own", "x", 2), (1, text, "a", 3), (2, text + " z", "b", 4), (3, None, "c", 5), (3, None, "c", 5), (None, text, "d", 6), (None, text, "d", 6), (4, "", "e", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string, _gone int")
    out = jaccard.keep_one(df, 5, 80, 100)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, text, "a", 3), rows[1], rows[4], rows[6], rows[7], rows[8]]))


def test_keep_one_where_names_collide(spark, monkeypatch):
    """Rows whose first hashes are equal are told apart by the second."""
    monkeypatch.setattr(jaccard, "_node", lambda ident, text: ident % 3)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(12)] + [(20, " ".join(f"w1x{j}" for j in range(12))), (5, " ".join(f"w5x{j}" for j in range(12))), (30, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 30]


def test_tree_bounds_hold():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 60 + i % 20, replace=False), rng.integers(0, 1 << 63, i % 5).astype(np.uint64)])) for i in range(200)]
    tree, union = jaccard.SignatureTree(sets), jaccard.Union(len(sets))
    seen = {}
    assert len(list(jaccard.links(tree, tree, union, 0, 70, 100, seen))) > 0 < seen["pruned"]
    plain = jaccard.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.similar(sets[i], sets[j], 70, 100):
                plain.join(i, j)
    assert [union.find(i) for i in range(200)] == [plain.find(i) for i in range(200)]


def removed(texts, length):
    counts = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "many"), [(40, 1500), (33, 1500), (40, 1), (40, 3), (17, 1500)])
def test_repeats(spark, monkeypatch, length, many):
    monkeypatch.setattr(suffix, "MANY_SEGMENTS", many)
    random.seed(length + many)
    base = ["".join(random.choice("abcd") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(100):
        s = "".join(random.choice("abcdé") for _ in range(random.randint(0, 120)))
        for _ in range(random.randint(0, 3)):
            a = random.randint(0, 200)
            s += random.choice(base)[a: a + random.randint(20, 100)] + "".join(random.choice("xyz") for _ in range(random.randint(0, 30)))
        rows.append((i, "ab " * random.randint(1, 60) if i % 10 == 0 else s))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (None, rows[3][1]), (4, rows[5][1]), (4, rows[5][1]), (300, "z" * 3000)]
    df = spark.createDataFrame([(i, t, 0, b"") for i, t in rows], "doc_id long, text string, n_spans int, h binary")
    out = suffix.cut_repeats(df, length)
    assert out.columns == ["doc_id", "text", "h", "n_bytes", "n_removed", "n_spans", "kept"]
    found = [(r.n_bytes, r.n_removed, r.n_spans, r.s) for r in out.withColumn("s", F.sha2("kept", 256)).collect()]
    assert sorted(found) == removed([(t or "").encode() for _, t in rows], length)


def test_index_statistics():
    random.seed(2)
    text = bytes(random.choice(b"ab") for _ in range(300)) * 2 + b"\xfe"
    index = suffix.RunLengthIndex(np.frombuffer(text, np.uint8))
    stats = index.statistics()
    for i in range(0, len(text), 7):
        best = 0
        for j in range(len(text)):
            if i != j:
                n = 0
                while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                    n += 1
                best = max(best, n)
        assert stats[i] == best
    assert index.runs.sum() == len(text) and len(index.runs) < len(text)


def test_op5_at_its_own_length(spark):
    """The query on the given table at 400 bytes, against brute force over its distinct texts, in place of all strings."""
    from quillon.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    counts = Counter()
    for t in docs.values():
        counts.update(hash(t[i: i + 400]) for i in range(len(t) - 399))
    seen = 0
    for r in QUERIES["op5_run_length_dedup"](spark, d).collect():
        t = docs[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[hash(t[i: i + 400])] > 1:
                gone[i: i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        seen += spans > 0
    assert seen > 100


def test_clashing_columns(spark):
    names = ["doc_id", "text", "_h", "_keep", "_whole", "_marks", "_copy", "_n", "c2", "kept", "n_bytes", "a.b"]
    text = "the passage that both have in common, word for word"
    df = spark.createDataFrame([(i, t, *range(10)) for i, t in ((1, "x" + text), (2, text + "y"), (3, "alone"), (None, None))], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names[2:]))
    assert df.columns == names
    out = suffix.dedup(df, 40)
    assert out.columns == names and sorted(map(str, (tuple(r)[1:] for r in out.collect()))) == sorted(str((t, *range(10))) for t in ("x", "y", "alone", ""))
    assert suffix.cut_repeats(df, 40).columns == [n for n in names if n not in suffix.NEW] + list(suffix.NEW)


def test_dedup_keeps_columns(spark):
    long = "é" * 60 + "the passage that both have in common, word for word"
    df = spark.createDataFrame([(1, "x" + long + "y", 7), (2, "q" + long, 7), (3, "alone", 7), (4, None, 7)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in suffix.dedup(df, 40).collect()}
    assert [out[i].text for i in (1, 2, 3)] == ["xy", "q", "alone"] and out[1].n_chars == 2
    assert suffix.dedup(df.limit(0), 40).count() == 0


def test_rounds_of_components_join_once(spark):
    """A round's two joins are not planned and broadcast anew for each use of their result."""
    from quillon.llm.common import _closer

    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8)], "u long, v long")
    out = _closer(links, F.broadcast)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and plan.count("Union") == 0  # the first stands on both sides of the second, as one shuffle
    assert {tuple(r) for r in out.collect()} == {(5, 3), (4, 2), (3, 2), (9, 8)}


def test_fits_give_memory_back(spark, sf_dir, monkeypatch):
    """The driver holds nothing of a sample once a model is fitted."""
    from quillon.llm import common, quality, toxicity

    docs, labels, calls = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    toxicity.fit(docs, labels, steps=1, max_rows=20)
    quality.fit(docs, labels, steps=1, max_rows=20)
    assert len(calls) == 2
