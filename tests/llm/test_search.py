"""Ranked search against plain loops over all documents."""
import math
import random
import re
from collections import Counter

import pytest

from quillon.llm import search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text))
            if score > 0:
                found.append((-score, i is None, i, -score))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "ß", "x-y", "A_b", "don't", "数据"]
    some = lambda n: random.choice([" ", "\n", ", "]).join(random.choice(vocabulary) for _ in range(n))
    docs = [(i * 7 % 501, some(random.choice([1, 3, 20, 90]))) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(600, 700)] + [(900, None), (901, ""), (902, " .,"), (None, some(9)), (docs[0][0], some(5)), (903, "w1 " * 30000)]
    items = [(i, some(random.choice([1, 2, 15, 40]))) for i in range(30)] + [(50, docs[3][1]), (51, docs[3][1] + " w1 w1"), (52, None), (53, "?"), (54, "absent"), (55, "w2 " * 5000)]
    return docs, items


@pytest.mark.parametrize(("k", "block", "cells"), [(10, 50_000, 4_000_000), (3, 2000, 4000)])
def test_ranked(spark, monkeypatch, k, block, cells):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id long, text string, doc_id int")
    found = search.ranked(d, q, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, items, k)


def test_repeated_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b"), (7, "b"), (7, "a b")], "item_id long, text string")
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in search.ranked(docs, items).collect()) == [(7, 1, 1), (7, 1, 1), (7, 1, 1), (7, 2, 2)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(docs.limit(0), items).collect() == [] == search.ranked(docs, items.limit(0)).collect()


def test_shared_sets_are_one_node():
    plan = search.Plan(["a b c d x", "a b c d y", "a b c d z", "q", None, "a a"])
    assert plan.items == [0, 1, 2, 3, 5]
    assert len(plan.levels) == 2 and plan.size == len(plan.leaves) + 3  # a b, c d, and a b c d
    assert len(plan.parts) == 2 + 2 + 2 + 1 + 1
