import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import access as a
from quillon.operators import docgraph as g
from quillon.sources import readers, sinks
from quillon.streaming import streams


def test_references(spark):
    bodies = [('{"a":{"$ref":"http://x/y#/z"},"b":[{"$ref":"#/l"},{"$ref":"r.json","k":1}],"$ref":5}',), ("{bad",), (None,), ("[]",)]
    rows = spark.createDataFrame(bodies, "body string").withColumn("refs", g.refs("body")).collect()
    assert [(r.ref, r.sole_key) for r in rows[0].refs] == [("http://x/y#/z", True), ("#/l", True), ("r.json", False)]
    assert [r.refs for r in rows[1:]] == [None, None, []]


def test_references_of_hard_texts(spark):
    """As a walk over the parsed document gives them; no Python worker."""
    texts = ["$ref", '"$ref":"x"', '{"$ref":"y"}', 'a"$ref', "\\", "é\n", "}", "#/l", "http://h/a#/b"]
    random.seed(3)

    def some(depth):
        kind = random.random()
        if depth == 0 or kind < 0.3:
            return random.choice([*texts, 5, None, True, 1.5, {}, []])
        if kind < 0.6:
            return {"$ref": random.choice([*texts, 7])} | ({random.choice(["k", 'a"$ref', "$ref "]): random.choice(texts)} if random.random() < 0.4 else {})
        return [some(depth - 1) for _ in range(3)] if kind < 0.8 else {random.choice(["a", "b", "\\", 'q"']) + str(i): some(depth - 1) for i in range(3)}

    docs = [some(4) for _ in range(300)]
    bodies = [json.dumps(d, indent=random.choice([None, 1]), ensure_ascii=i % 2 == 0) for i, d in enumerate(docs)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, body string").withColumn("refs", g.refs("body"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    found = {r.i: [(x.ref, x.sole_key) for x in r.refs] for r in df.collect()}
    assert all(sorted(found[i]) == sorted(g.walk(d)) for i, d in enumerate(docs)) and sum(map(len, found.values())) > 200


def test_pointer_and_resolution(spark):
    df = spark.createDataFrame([('{"a":{"b":[1]}}', w) for w in ("", "/", "/a/b", "/a//b", "/a/b/0", "/x")] + [("x", "/a")], "body string, w string")
    out = [(r.x.value, r.x.error) for r in df.select(g.pointer("body", "w").alias("x")).collect()]
    assert out[:4] == [('{"a":{"b":[1]}}', None)] * 2 + [("[1]", None)] * 2 and out[4][1] == "no key 0" and out[5][1] == "no key x" and out[6][1] == "not JSON"
    df = spark.createDataFrame([("http://h/a/b.json", "c.json"), (None, "c.json"), (None, "http://q/"), ("http://h/a", "")], "b string, r string")
    assert [tuple(r.x) for r in df.select(g.resolve("b", "r").alias("x")).collect()] == [("http://h/a/c.json", None), (None, "no base"), ("http://q/", None), ("http://h/a", None)]


def test_closure_with_cycles(spark):
    random.seed(1)
    pairs = [(random.randrange(40), random.randrange(40)) for _ in range(45)]
    after = {}
    for s, d in pairs:
        after.setdefault(s, set()).add(d)
    expected = set()
    for s in after:
        todo, seen = list(after[s]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        expected |= {(s, x) for x in seen}
    found = g.closure(spark.createDataFrame(pairs, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == expected
    assert g.closure(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_inline(spark):
    docs = {"http://h/a": {"x": {"$ref": "b#/p"}, "l": {"$ref": "#/x"}}, "http://h/b": {"p": [{"$ref": "c"}], "q": 1}, "http://h/c": {"v": 7, "back": {"$ref": "a#/none"}}, "http://h/d": {"$ref": "d"}}
    df = spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()] + [("http://h/e", "{")], "url string, body string")
    out = {r.url: r for r in g.inline(df).collect()}
    assert json.loads(out["http://h/a"].resolved) == {"x": [{"v": 7, "back": {"$ref": "a#/none"}}], "l": {"$ref": "#/x"}}
    assert out["http://h/a"].unresolved == ["a#/none"] and out["http://h/d"].unresolved == ["d"] and out["http://h/e"].unresolved == ["not JSON"]


def test_inline_deep_chains_and_cycles(spark):
    n = 24
    docs = {f"http://h/{i}": {"p": {"v": i, "n": {"$ref": f"{i + 1}#/p"}} if i < n else i} for i in range(n + 1)}
    docs |= {"http://h/a": {"p": [{"$ref": "b#/p"}, {"$ref": "none"}]}, "http://h/b": {"p": [{"$ref": "a#/p"}, {"$ref": "c"}]}, "http://h/c": {"x": {"$ref": "b#/p"}}}

    def go(x, base, opened, failed):
        if isinstance(x, list):
            return [go(v, base, opened, failed) for v in x]
        if not isinstance(x, dict):
            return x
        if set(x) != {"$ref"}:
            return {k: go(v, base, opened, failed) for k, v in x.items()}
        name, _, fragment = x["$ref"].partition("#")
        y = docs.get(f"http://h/{name}")
        if y is None or x["$ref"] in opened:
            failed.append(x["$ref"])
            return x
        return go(y["p"] if fragment else y, name, opened | {x["$ref"]}, failed)

    out = {r.url: r for r in g.inline(spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()], "url string, body string")).collect()}
    assert set(out) == set(docs)
    for u, body in docs.items():
        failed = []
        assert json.loads(out[u].resolved) == go(body, u, frozenset(), failed) and out[u].unresolved == failed


def test_inline_of_a_ladder_resolves_fragments_once(spark):
    """Thirty diamonds: the text doubles with each, and is given up to a size."""
    docs = {f"http://h/{i}": {"p": [{"$ref": f"{i + 1}#/l"}, {"$ref": f"{i + 1}#/r"}], "l": [{"$ref": "#/p"}, {"$ref": f"{i}#/p"}], "r": {"$ref": f"{i}#/p"}} for i in range(30)}
    docs["http://h/30"] = {"l": 1, "r": 2}
    df = spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()], "url string, body string")
    pieces, arcs = g.fragments(df)
    assert pieces.count() == 30 + 60 and arcs.count() == 29 * 4 + 2
    out = {r.url: r for r in g.inline(df, max_bytes=100_000).collect()}
    assert json.loads(out["http://h/29"].resolved) == {"p": [1, 2], "l": [{"$ref": "#/p"}, [1, 2]], "r": [1, 2]}
    whole, none = ([u for u in out if (out[u].resolved is None) == x] for x in (False, True))
    assert len(whole) > 8 and len(none) > 15 and "http://h/0" in none
    assert all(out[u].unresolved == ["larger than 100000 characters"] for u in none) and all(out[u].unresolved == [] for u in whole)


def test_inline_of_documents_that_all_refer_to_each_other(spark):
    n = 12
    docs = {f"http://h/{i:02}": [{"$ref": f"{j:02}"} for j in range(n) if j != i] for i in range(n)} | {"http://h/x": {"$ref": "03"}, "http://h/y": [{"$ref": "11"}, {"$ref": "x"}]}
    out = {r.url: r for r in g.inline(spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()], "url string, body string"), max_ways=500).collect()}

    def go(i):  # references stay that do not lead to a greater document
        return [go(j) if j > i else {"$ref": f"{j:02}"} for j in range(n) if j != i]

    assert json.loads(out["http://h/x"].resolved) == go(3) and json.loads(out["http://h/y"].resolved) == [go(11), go(3)]
    assert json.loads(out["http://h/03"].resolved) == [go(j) for j in range(n) if j != 3]
    assert out["http://h/11"].unresolved == [r for j in range(n - 1) for r in _stay(go(j))]


def _stay(x):
    return [x["$ref"]] if isinstance(x, dict) else [r for y in x for r in _stay(y)]


def test_inline_to_a_depth(spark):
    docs = {f"http://h/{i}": {"p": {"$ref": f"{i + 1}#/p"}, "q": {"$ref": "0"}} for i in range(5)}
    df = spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()], "url string, body string")
    for depth, p, q in ((0, {"$ref": "1#/p"}, {"$ref": "0"}), (1, {"$ref": "2#/p"}, docs["http://h/0"]), (3, {"$ref": "4#/p"}, {"p": {"$ref": "3#/p"}, "q": {"$ref": "0"}})):
        out = {r.url: json.loads(r.resolved) for r in g.inline(df, depth).collect()}
        assert out["http://h/0"] == {"p": p, "q": q}


def test_hard_documents(spark):
    """A long chain, deep JSON, malformed URLs."""
    n = 30
    deep = "[" * 3000 + '{"$ref":"http://h/0#/p"}' + "]" * 3000
    docs = {f"http://h/{i}": json.dumps({"p": {"$ref": f"{i + 1}#/p"} if i < n else i}) for i in range(n + 1)}
    docs |= {"http://h/bad": '{"x":{"$ref":"http://[bad"},"y":{"$ref":"http://h/30#/p"}}', "http://h/deep": deep, "http://h/abyss": "[" * 2_000_000 + "]" * 2_000_000}
    out = {r.url: r for r in g.inline(spark.createDataFrame(list(docs.items()), "url string, body string")).collect()}
    assert out["http://h/0"].resolved == '{"p":30}' and out["http://h/0"].unresolved == []
    assert out["http://h/bad"].resolved == '{"x":{"$ref":"http://[bad"},"y":30}' and out["http://h/bad"].unresolved == ["http://[bad"]
    assert out["http://h/deep"].resolved == "[" * 3000 + "30" + "]" * 3000
    assert out["http://h/abyss"].resolved is None and out["http://h/abyss"].unresolved
    df = spark.createDataFrame([("http://h/a", "http://[bad"), ("http://[bad", "x"), ("http://h/a", None)], "b string, r string")
    assert [tuple(r.x) for r in df.select(g.resolve("b", "r").alias("x")).collect()] == [(None, "malformed URL")] * 2 + [("http://h/a", None)]


def test_closure_bound_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    assert g.closure(chain).count() == 210 and g.closure(chain, 6).count() == 210
    with pytest.raises(RuntimeError):
        g.closure(chain, 3).count()


def plain_replay(rows, ttl):
    last, out = {}, []
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, "", r[1])):
        if k not in last or t - last[k] > ttl:
            last[k] = t
            out.append((k, t))
    return sorted(out, key=str)


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("ttl", "span", "kind"), [(60, 100_000, "long"), (5000, 100_000, "long"), (7.5, 900, "double")])
def test_replay_of_busy_keys(spark, many_tasks, ttl, span, kind):
    """A key over all tasks, by sums of runs that are longer and shorter than the time to live; equal times, nulls."""
    random.seed(5)
    own = (lambda x: x) if kind == "long" else (lambda x: x / 4)
    rows = [("k", own(random.randrange(span))) for _ in range(6000)] + [("j", own(7)), ("j", own(7)), ("l", own(1)), (None, own(3)), (None, own(4)), ("k", None)]
    out = g.replay(spark.createDataFrame(rows, f"k string, t {kind}").repartition(3), "k", "t", ttl)
    assert out.columns == ["k", "t", "fetched"] and out.count() == len(rows)
    assert sorted(((r.k, r.t) for r in out.where("fetched").collect()), key=str) == plain_replay(rows, ttl)


def test_replay_of_one_key_takes_several_tasks(spark, many_tasks):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    out = g.replay(rows, "k", "t", 1000).withColumn("task", F.spark_partition_id())
    found = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("fetched").alias("fetched")).collect()
    assert sum(r.fetched for r in found) == -(-200_000 // 1001) and sum(r.n > 0 for r in found) > 1 and max(r.n for r in found) < 150_000


def test_replay_restarts_on_fetches_only(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 50, 100, 101, 150, 201, 202)] + [("b", 5)], "k string, t long")
    hits = {(r.k, r.t) for r in g.replay(df, "k", "t", 100).where("fetched").collect()}
    assert hits == {("a", 0), ("a", 101), ("a", 202), ("b", 5)}


def test_stream_fetches_like_replay_for_any_batches(spark, tmp_path):
    random.seed(2)
    rows = sorted(((random.choice("abc"), random.randrange(1000)) for _ in range(200)), key=lambda r: r[1])
    df = spark.createDataFrame(rows, "k string, t long")
    expected = sorted((r.k, r.t) for r in g.replay(df, "k", "t", 100).where("fetched").collect())
    for name, cuts in (("one", [0, 1000]), ("three", [0, 310, 620, 1000])):
        for low, high in zip(cuts, cuts[1:]):
            df.where(f"t >= {low} and t < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        out = streams.run_once(streams.read_parquet_stream(df, str(tmp_path / name), 1), lambda s: streams.first_per_ttl(s, "k", "t", 100), name)
        assert sorted((r.k, r.t) for r in out.collect()) == expected


def test_stream_state_ends(spark, tmp_path):
    """Three batches: keys are held until their time to live and the delay are over, and rows behind the watermark are late."""
    given = [[(f"k{i}", i) for i in range(50)] + [("a", 100)],
             [("a", 150), ("a", 99), ("b", 1000), ("k7", 95)],
             [("a", 300), ("b", 1010), ("c", 2000), ("k3", 989)],  # the watermark of the batch before is at 90
             [("z", 980), ("a", 985), ("z", 1500), ("c", 2050)]]  # at 990
    df = spark.createDataFrame(given[0], "k string, t long")
    for rows in given:
        spark.createDataFrame(rows, "k string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by their times
    batches = []
    out = streams.run_once(streams.read_parquet_stream(df, str(tmp_path / "in"), 1), lambda s: streams.first_per_ttl(s, "k", "t", 100, "10 seconds"), "ending", batches)
    assert sorted((r.k, r.t) for r in out.collect()) == sorted([*given[0], ("a", 300), ("b", 1000), ("c", 2000), ("k3", 989), ("z", 1500)])
    held = [b["keys"] for b in batches]
    assert held[0] == 51 and max(held) == 52 and held[2] < 10 and held[-1] == 1
    assert [b["late"] for b in batches[:4]] == [0, 0, 0, 2] and sum(b["rows"] for b in batches) == sum(map(len, given))


def test_fresh_and_newest(spark):
    df = spark.createDataFrame([("u", 1.0, "old"), ("u", 5.0, "new"), ("v", None, "x")], "url string, timestamp double, document string")
    assert [(r.url, r.document) for r in g.newest(df.where("url = 'u'")).collect()] == [("u", "new")]
    assert {r.document for r in g.fresh(df, 10, 5).collect()} == {"new"}


def test_feature_collection_file(spark, tmp_path):
    ring = [[[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]]
    (tmp_path / "lakes.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": 1, "properties": {"name": "L"}, "geometry": {"type": "Polygon", "coordinates": ring}}]}))
    r = readers.geojson_features(spark, str(tmp_path), "name string", collection=True).first()
    assert (r.id, r.name, r.minx, r.miny, r.maxx, r.maxy) == (1, "L", 0, 0, 2, 3)


def test_envelopes_with_altitude(spark, tmp_path):
    shapes = [("Point", [1, 2, 300]), ("LineString", [[10, -5, 900], [11, -4, 901]]), ("MultiPolygon", [[[[0, 0], [4, 0], [4, 3], [0, 0]]], [[[-7.5, 1e1, 5], [2, 2, 2], [1, 1, 1], [-7.5, 1e1, 5]]]])]
    lines = [json.dumps({"type": "Feature", "id": i, "properties": {"name": f"n{i}"}, "geometry": {"type": k, "coordinates": x}}) for i, (k, x) in enumerate(shapes)]
    lines += ['{"type":"Feature","id":3,"properties":{"name":"none"},"geometry":null}', '{"type":"Other","id":4}']
    (tmp_path / "f.json").write_text("\n".join(lines))
    out = readers.geojson_features(spark, str(tmp_path), "name string", title_field="name").orderBy("id").collect()
    assert [(r.minx, r.miny, r.maxx, r.maxy) for r in out] == [(1, 2, 1, 2), (10, -5, 11, -4), (-7.5, 0, 4, 10), (None,) * 4] and [r.title for r in out] == ["n0", "n1", "n2", "none"]


def test_queryables_that_are_null(spark):
    from quillon.operators import catalog

    bodies = ['{"components":{"schemas":{"queryables":null}}}', '{"components":{"schemas":{}}}', '{"queryables":1}', None]
    out = catalog.correct_queryables(spark.createDataFrame([(b,) for b in bodies], "body string"), '{"type":"object"}').collect()
    assert [(r.body, r.corrected) for r in out] == [('{"components":{"schemas":{"queryables":{"type":"object"}}}}', True)] + [(b, False) for b in bodies[1:]]


def test_audience_as_text(spark):
    df = spark.createDataFrame([("x",), ('["x","y"]',), ("",), (None,), (" ",)], "aud string")
    assert [r.x for r in df.select(a.audience_list().alias("x")).collect()] == [["x"], ["x", "y"], None, None, None]


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.5, 3.0)], "id long, name string, lon double, lat double")
    assert json.loads(sinks.geojson(df, ["name"]).first().value) == {"type": "Feature", "id": 1, "properties": {"name": None}, "geometry": {"type": "Point", "coordinates": [2.5, 3.0]}}


def test_claims(spark):
    rows = [(["a", "x"], None, "i", 9), (None, "a", "i", 9), (None, None, "i", 9), (["b"], "a", "i", 9), (["a"], None, "j", 9), (["a"], None, None, 9), (["a"], None, "i", 1), ([], "", "i", 9)]
    df = spark.createDataFrame(rows, "aud array<string>, client_id string, iss string, exp long")
    found = [r.x for r in df.select(a.token_reason("a", "i", 5).alias("x")).collect()]
    assert found == ["ok", "ok", "missing_audience", "wrong_audience", "wrong_issuer", "missing_issuer", "expired", "missing_audience"]
    assert df.select(F.count_if(a.token_reason(None, None, 0) == "ok")).first()[0] == len(rows)


def test_policy_rules_may_overlap(spark):
    rules = spark.createDataFrame([("GET", "c", None, None, 1), (None, "c", None, "o", None), ("GET", "", None, None, 0)], "method string, p0 string, p1 string, company string, depth int")
    req = spark.createDataFrame([(1, "GET", "/c", "o"), (2, "GET", "/c/x", None), (3, "PUT", "/c/x", "o"), (4, "GET", "/", None), (5, "GET", "/z", "o")], "id int, method string, path string, company string")
    assert {r.id: (r.allowed, r.status) for r in a.policy(req, rules).collect()} == {1: (True, 200), 2: (False, 401), 3: (True, 200), 4: (True, 200), 5: (False, 401)}


def test_policy_of_many_open_rules(spark):
    """Rules with and without a first part, none of which is gathered with others: one pass without a shuffle."""
    rules = spark.range(100_000).selectExpr("if(id % 2 = 0, 'GET', null) AS method", "if(id % 3 = 0, null, 'collections') AS p0", "concat('c', id) AS p1", "if(id % 5 = 0, 'acme', null) AS company", "if(id % 7 = 0, 2, null) AS depth")
    asked = [("GET", "/collections/c1", None), ("POST", "/collections/c2", None), ("GET", "/jobs/c3", None), ("GET", "/jobs/c4", None), ("GET", "/collections/c5", "acme"), ("GET", "/collections/c5", None),
             ("GET", "/x/c21", None), ("GET", "/x/c21/y", None), (None, "/collections/c99999", None), ("GET", "/", None), ("GET", None, None), (None, None, None), ("GET", "/collections/c100000", "acme")]
    out = a.policy(spark.createDataFrame(asked, "method string, path string, company string"), rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(_is" not in plan
    assert [r.allowed for r in out.collect()] == [True, False, True, False, True, False, True, False, True, False, False, False, False]
    one = spark.createDataFrame([(None, None, None, None, 0)], "method string, p0 string, p1 string, company string, depth int")
    assert [r.allowed for r in a.policy(spark.createDataFrame(asked, "method string, path string, company string"), one).collect()].count(True) == 1
    every = one.withColumn("depth", F.lit(None).cast("int"))
    assert all(r.allowed and r.status == 200 for r in a.policy(spark.createDataFrame(asked, "method string, path string, company string"), every).collect())
    assert not any(r.allowed for r in a.policy(spark.createDataFrame(asked, "method string, path string, company string"), one.limit(0)).collect())


def test_inline_takes_documents_once(spark, monkeypatch):
    """Many documents that refer to a chain of fragments: what the rounds write depends on the fragments alone."""
    rows, write = {}, g.materialise

    def counted(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(g, "materialise", counted)
    docs = {f"http://h/f{i}": {"p": {"$ref": f"f{i + 1}#/p"}} for i in range(3)} | {"http://h/f3": {"p": 5}} | {f"http://h/d{i}": {"a": {"$ref": "f1#/p"}, "b": [{"$ref": "f2#/p"}]} for i in range(200)}
    out = {r.url: json.loads(r.resolved) for r in g.inline(spark.createDataFrame([(u, json.dumps(b)) for u, b in docs.items()], "url string, body string")).collect()}
    assert len(out) == 204 and all(out[f"http://h/d{i}"] == {"a": 5, "b": [5]} for i in range(200)) and out["http://h/f0"] == {"p": 5}
    assert rows.pop("inline") == 204 and max(rows.values()) < 10
