"""Capabilities of a stream of changes, after each batch, against the batch operators over what is there then."""
import random
import time

from quillon.operators import capabilities as c
from quillon.streaming import streams
from quillon.streaming.live import Live

SCHEMA = "service_id long, resource_id long, type string, provider_types array<string>"


def test_after_every_batch(spark, tmp_path):
    random.seed(9)
    classes = spark.createDataFrame([("feature", "f1"), ("feature", "f2"), ("record", "r1"), ("process", "p1"), ("items", "i1"), ("record", "f2")], "grp string, cls string")
    base, groups = spark.createDataFrame([("b1",)], "cls string"), {"feature": "items"}
    made = [(random.randrange(12), i, random.choice(["process", "collection", ""]), random.choice([["feature"], ["record"], ["feature", "record"], ["feature", "feature"], [], ["odd"]])) for i in range(60)]
    held, batches, spare = [], [], list(made)
    for _ in range(4):
        new, gone = [spare.pop() for _ in range(12)], random.sample(held, len(held) // 2)
        held = [r for r in held if r not in gone] + new
        batches.append(([(*r, "insert") for r in new] + [(*r, "delete") for r in gone], list(held)))
    batches.append(([(*r, "delete") for r in held] + [(None, 1, "", ["feature"], "insert"), (3, 1, "", ["feature"], "rename")], []))
    path = str(tmp_path / "changes")
    df = lambda rows: spark.createDataFrame(rows, SCHEMA + ", op string").coalesce(1)
    live = Live(df([]), classes, base, groups)
    for rows, _ in batches[:2]:
        df(rows).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = lambda: streams.read_parquet_stream(df([]), path, 1)
    live.run(stream())
    for rows, _ in batches[2:]:
        df(rows).write.mode("append").parquet(path)
        time.sleep(0.05)
    live.run(stream())  # goes on where it ended
    expected = spark.createDataFrame([("f1",), ("r1",)], "cls string")
    there = lambda x: sorted(map(str, x.collect()))
    before = None
    for n, (_, rows) in enumerate(batches):
        reg = spark.createDataFrame(rows, SCHEMA)
        pairs = c.with_base(reg, c.provider_classes(c.provider_rows(reg), classes, groups), base).distinct()
        assert there(live.roll_up(n)) == there(c.roll_up(pairs))
        assert there(live.missing(expected, n)) == there(c.missing(reg, expected, pairs))
        if before is not None:
            assert there(live.changes(n - 1, n)) == there(c.changes(before, pairs))
        before = pairs
    assert live.counts().count() == 0
