import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import features as f
from quillon.sources import readers

#: Five observations that the expected results are stated for.
OBS = [(371, 35, "2001-10-30T14:24:55Z", 89.9, 45.0, -75.0), (377, 35, "2002-10-30T18:31:38Z", 93.9, 45.0, -75.0), (238, 2147, "2007-10-30T08:57:29Z", 103.5, 43.0, -79.0),
       (297, 2147, "2003-10-30T07:37:29Z", 93.5, 43.0, -79.0), (964, 604, "2000-10-30T18:24:39Z", 99.9, 49.0, -122.0)]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(OBS, "id long, stn_id long, t string, value double, lat double, lon double").withColumn("ts", F.to_timestamp("t")).drop("t")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_interval_matches_one(obs):
    assert ids(f.datetime_filter(obs, "2003-10-30/2003-10-31")) == [297]
    assert ids(f.datetime_filter(obs, "../2001-12-31")) == [371, 964]
    assert ids(f.datetime_filter(obs, "2000-10-30T18:24:39Z")) == [964]


@pytest.mark.parametrize("text", ["999999999999999999999999999999", "2024-13-45", "a/b/c", "", "2005-01-01/2004-01-01", "99999-01-01/.."])
def test_bad_datetime_is_a_value_error(text):
    with pytest.raises(ValueError):
        f.parse_datetime(text)


def test_bbox(obs):
    assert ids(f.bbox_filter(obs, [-80, 43, -75, 45])) == [238, 297, 371, 377]
    assert ids(f.bbox_filter(obs, [170, 0, -100, 90])) == [964]
    with pytest.raises(ValueError):
        f.bbox_filter(obs, "-80,43,-75,45")


def test_projection_and_paging_do_not_change_the_count(obs):
    one = f.ItemsQuery(bbox=(-130, 40, -70, 50), limit=2).items(obs).collect()
    two = f.ItemsQuery(bbox=(-130, 40, -70, 50), limit=2, offset=2, properties=["value"]).items(obs).collect()
    assert {r.number_matched for r in one + two} == {5} and [r.id for r in one] == [238, 297] and [r.id for r in two] == [371, 377]
    assert ids(f.page(obs, limit=1000)) == sorted(r[0] for r in OBS)
    assert f.page(obs.limit(0)).count() == 0


def test_filters_name_queryables_only(obs):
    names = ["stn_id", "value"]
    assert ids(f.predicate(obs, "value > 93.6 AND stn_id = 35", names)) == [377]
    for bad in ("lon > 1", "value >", "nothing = 1"):
        with pytest.raises(ValueError):
            f.predicate(obs, bad, names)
    with pytest.raises(ValueError):
        f.equals(obs, "lat", 45, names)


def test_replace_and_delete(obs):
    changed = obs.where("id = 371").withColumn("value", F.lit(1.0)).unionByName(obs.where("id = 377").withColumn("id", F.lit(1).cast("long")))
    out = f.replace(obs, changed)
    assert ids(out) == [1, 238, 297, 371, 377, 964] and out.where("id = 371").first().value == 1.0
    assert ids(f.delete(out, changed)) == [238, 297, 377, 964]


def _scanned(df):
    """Files that the scan of an executed plan read."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_boxes_over_a_clustered_table(spark, tmp_path):
    random.seed(4)
    rows = [(i, random.uniform(-180, 180), random.uniform(-90, 90)) for i in range(3000)] + [(5000, 180.0, 90.0), (5001, -180.0, -90.0), (5002, 0.0, 0.0), (5003, 45.0, 22.5), (5004, None, 1.0), (5005, 200.0, -95.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    path = str(tmp_path / "clustered")
    f.write_clustered(df, path)
    table = spark.read.parquet(path)
    every = _scanned(table)
    assert every >= 60
    for box in ((-90, -45, 90, 45), (10, 10, 12, 12), (45, 22.5, 45, 22.5), (170, -10, -170, 10), (-180, -90, 180, 90), (175, -100, 210, -80), (0, 0, 0, 0)):
        found = f.bbox_of_clustered(table, box)
        assert found.columns == df.columns and sorted(r.id for r in found.collect()) == sorted(r.id for r in f.bbox_filter(df, box).collect())
    assert _scanned(f.bbox_of_clustered(table, (10, 10, 12, 12))) <= 2 and _scanned(f.bbox_of_clustered(table, (-90, -45, 0, 0))) < 0.3 * every
    assert f.cell_ranges((-180, -90, 180, 90), 5) == [(0, 1023)]


def test_pages_of_any_depth(spark):
    rows = [(i * 7 % 2003,) for i in range(2003)] + [(5,)] * 300 + [(None,)] * 30
    df = spark.createDataFrame(rows, "id long").repartition(3)
    ordered = sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    index = f.PageIndex(df, ranges=12)
    ranges = index.ranges.orderBy("before").collect()
    assert 4 < len(ranges) and sum(r.n for r in ranges) == len(rows)
    for limit, offset in ((None, 0), (50, 20), (5, 28), (50, 320), (50, 2000), (50, 2310), (10, 5000)):
        assert [r.id for r in index.page(limit, offset).collect()] == ordered[offset: offset + (limit or 20)]
    deep = index.page(50, 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(id" in deep and "Offset 2000" not in deep
    assert f.PageIndex(df.limit(0)).page(5, 0).collect() == []


def test_one_collection_is_read_in_splits(spark, tmp_path):
    random.seed(6)
    text = ['a}b', '{"', "\\", '"features":[{', "}}", "plain", "é{", "line\nend", "\\\""]
    features = [{"type": "Feature", "id": i, "properties": {"name": random.choice(text) + str(i), "features": [{"x": {"y": i}}]} if i % 3 else {"name": random.choice(text)},
                 "geometry": {"type": "Point", "coordinates": [i / 10, -i / 10, 5]} if i % 5 else None} for i in range(1500)]
    head = {"type": "FeatureCollection", "name": 'with "quotes" and {braces}', "crs": {"type": "name", "properties": {"name": "urn"}}}
    spaced = json.dumps(head | {"features": features, "links": [{"rel": "self"}]}, indent=1)
    flat = json.dumps({"type": "FeatureCollection", "features": features[:40]}, separators=(",", ":"))
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "one.json").write_text(spaced)
    (tmp_path / "big" / "two.json").write_text(flat)
    read = lambda **how: sorted(map(str, readers.geojson_features(spark, str(tmp_path / "big"), "name string", **how).drop("geometry").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert spark.read.text(str(tmp_path / "big" / "one.json"), lineSep="}").rdd.getNumPartitions() > 5
        found = read(split=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 1540 and found == read(collection=True)
