"""Streams give what batches give."""

import itertools
import random
import time

from pyspark.sql import functions as F

from gridtide.operators import rollup
from gridtide.operators import index as ix
from gridtide.streaming.ingest import in_order, ingest_batch, latest_definitions, reorder, stored_points, stream_rollups, timely
from gridtide.sources import metrics

_n = itertools.count()


def _wait(query, rows):
    """Until so many rows have come in. (A query with timeouts always has another batch to run, so there's no end to wait for.)"""
    for _ in range(600):
        if sum(p["numInputRows"] for p in query.recentProgress) >= rows:
            return
        if not query.isActive:
            raise query.exception()
        time.sleep(0.1)
    raise TimeoutError


def _play(spark, tmp_path, schema, batches, transform):
    """All rows that a stream of these batches, one file each, gives."""
    folder = tmp_path / f"in{next(_n)}"
    folder.mkdir()
    name = f"out{next(_n)}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(str(folder))
    query = transform(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    for i, rows in enumerate(batches):
        text = spark.createDataFrame(rows, schema).toJSON().collect()
        (folder / f"{i}.part").write_text("\n".join(text))
        (folder / f"{i}.part").rename(folder / f"{i}.json")
        _wait(query, sum(map(len, batches[: i + 1])))
    query.stop()
    return spark.table(name)


def test_rollups_equal_batch(spark, tmp_path):
    schema = "sid string, ts long, val double"
    rows = [("a", t, float(t % 7)) for t in range(1, 400, 3)] + [("b", t, 1.0) for t in range(5, 400, 50)]
    rows.sort(key=lambda r: r[1])
    end = [("a", 10_000, 0.0)]
    got = _play(spark, tmp_path, schema, [rows[:60], rows[60:], end, end], lambda s: stream_rollups(s, 120, "1 second")).collect()
    want = rollup.build(spark.createDataFrame(rows, schema), [120]).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want)
    assert {r.ts for r in want} == {120, 240, 360, 480}


def test_reorder(spark, tmp_path):
    schema = "sid string, interval int, ts long, val double"
    times = [10, 30, 20, 21, 50, 60, 9, 41, 100]
    first = [("s", 10, t, float(i)) for i, t in enumerate(times)]
    got = _play(spark, tmp_path, schema, [first[:4], first[4:]], lambda s: reorder(s, 3))
    # 21 is rounded up to 30, where there's a point; 9 is too old by then
    assert [(r.ts, r.val) for r in got.orderBy("ts").collect()] == [(10, 0.0), (20, 2.0), (30, 1.0), (50, 4.0), (60, 5.0)]
    again = _play(spark, tmp_path, schema, [first[:4], first[4:]], lambda s: reorder(s, 3, allow_update=True))
    assert [r.val for r in again.where("ts = 30").collect()] == [3.0]


def by_hand(points, window, allow_update):
    """The buffer, one point after the other."""
    held, top, out = {}, -1, []
    for t, v in points:
        slot = -(-t // 10) * 10
        if slot <= top - window * 10 or (slot in held and not allow_update):
            continue
        held[slot] = v
        top = max(top, slot)
        out += [(x, held.pop(x)) for x in sorted(held) if x <= top - window * 10]
    return sorted(out)


def test_reorder_equals_one_by_one(spark, tmp_path):
    schema = "sid string, interval int, ts long, val double"
    r = random.Random(4)
    times = [max(1, 5 * i + r.randint(-60, 60)) for i in range(200)]
    points = [("s", 10, t, float(i)) for i, t in enumerate(times)]
    for update in (False, True):
        got = _play(spark, tmp_path, schema, [points[:90], points[90:]], lambda s, u=update: reorder(s, 4, u)).collect()
        assert sorted((x.ts, x.val) for x in got) == by_hand([(t, v) for _, _, t, v in points], 4, update)


def test_idle_series_are_emitted_and_forgotten(spark, tmp_path):
    schema = "sid string, interval int, ts long, val double"
    first = [("s", 10, t, float(t)) for t in (10, 30, 20)]
    source = lambda s: reorder(s, 5, idle="1 second")
    folder, name = tmp_path / "idle", f"idle{next(_n)}"
    folder.mkdir()
    query = source(spark.readStream.schema(schema).option("pathGlobFilter", "*.json").json(str(folder))).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    for i, rows in enumerate((first, [("other", 10, 10, 1.0)])):
        (folder / f"{i}.part").write_text("\n".join(spark.createDataFrame(rows, schema).toJSON().collect()))
        (folder / f"{i}.part").rename(folder / f"{i}.json")
        _wait(query, 3 + i)
        time.sleep(5)
    query.stop()
    assert [(x.ts, x.val) for x in spark.table(name).where("sid = 's'").collect()] == [(10, 10.0), (20, 20.0), (30, 30.0)]


def test_in_order(spark, tmp_path):
    schema = "sid string, interval int, ts long, val double"
    rows = [("s", 10, t, float(i)) for i, t in enumerate([5, 12, 11, 40, 30, 41])]
    got = _play(spark, tmp_path, schema, [rows[:3], rows[3:]], lambda s: in_order(s))
    assert [(x.ts, x.val) for x in got.orderBy("ts").collect()] == [(10, 0.0), (20, 1.0), (40, 3.0), (50, 5.0)]


def test_timely(spark):
    rows = metrics.validated(metrics.synthetic(spark, 1, 10))
    got = timely(rows, future_tolerance=20, ingest_from={1: 30, 2: 99}, now=F.lit(60)).orderBy("time").collect()
    assert [x.reason for x in got] == ["before-ingest-from"] * 2 + [None] * 6 + ["too-far-ahead"] * 2


def test_ingest(spark, tmp_path):
    rows = metrics.synthetic(spark, 2, 5).unionByName(metrics.synthetic(spark, 1, 1).withColumn("name", F.lit("")))
    later = rows.withColumn("time", F.col("time") + 86400)
    paths = [str(tmp_path / x) for x in ("index", "store", "discarded")]
    for batch, part in ((0, rows), (1, later), (1, later)):  # the last is played again
        ingest_batch(part, batch, *paths)
    index, store, discarded = (spark.read.parquet(p) for p in paths)
    assert index.count() == 4
    assert latest_definitions(index).count() == 2
    assert {x.last_update for x in latest_definitions(index).collect()} == {86450}
    assert store.count() == 20
    assert discarded.count() == 2
    assert {r.reason for r in discarded.collect()} == {"invalid-name"}
    read = stored_points(spark, paths[1], 86400, 86430)
    assert read.count() == 6
    assert "day" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_control_and_rules(spark):
    defs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5)], "sid string, last_update long")
    messages = spark.createDataFrame([("a", 0, "delete"), ("b", 3, "add"), ("c", 2, "add"), ("d", 4, "add")], "sid string, last_update long, action string")
    assert sorted(map(tuple, ix.controlled(defs, messages).collect())) == [("b", 3), ("c", 5), ("d", 4)]
    rules = ix.upserted([], ["a=b", "c=d"], {"x": "1"})
    assert ix.upserted(rules, ["c=d", "a=b"], {"x": "2"}) == [(["a=b", "c=d"], {"x": "2"})]
    assert ix.upserted(rules, ["a=b", "c=d"], {}) == []
