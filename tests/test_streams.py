"""The guard and the sources as streams: equal to the batch rule after shuffles, restarts and killed runs."""

import json
import os
import random

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.sources import feeds, listings
from factloom.streaming import backfill, guard, heads

WRITE = "seq long, op string, subject long, predicate string, object string, valid_from long, valid_to long"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    guard.state_in_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drained(frame, path, checkpoint):
    q = heads.ingest(frame, path, checkpoint)
    q.awaitTermination()
    return q


@pytest.mark.parametrize("seed", [1, 2])
def test_guard_is_the_batch_rule_for_shuffled_arrivals_and_restarts(spark, tmp_path, rocksdb, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["assert", "assert", "close"]), r.randrange(6), r.choice("pq"), r.choice("abc"), r.choice([None, *range(8)]), r.choice([None, None, 9])) for k in range(80)]
    rows += [(100 + k, *r.choice(rows)[1:]) for k in range(25)]  # repeats
    r.shuffle(rows)
    src = str(tmp_path / "in")
    for k, part in enumerate((rows[:40], rows[40:60], rows[60:])):
        spark.createDataFrame(part, WRITE).coalesce(1).write.mode("append").parquet(src)
        if k != 1:  # two files at once, then another run over the third
            drained(guard.guarded(spark.readStream.schema(WRITE).option("maxFilesPerTrigger", 1).parquet(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    made = spark.read.parquet(str(tmp_path / "out"))
    values = lambda head: {(x["subject"], x["predicate"]): (x["op"], x["object"] if x["op"] == "assert" else None) for x in head.collect()}
    want = values(facts.guarded_head(spark.createDataFrame(rows, WRITE)))
    assert values(facts.raw_head(guard.log_of(made))) == want
    n = {x["kind"]: x["n"] for x in made.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert n["write"] + n["suppressed"] == len(rows) and n["suppressed"] > 0 and n["repair"] > 0


def issues(path, fail=None):
    """A recorded source: events by number; it breaks at one number while the file ``fail`` is there."""

    def between(options, low, high):
        rows = ds.dataset(path).to_table(columns=["event_id", "event_type"], filter=(ds.field("event_id") > low) & (ds.field("event_id") <= high)).to_pylist()
        for x in [*rows, *rows[:2]]:  # some of them twice
            if fail and os.path.exists(fail) and x["event_id"] == 700:
                raise RuntimeError("gone away")
            yield x["event_id"], x["event_type"]

    newest = lambda options: int(options["upto"])
    return feeds.numbered("issues", "event long, value string", newest, between)


def test_a_numbered_source_is_read_exactly_once_across_a_killed_run(spark, sf_dir, tmp_path):
    fail, path, checkpoint = str(tmp_path / "fail"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.dataSource.register(issues(f"{sf_dir}/events.parquet", fail))
    stream = lambda to: spark.readStream.format("issues").option("after", "0").option("upTo", str(to)).load()
    drained(stream(250), path, checkpoint)
    assert spark.read.parquet(path).count() == 250
    open(fail, "w").close()
    with pytest.raises(Exception, match="gone away"):
        drained(stream(999), path, checkpoint)
    assert spark.read.parquet(path).count() == 250  # nothing of the killed run is seen
    os.remove(fail)
    drained(stream(999), path, checkpoint)
    want = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id between 1 and 999").select(F.col("event_id").alias("event"), F.col("event_type").alias("value"))
    got = spark.read.parquet(path)
    assert got.count() == 999 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parts_of_a_range_are_whole_and_apart():
    reader = issues("none")({"upto": "950", "after": "3"}).streamReader(None)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert (parts[0].low, parts[-1].high, len(parts)) == (3, 950, 10) and all(a.high == b.low for a, b in zip(parts, parts[1:]))


def changes(path):
    """A feed of pages of two changes, whose tokens are places in a recorded file."""

    def page(options, token):
        with open(path) as f:
            rows = [json.loads(x) for x in f]
        at = int(token[1:])
        some = [(at + k + 1, json.dumps(x)) for k, x in enumerate(rows[at : at + 2])]
        return some, (f"t{at + 2}" if len(rows) > at + 2 else None), f"t{len(rows)}"

    def first(options):
        with open(path) as f:
            return f"t{len(f.readlines())}"

    return feeds.paged("changes", "event long, value string", first, page)


def test_a_change_during_the_walk_is_neither_lost_nor_doubled(spark, tmp_path):
    """The token is taken before the walk; what changes meanwhile is in both, and counts once."""
    feed, folder = str(tmp_path / "feed.json"), str(tmp_path / "state")
    write = lambda *xs: open(feed, "a").writelines(json.dumps(x) + "\n" for x in xs)
    write(*[{"id": f"f{k}", "v": 0} for k in range(3)])  # before anything began
    spark.dataSource.register(changes(feed))
    taken = []

    def token():
        taken.append(1)
        with open(feed) as f:
            return f"t{len(f.readlines())}"

    def walk():
        write({"id": "f1", "v": 1}, {"id": "f3", "v": 1})  # while it walks: f1 is listed with its change, f3 isn't listed yet
        return spark.createDataFrame([(0, json.dumps({"id": f"f{k}", "v": int(k == 1)})) for k in range(3)], "event long, value string")

    def run():
        start = backfill.start_token(spark, folder, token)
        stream = spark.readStream.format("changes").option("token", start).load()
        drained(backfill.snapshot_then(spark, folder, walk, stream), str(tmp_path / "out"), str(tmp_path / "ck"))

    run()
    write({"id": "f0", "v": 2}, {"id": "f1", "v": 2}, {"id": "f0", "v": 3})
    run()
    assert len(taken) == 1
    seen = spark.read.parquet(str(tmp_path / "out"))
    state = backfill.latest(seen.select("event", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.v").alias("v")), "id")
    assert {r["id"]: r["v"] for r in state.collect()} == {"f0": "3", "f1": "2", "f2": "0", "f3": "1"}
    assert seen.count() == 3 + 5 and seen.select("event", "value").distinct().count() == 8


def test_readers_see_whole_batches_and_a_reset_is_one(spark, tmp_path):
    src, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck")
    batch = lambda rows: spark.createDataFrame(rows, WRITE).coalesce(1).write.mode("append").parquet(src)
    one = lambda seq, op="assert", subject=1: (seq, op, subject, "p", "x", seq, None)
    stream = lambda: spark.readStream.schema(WRITE).parquet(src)
    batch([one(1), one(2)])
    drained(stream(), path, checkpoint)
    drained(stream(), path, checkpoint)  # again: nothing new
    assert heads.read_log(spark, path).count() == 2
    spark.createDataFrame([one(3)], WRITE).write.parquet(f"{path}/stray")  # files that no batch committed aren't read
    batch([one(5), *[(x["seq"], x["op"], None, None, None, None, None) for x in [heads.reset_item(4, confirm=True)]]])
    drained(stream(), path, checkpoint)
    assert [r["seq"] for r in heads.read_log(spark, path).collect()] == [5]
    with pytest.raises(ValueError, match="confirm"):
        heads.reset_item(9, confirm=False)


def test_listings_and_feeds_tell_the_same(spark):
    rows = spark.createDataFrame([("s", k, 1) for k in range(1, 251)], "scope string, id long, type int")
    cursors = spark.createDataFrame([("s", 30)], "scope string, cursor long")
    cycle = listings.polled(rows, cursors)
    assert cycle.count() == 100 and listings.next_cursors(cycle, cursors).first()["cursor"] == 130
