"""Tables merged by key, and the streaming state's log."""

import datetime
import os

from pyspark.sql import functions as F

from marketloom.operators import dedup as D
from marketloom.sources import keyed as K
from marketloom.streaming import jobs as Z

DAY = datetime.date(2024, 1, 1)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def seen(spark, rows):
    return spark.createDataFrame([(k, DAY + datetime.timedelta(n)) for k, n in rows], "k string, observed_date date")


def test_merge_rewrites_changed_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    stored = seen(spark, [(f"k{i}", 5) for i in range(200)] + [(None, 5)]).select("k", F.col("observed_date").alias("first_seen_date"), F.col("observed_date").alias("last_seen_date"))
    table = K.create(stored, path, ["k"], 16)
    assert table.count() == 201
    merge = lambda a, b: D.upsert_seen(a, b, ["k"])
    batch = seen(spark, [("k1", 9), ("k1", 2), ("new", 7), (None, 8)])
    before = files(path)
    n = K.merge_into(path, batch, ["k"], merge, stored, 16)
    after = files(path)
    assert 1 <= n <= 3 and len({p for p in after if p not in before}) == n
    got = {r.k: ((r.first_seen_date - DAY).days, (r.last_seen_date - DAY).days) for r in K.read(spark, path, stored).collect()}
    assert got["k1"] == (2, 9) and got["new"] == (7, 7) and got[None] == (5, 8) and got["k2"] == (5, 5) and len(got) == 202
    assert K.merge_into(path, batch, ["k"], merge, stored, 16) == 0 and files(path) == after  # the same batch again
    assert K.merge_into(path, batch.limit(0), ["k"], merge, stored, 16) == 0


def feed(spark, path, rows):
    spark.createDataFrame(rows, "identity string, observed_date date, observation_id long, price_kes double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("identity string, observed_date date, observation_id long, price_kes double").option("maxFilesPerTrigger", 1).parquet(path)


def test_state_log_follows_the_batch_and_is_compacted(spark, tmp_path):
    path, job = str(tmp_path / "in"), str(tmp_path / "job")
    day = lambda n: DAY + datetime.timedelta(n)
    state = lambda: spark.read.parquet(f"{job}/state")
    feed(spark, path, [(f"i{k}", day(0), k, 1.0) for k in range(500)])
    for n in range(1, 11):
        s = feed(spark, path, [("i7", day(n), 1000 + n, 1.0 + n), (f"n{n}", day(n), 2000 + n, 1.0)])
        moved, late = Z.movements_by_batch(s, path=job, whole_every=4)
    by_epoch = {(r.whole, r.epoch): r["count"] for r in state().groupBy("whole", "epoch").count().collect()}
    # epochs 3 and 7 are whole, those before 7 are gone, and the others hold their batch's identities
    assert set(by_epoch) == {(1, 7), (0, 8), (0, 9), (0, 10)} and by_epoch[1, 7] == 508 and by_epoch[0, 9] == 3
    got = sorted((r.identity, (r.observed_date - DAY).days, r.previous_price, r.current_price) for r in moved.collect())
    assert got == [("i7", n, float(n), 1.0 + n) for n in range(1, 11)] and late.count() == 0


def test_slices_of_several_files_come_one_by_one(spark, tmp_path):
    df = spark.range(4000).select(F.date_add(F.lit(DAY), (F.col("id") % 40).cast("int")).alias("d"), "id").repartition(3)
    path, n = Z.deal_by_time(df, "d", str(tmp_path / "a"))
    assert n == 4 and len(files(path)) == 16
    seen = []
    s = spark.readStream.schema("d date, id long").option("maxFilesPerTrigger", n).parquet(path)
    q = s.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, e: seen.append(b.agg(F.min("d"), F.max("d")).first())).start()
    q.awaitTermination()
    assert len(seen) == 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert Z.deal_by_time(df.limit(3), "d", str(tmp_path / "b"))[1] == 1
    assert Z.deal_by_time(df.limit(0), "d", str(tmp_path / "e"))[1] == 1


def test_large_slices_have_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "FILE_ROWS", 100)
    df = spark.range(4000).select(F.date_add(F.lit(DAY), (F.col("id") % 40).cast("int")).alias("d"), "id").repartition(3)
    path, n = Z.deal_by_time(df, "d", str(tmp_path / "a"))
    assert n >= 9 and len(files(path)) == 4 * n


def test_a_batch_asks_the_state_once(spark, tmp_path):
    path, job = str(tmp_path / "in"), str(tmp_path / "job")
    feed(spark, path, [(f"i{k}", DAY, k, 1.0) for k in range(300)])
    s = feed(spark, path, [("i7", DAY + datetime.timedelta(3), 1000, 2.0), ("new", DAY, 1001, 1.0), ("i9", DAY - datetime.timedelta(1), 1002, 5.0)])
    moved, late = Z.movements_by_batch(s, path=job)
    assert sorted(r.identity for r in spark.read.parquet(f"{job}/asked").collect()) == ["i7", "i9"]
    assert [r.identity for r in moved.collect()] == ["i7"] and [r.observation_id for r in late.collect()] == [1002]
