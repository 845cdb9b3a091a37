"""Structured Streaming jobs. Each gives the rows of its batch counterpart once the same input has passed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from ..sources.keyed import remove
from ..sources.tables import overwrite, scratch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder or of one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else reader.option("pathGlobFilter", name).parquet(folder)


def once_per_day(posts: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key and day; state is dropped once the watermark has passed."""
    dated = posts.withColumn("day", F.to_date(time)).withWatermark(time, delay)
    return dated.dropDuplicatesWithinWatermark([*keys, "day"])


def seen_dates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last seen date by key (update or complete mode)."""
    return rows.groupBy(*keys).agg(F.min("observed_date").alias("first_seen_date"), F.max("observed_date").alias("last_seen_date"))


def engagement_days(posts: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """One snapshot per post and day window: the highest id's likes."""
    w = F.window(time, "1 day")
    return posts.withWatermark(time, delay).groupBy(w, "post_url").agg(F.max_by("likes", "observation_id").alias("likes"), F.count("*").alias("n"))


def weekly_counts(rows: DataFrame, time: str, kind: str, delay: str = "7 days") -> DataFrame:
    """Counts by Monday week and kind."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, "7 days", startTime="4 days"), kind).agg(F.count("*").alias("n"))


MOVEMENT = StructType([
    StructField("identity", StringType()), StructField("previous_date", DateType()), StructField("observed_date", DateType()),
    StructField("previous_price", DoubleType()), StructField("current_price", DoubleType()), StructField("late_rows", LongType()),
])


class LastPrice(StatefulProcessor):
    """State: last day, its highest id and price, and the price of the day before. Rows older than the state are counted, not applied."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("day", DateType()), StructField("id", LongType()), StructField("price", DoubleType()),
            StructField("before_day", DateType()), StructField("before", DoubleType()), StructField("late", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        day, top, price, before_day, before, late = self.last.get() if self.last.exists() else (None, None, None, None, None, 0)
        frame = pd.concat(list(rows)).sort_values(["observed_date", "observation_id"])
        out = []
        for d, i, p in zip(frame["observed_date"], frame["observation_id"], frame["price_kes"], strict=True):
            if day is not None and d < day:
                late += 1
                continue
            if day is None or d > day:
                before_day, before = day, price
                day, top, price = d, i, p
            elif i >= top:
                top, price = i, p
                if out and out[-1][2] == d:
                    out.pop()
            if before is not None and before != price and (not out or out[-1][2] != d):
                out.append((key[0], before_day, d, before, price, late))
        self.last.update((day, top, price, before_day, before, late))
        if out:
            yield pd.DataFrame(out, columns=MOVEMENT.names)

    def close(self) -> None:
        pass


class state_store:
    """The RocksDB state store, which arbitrary state needs, for the time of one stream."""

    KEY, VALUE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.old = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, self.VALUE)

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.old) if self.old else self.conf.unset(self.KEY)


def live_movements(prices: DataFrame) -> DataFrame:
    """Price movements as rows arrive in date order by batch; prices has identity, observation_id, price_kes, observed_date."""
    return prices.groupBy("identity").transformWithStateInPandas(LastPrice(), MOVEMENT, "update", "none")


#: Buckets of the state by identity, and epochs after which a whole version of it is written.
BUCKETS, WHOLE_EVERY = 16, 8


def newest(state: DataFrame) -> DataFrame:
    """The rows of each identity's last epoch."""
    return state.withColumn("_last", F.max("epoch").over(W.partitionBy("identity"))).where("epoch = _last").drop("_last")


def movements_by_batch(
    prices: DataFrame, label: str = "movements", path: str | None = None, buckets: int = BUCKETS, whole_every: int = WHOLE_EVERY
) -> tuple[DataFrame, DataFrame]:
    """Price movements of a stream without a Python call per key: (movements, late rows) after all input has passed.

    State is the last two days of each identity, as a log: an epoch writes the identities of its batch alone, by bucket, and
    every whole_every-th epoch writes all of it, after which older versions are removed. A batch reads the buckets that its
    identities fall in, from the last whole version on, once: what it asks for is written aside. Rows older than the last day are set aside as late. A day that
    changes again (a higher id on the same day) replaces its movement, by epoch. With a path of its own the job goes on
    where it stopped: an epoch that is run again reads what came before it and overwrites what it wrote.
    """
    spark, path = prices.sparkSession, path or scratch(prices.sparkSession, label)
    columns = ["identity", "observed_date", "observation_id", "price_kes"]
    kept = prices.select(*columns).schema
    bucket = F.pmod(F.xxhash64("identity"), F.lit(buckets)).cast("int")
    spark.createDataFrame([], kept).write.mode("ignore").parquet(f"{path}/late/epoch=-1")  # so that the folders can be read before the first epoch has ended
    spark.createDataFrame([], kept).write.mode("ignore").parquet(f"{path}/state/whole=1/epoch=-1/bucket=0")

    def step(batch: DataFrame, epoch: int) -> None:
        before = spark.read.parquet(f"{path}/state").where(F.col("epoch") < epoch)
        versions = before.select("whole", "epoch").distinct().collect()
        base = max((v.epoch for v in versions if v.whole), default=-1)
        live = before.where(F.col("epoch") >= base)
        keyed = batch.select(*columns, bucket.alias("bucket"))
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most as many as buckets
        asked = keyed.select("identity").distinct()
        state = overwrite(newest(live.where(F.col("bucket").isin(touched)).join(asked, "identity", "left_semi")).select(*columns), f"{path}/asked")
        edge = state.groupBy("identity").agg(F.max("observed_date").alias("edge"))
        aged = keyed.select(*columns, F.lit(True).alias("fresh")).join(edge, "identity", "left")
        aged.where("observed_date < edge").select(*columns).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        new = aged.where("edge is null or observed_date >= edge").drop("edge").unionByName(state.withColumn("fresh", F.lit(False)))
        days = new.groupBy("identity", "observed_date").agg(F.max(F.struct("observation_id", "price_kes")).alias("r"), F.bool_or("fresh").alias("fresh"))
        w = W.partitionBy("identity").orderBy("observed_date")
        days = days.select("identity", "observed_date", "r.*", "fresh").withColumns({
            "previous_price": F.lag("price_kes").over(w), "previous_date": F.lag("observed_date").over(w),
            "last_two": F.lead(F.lit(1), 2).over(w).isNull(),
        })
        days.write.mode("overwrite").parquet(f"{path}/days/epoch={epoch}")
        done = spark.read.schema(days.schema).parquet(f"{path}/days/epoch={epoch}")
        changed = done.where("last_two").select(*columns)
        whole = int(epoch % whole_every == whole_every - 1)
        if whole:
            quiet = newest(live).join(done.select("identity").distinct(), "identity", "left_anti").select(*columns)
            changed = changed.unionByName(quiet)
        changed.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/whole={whole}/epoch={epoch}")
        for v in versions:  # no epoch from now on reads what lies before the last whole version
            if v.epoch < base:
                remove(spark, f"{path}/state/whole={v.whole}/epoch={v.epoch}")

    q = prices.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()
    late = spark.read.parquet(f"{path}/late").select(*columns)
    if spark.read.parquet(f"{path}/state").where("epoch >= 0").isEmpty():
        none = "identity string, previous_date date, observed_date date, previous_price double, current_price double"
        return spark.createDataFrame([], none), late
    days = spark.read.parquet(f"{path}/days").where("fresh and previous_price is not null")
    newest_day = days.groupBy("identity", "observed_date").agg(F.max_by(F.struct("previous_date", "previous_price", "price_kes"), "epoch").alias("r"))
    moved = newest_day.select("identity", "r.previous_date", "observed_date", "r.previous_price", F.col("r.price_kes").alias("current_price"))
    return moved.where("previous_price <> current_price"), late


def run_to_end(stream: DataFrame, mode: str = "append", label: str = "stream", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what the sink holds at the end.

    append goes to Parquet. complete keeps the table of the last two epochs and returns the last. update returns the last
    row of each key (keys), or every row that was emitted if there are no keys."""
    spark = stream.sparkSession
    path, state = scratch(spark, label), scratch(spark, f"{label}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        folder = epoch % 2 if mode == "complete" else epoch
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/part={folder:06d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    every = spark.read.parquet(path).drop("part")
    if mode == "complete":
        last = every.agg(F.max("epoch").alias("epoch"))
        return every.join(F.broadcast(last), "epoch").drop("epoch")  # one row
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")
    return every.drop("epoch")


#: Rows of one file of a time slice, from which on a slice has more files.
FILE_ROWS = 1_000_000


def deal_by_time(df: DataFrame, time: str, path: str, parts: int = 4, files: int = 4) -> tuple[str, int]:
    """Writes df in time slices, oldest first; (path, files of a slice): a stream of so many files a trigger takes the slices
    one by one. Slices of few rows are one file each, those of many rows have a file for FILE_ROWS of them."""
    cuts = df.agg(F.percentile_approx(F.unix_date(F.to_date(time)), [i / parts for i in range(1, parts)])).first()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.unix_date(F.to_date(time)))) if cuts else F.lit(0)
    counts = {r.place: r["count"] for r in df.groupBy(place.alias("place")).count().collect()}
    # dealt round robin, some input partition of a slice has a row for each file
    files = max(files, max(counts.values(), default=0) // FILE_ROWS)
    files = files if counts and min(counts.values()) >= files * df.rdd.getNumPartitions() else 1
    for i in range(parts):
        if counts.get(i):
            df.where(place == i).repartition(files).write.mode("append").parquet(path)
    if not counts:
        df.write.mode("append").parquet(path)
    return path, files
