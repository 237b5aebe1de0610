from pyspark.sql import functions as F

from orebed.session import new_workspace
from orebed.specs import TEAMS
from orebed.streaming.dedupe import append_available, dedupe_stream, stream_bronze, stream_layer

SCHEMA = "event_id bigint, ts timestamp, v string"


def rows(spark, *data):
    df = spark.createDataFrame(data, "event_id bigint, ts string, v string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


class Feed:
    """A folder that grows, and a stream over it that is run to its end on demand."""

    def __init__(self, spark, delay, **options):
        self.spark, self.delay, self.options = spark, delay, options
        self.root = new_workspace(spark, "stream")

    def arrive(self, df):
        df.write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        schema = self.spark.createDataFrame([], SCHEMA).schema
        stream = stream_layer(self.spark, f"{self.root}/in", schema)
        unique = dedupe_stream(stream, "event_id", F.col("ts"), self.delay, **self.options)
        append_available(unique, f"{self.root}/out", f"{self.root}/progress").awaitTermination()
        stored = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/out")
        return sorted(stored.collect(), key=lambda r: r.event_id)


def test_copies_within_and_across_runs(spark):
    feed = Feed(spark, "1 day")
    feed.arrive(rows(spark, *[(1, "2024-01-01 00:00:00", "a")] * 500, (2, "2024-01-01 01:00:00", "b")))
    assert [r.event_id for r in feed.run()] == [1, 2]
    # Nothing new: the same state. Then copies of old events, and a new one.
    assert [r.event_id for r in feed.run()] == [1, 2]
    feed.arrive(rows(spark, (1, "2024-01-01 00:00:00", "a"), (3, "2024-01-01 02:00:00", "c")))
    result = feed.run()
    assert [(r.event_id, r.v) for r in result] == [(1, "a"), (2, "b"), (3, "c")]
    assert result[0].asDict().keys() == {"event_id", "ts", "v"}


def test_watermark_drops_late_rows(spark):
    feed = Feed(spark, "1 hour", spread=2)
    feed.arrive(rows(spark, (1, "2024-01-01 00:00:00", "a")))
    feed.run()
    feed.arrive(rows(spark, (2, "2024-01-05 00:00:00", "b")))
    feed.run()
    feed.arrive(rows(spark, (3, "2024-01-01 00:00:00", "late"), (4, "2024-01-05 00:30:00", "d")))
    assert [r.event_id for r in feed.run()] == [1, 2, 4]


def test_bronze_stream(spark):
    root = new_workspace(spark, "stream")

    def arrive(*lines):
        df = spark.createDataFrame([(line,) for line in lines], "value string")
        df.write.mode("append").text(f"{root}/in")

    def run():
        stream = stream_bronze(spark, TEAMS, f"{root}/in").withColumn("at", F.lit("2024-01-01"))
        unique = dedupe_stream(stream, "team_id", F.col("at").cast("timestamp"), "1 day").drop("at")
        append_available(unique, f"{root}/out", f"{root}/progress").awaitTermination()
        stored = spark.read.parquet(f"{root}/out")
        assert stored.columns == TEAMS.columns
        return sorted((r.team_id, r.team_name) for r in stored.collect())

    arrive('{"teams":[{"idTeam":"1","strTeam":"a"},{"idTeam":"1","strTeam":"a"}]}', "broken{")
    assert run() == [("1", "a")]
    arrive('{"teams":[{"idTeam":"1","strTeam":"a"},{"idTeam":"2"}]}', '{"message":"x"}')
    assert run() == [("1", "a"), ("2", None)]


def test_delivery_separates_copies(spark):
    path = new_workspace(spark, "stream")
    rows(spark, *[(1, "2024-01-01 00:00:00", "a")] * 64).coalesce(1).write.parquet(path)
    stored = spark.read.schema(SCHEMA).parquet(path)
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    assert stored.select(place.alias("p")).distinct().count() == 64


def test_rows_without_a_key_are_kept(spark):
    """51 rows, of which one is a copy, without a key."""
    feed = Feed(spark, "1 day")
    keyless = [(None, "2024-01-01 00:00:00", f"v{k}") for k in range(50)]
    feed.arrive(rows(spark, *keyless, keyless[0], (1, "2024-01-01 00:00:00", "a")).coalesce(1))
    stream = stream_layer(spark, f"{feed.root}/in", spark.createDataFrame([], SCHEMA).schema)
    unique = dedupe_stream(stream, "event_id", F.col("ts"), "1 day")
    append_available(unique, f"{feed.root}/out", f"{feed.root}/progress").awaitTermination()
    stored = spark.read.schema(SCHEMA).parquet(f"{feed.root}/out")
    assert stored.where("event_id IS NULL").count() == 50 and stored.count() == 51
