"""Log sessions with state: the newest of each device, over restarts."""

from pyspark.sql import functions as F

from chromagrid.sources import catalogs
from chromagrid.streaming import logs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_newest_sessions_over_restarts_equal_the_batch(spark, sf_dir, tmp_path):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("device"), F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("session"), F.col("event_id").alias("at"))
        held = {}

        def keep(df, batch):
            for r in df.collect():
                held.setdefault(r.device, {}).setdefault(batch, []).append(r)

        for part in range(3):  # each run is a restart from the checkpoint
            e.where(F.floor(F.col("at") / 250) % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
            q = logs.newest_sessions(stream, 5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        want = catalogs.newest(e, "session", F.col("at"), 5, ["device"]).collect()
        got = [r for batches in held.values() for r in batches[max(batches)]]
        assert sorted((r.device, r.session, r.at, r["rank"]) for r in got) == sorted((r.device, r.session, r["at"], r["rank"]) for r in want)
        assert len(got) == 35 and max(len(b) for b in held.values()) == 3
    finally:
        spark.conf.set(PROVIDER, old)
