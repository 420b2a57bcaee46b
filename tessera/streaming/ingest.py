"""Streams: idempotent ingest by batches, windowed metrics, bounded conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_metrics(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and summed value by window and type; a timestamp without zone is cast, as a watermark needs one."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result as a written table.

    Every batch has its own folder, so a batch that is run again replaces itself: complete
    results are the last folder, appended ones all of them.
    """
    spark = stream.sparkSession
    out = f"{checkpoint}-out"
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([f"{out}/batch={last[-1]}"] if mode == "complete" else [f"{out}/batch={n}" for n in last]))


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished entries of a folder of the target's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [x.getPath().getName() for x in fs.listStatus(path)]
    return [n for n in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def manifest(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """bucket -> version of the newest finished manifest (of a batch before ``below``); at most as many entries as buckets."""
    versions = [int(n) for n in _names(spark, f"{target}/manifest")]
    versions = [v for v in versions if below is None or v < below]
    return {r.bucket: r.version for r in spark.read.json(f"{target}/manifest/{max(versions)}", "bucket int, version int").collect()} if versions else {}


def read_upserted(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table as the newest finished manifest has it."""
    paths = [f"{target}/data/v{v}/bucket={b}" for b, v in sorted(manifest(spark, target).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64) -> None:
    """Each batch replaces rows of the target by key, the last by ``order``; a repeated batch changes nothing.

    Rows lie in buckets by a hash of their key. A batch reads and writes only the buckets it
    touches, as a new version of each, and then a manifest that names the version of every
    bucket; readers follow the newest finished manifest, so a lost batch leaves the table as it was.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        have = manifest(spark, target, number)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        paths = [f"{target}/data/v{have[b]}/bucket={b}" for b in touched if b in have]
        rows = batch.unionByName(spark.read.schema(schema).parquet(*paths)) if paths else batch
        out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(*keys, "s.*")
        out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/v{number}")
        new = have | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(new.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{target}/manifest/{number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def carry_state(turns: DataFrame, memory: int = 8) -> DataFrame:
    """The streaming twin of carry-forward: state is the newest ``memory`` remembered (entity, period) pairs of a conversation.

    The turns of a conversation that arrive in one trigger are put in order together; later triggers go on from there.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        seen = [tuple(x.split("\x1f")) for x in seen]
        parts = list(batches)
        if parts:
            rows = []
            for r in pd.concat(parts).sort_values("turn").itertuples():
                e = r.entity or next((s[0] for s in reversed(seen) if s[0]), None)
                p = r.period or next((s[1] for s in reversed(seen) if s[1]), None)
                rows.append((key[0], r.turn, e, p))
                if r.remembered:
                    seen = [*seen, (e or "", p or "")][-memory:]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "entity", "period"])
        state.update((["\x1f".join(s) for s in seen],))

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, entity string, period string", "seen array<string>", "append", "NoTimeout")
