"""Run a streaming query to completion over what is available and read the
result back as a batch DataFrame.

Each micro-batch is written by ``foreachBatch`` to its own folder named by
the batch id with ``overwrite``, so a replayed batch (after a failure)
rewrites the same folder instead of appending twice; the checkpoint
location lives in the shared folder, so a restarted query resumes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import scratch_path


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on the executors' disks, with changes in the checkpoint
    folder, as stateful processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def split_sink(split: Callable[[DataFrame], dict[str, DataFrame]], out: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes the parts of a micro-batch side by side, each to the folder of its name and
    batch id.  The parts come from one reading of the batch; a replayed batch overwrites its own folders, whatever
    part it had reached."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, part in split(held).items():
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            held.unpersist()
    return sink


def run_split(stream: DataFrame, name: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Run a stream over what is available, its micro-batches split into several sinks; the parts by name."""
    spark = stream.sparkSession
    root = scratch_path(spark, f"stream-{name}")
    schemas = {part: df.schema for part, df in split(spark.createDataFrame([], stream.schema)).items()}
    q = (stream.writeStream.foreachBatch(split_sink(split, f"{root}/out"))
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    out = {}
    for part, schema in schemas.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out/{part}")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        out[part] = (spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())]))
                     .parquet(f"{root}/out/{part}").drop("batch_id") if there else spark.createDataFrame([], schema))
    return out


def run_available(stream: DataFrame, name: str, output_mode: str = "append",
                  options: dict | None = None) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    root = scratch_path(spark, f"stream-{name}")
    out = f"{root}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True))
    for k, v in (options or {}).items():
        w = w.option(k, v)
    with keyed_state(spark):
        q = w.start()
        q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = StructType(list(stream.schema.fields) + [StructField("batch_id", IntegerType())])
    result = spark.read.schema(schema).parquet(out)
    if output_mode == "complete":
        # every batch holds the whole table: keep the last one
        last = result.agg({"batch_id": "max"}).first()[0]
        result = result.where(result.batch_id == last)
    return result.drop("batch_id")
