"""Clouds and metrics as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pointlake.functions.geometry import NORMAL, XYZ
from pointlake.operators.normals import neighbour_scorer, pca_normals, refine_flips
from pointlake.plans.runs import epoch_rollup
from pointlake.session import cut

KNOWN_FUNCTIONS = ("direct_orientation",)


def validate_requests(points: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (cloud_id, data_size, function_name): status and message.

    A request whose points do not match the declared size is an error; an unknown function falls back to the
    default with a warning.
    """
    got = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("received"))
    r = requests.join(got, "cloud_id", "left").withColumn("received", F.coalesce("received", F.lit(0).cast("long")))
    size_ok = F.col("received") == F.col("data_size")
    known = F.col("function_name").isin(*KNOWN_FUNCTIONS)
    return r.select(
        "cloud_id", "data_size", "received",
        F.when(known, F.col("function_name")).otherwise(F.lit(KNOWN_FUNCTIONS[0])).alias("function_name"),
        F.when(~size_ok, F.lit("error")).when(~known, F.lit("warning")).otherwise(F.lit("ok")).alias("status"),
        F.when(~size_ok, F.lit("size mismatch")).when(~known, F.lit("unknown function")).otherwise(F.lit("")).alias("message"),
    )


def orient_batch(points: DataFrame, k: int = 10, refine_k: int = 6, rounds: int = 1) -> DataFrame:
    """What a micro-batch runs, identical for batch jobs: normals and sign refinement per cloud."""
    p = points.select("cloud_id", "point_id", *XYZ)
    n = p.join(pca_normals(p, k).select("cloud_id", "point_id", *NORMAL), ["cloud_id", "point_id"])
    return refine_flips(n, neighbour_scorer(n, refine_k), rounds)


def orient_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, files_per_batch: int = 4,
                  interval: str | None = "2 seconds", requests: DataFrame | None = None,
                  work: Callable[[DataFrame], DataFrame] = orient_batch) -> StreamingQuery:
    """Orient clouds whose Parquet files arrive in a folder, a few files per micro-batch.

    A cloud arrives within one file (``collect_stream`` puts clouds together). Results go to ``sink/batch=<id>`` by overwrite, so a repeated micro-batch
    replaces its own output; rejected requests go to ``sink_errors``. ``interval=None`` drains what is there.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        good = batch
        if requests is not None:
            checked = validate_requests(batch, requests.join(batch.select("cloud_id").distinct(), "cloud_id", "left_semi"))
            bad = checked.where("status = 'error'")
            bad.write.mode("overwrite").parquet(f"{sink}_errors/batch={batch_id}")
            good = batch.join(bad, "cloud_id", "left_anti")
        work(good).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def collect_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, requests: DataFrame, patience: int = 10,
                   files_per_batch: int = 4, interval: str | None = "2 seconds",
                   work: Callable[[DataFrame], DataFrame] = orient_batch) -> StreamingQuery:
    """Orient clouds that arrive in any number of files, each as soon as all the points its request declares are there.

    ``requests(cloud_id, data_size)``, one row per cloud. Points wait in ``sink_pending/batch=<id>``, the state that the next
    micro-batch starts from; results go to ``sink/batch=<id>``. Clouds without a request, with more points than declared, or
    still incomplete ``patience`` micro-batches after their first points go to ``sink_errors/batch=<id>``. All of these are
    written by overwrite, so a micro-batch that is repeated after a restart replaces its own output and state.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        held = batch.withColumn("_since", F.lit(batch_id).cast("long"))
        if batch_id > 0:
            held = spark.read.schema(held.schema).parquet(f"{sink}_pending/batch={batch_id - 1}").unionByName(held)
        held = cut(held)
        here = held.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("received"), F.min("_since").alias("_first"))
        state = cut(here.join(requests.select("cloud_id", "data_size"), "cloud_id", "left"))
        complete = F.col("received") == F.col("data_size")
        message = F.when(F.col("data_size").isNull(), "no request").when(F.col("received") > F.col("data_size"), "more points than declared")
        message = message.when(~complete & (F.lit(batch_id) - F.col("_first") >= patience), "incomplete")
        errors = state.withColumn("message", message).where("message IS NOT NULL")
        errors.select("cloud_id", "data_size", "received", "message").write.mode("overwrite").parquet(f"{sink}_errors/batch={batch_id}")
        ready = state.where(complete).select("cloud_id")
        gone = ready.unionByName(errors.select("cloud_id"))
        held.join(gone, "cloud_id", "left_anti").write.mode("overwrite").parquet(f"{sink}_pending/batch={batch_id}")
        work(held.drop("_since").join(ready, "cloud_id", "left_semi")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def rollup_stream(history: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Per-epoch means of a streamed training history: every micro-batch writes them anew to ``sink/version=<id>``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/version={batch_id}")

    writer = epoch_rollup(history).writeStream.outputMode("complete").foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def read_rollup(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of a streamed roll-up."""
    rows = spark.read.parquet(sink)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")
