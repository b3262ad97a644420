"""Point tables derived from the general-purpose test tables (see FIXTURES.md), in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    names = ["x", "y", "z", "nx", "ny", "nz", "gx", "gy", "gz"]
    return e.select(
        F.col("label").cast("long").alias("cloud_id"),
        F.col("vec_id").cast("long").alias("point_id"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of_events(table(spark, sf_dir, "events"))


def points_of_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("long").alias("cloud_id"),
        F.col("event_id").cast("long").alias("point_id"),
        F.expr(
            "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS DOUBLE) / 86400000000.0D"
        ).alias("x"),
        (F.col("value") / F.lit(100.0)).alias("y"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("z"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(
        F.col("lang").alias("cloud_id"),
        F.col("doc_id").alias("point_id"),
        F.col("quality").cast("long").alias("target"),
        (F.log(F.lit(1.0) + F.col("n_chars").cast("double")) - F.lit(6.0)).alias("logit"),
    )


def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of_events(table(spark, sf_dir, "events"))


def history_of_events(e: DataFrame) -> DataFrame:
    epoch = F.dayofmonth("ts").cast("long")
    return e.select(
        epoch.alias("epoch"),
        F.col("event_id").cast("long").alias("batch"),
        F.col("value").cast("double").alias("loss"),
        (F.col("value") / F.lit(500.0)).alias("accuracy"),
        (F.lit(1.0) / (F.lit(1) + epoch)).alias("learning_rate"),
    )


EMB = """emb AS (
  SELECT CAST(label AS BIGINT) AS cloud_id, CAST(vec_id AS BIGINT) AS point_id,
    CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
    CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz,
    CAST(embedding[7] AS DOUBLE) AS gx, CAST(embedding[8] AS DOUBLE) AS gy, CAST(embedding[9] AS DOUBLE) AS gz
  FROM embeddings)"""

EVT = """evt AS (
  SELECT CAST(user_id AS BIGINT) AS cloud_id, CAST(event_id AS BIGINT) AS point_id,
    CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 86400000000.0 AS x,
    value / 100.0 AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS z
  FROM events)"""

SCORED = """scored AS (
  SELECT d.lang AS cloud_id, l.doc_id AS point_id, CAST(l.quality AS BIGINT) AS target,
    ln(1.0 + CAST(d.n_chars AS DOUBLE)) - 6.0 AS logit
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

HIST = """hist AS (
  SELECT CAST(day(ts) AS BIGINT) AS epoch, CAST(event_id AS BIGINT) AS batch, CAST(value AS DOUBLE) AS loss,
    value / 500.0 AS accuracy, CAST(1.0 AS DOUBLE) / (1 + day(ts)) AS learning_rate
  FROM events)"""
