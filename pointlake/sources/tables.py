"""Materialised tables addressed by their configuration, with manifests and integrity checks."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pointlake.functions.geometry import XYZ
from pointlake.session import discard, staged


def canonical(config: dict, relevant: list[str] | None = None) -> str:
    """JSON with sorted keys of the parameters that affect results."""
    used = config if relevant is None else {k: config[k] for k in relevant if k in config}
    return json.dumps(used, sort_keys=True, separators=(",", ":"))


def config_hash(config: dict, relevant: list[str] | None = None) -> str:
    return hashlib.md5(canonical(config, relevant).encode()).hexdigest()[:8]


def config_hash_column(text: Column) -> Column:
    """The same address for configurations held in a column as canonical JSON."""
    return F.substring(F.md5(text), 1, 8)


def _bits(c: str) -> Column:
    """The 64 bits of a coordinate as a number, equal where coordinates are equal (there is one zero)."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col(c).cast("double") + F.lit(0.0))


def fingerprint(points: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Order-independent content mark per cloud: number of points and the XOR of row hashes over the exact coordinates."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("point_id").cast("string"), *map(_bits, XYZ))), 1, 13), 16, 10).cast("long")
    return points.select(*keys, h.alias("_h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("mark"))


def reusable(current: DataFrame, cached: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Clouds whose cached result may be reused: identical content."""
    return current.join(cached, [*keys, "n", "mark"], "left_semi").select(*keys)


def unfinished(todo: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(finished, keys, "left_anti")


#: Values of the partition columns up to which each has a folder of its own.
MOST_FOLDERS = 1000
MANIFEST = "hash string, config string, n_rows long, folder string, columns string"


def write_table(df: DataFrame, root: str, config: dict, partition_by: list[str] = ()) -> str:
    """Write below the address of the configuration: data into a folder of its own, then the manifest that names it.

    The manifest is the commit: until it is there, readers see the table before, complete. It keeps the column types,
    so that ids which look like numbers come back as they were.

    Up to ``MOST_FOLDERS`` values of the partition columns have a folder each. More of them lie in files in their order,
    whose statistics let a reader of one value skip the others; the number of files then grows with the rows only.
    """
    spark, path = df.sparkSession, f"{root}/{config_hash(config)}"
    folder = f"data-{uuid.uuid4().hex}"
    if partition_by:
        rows = staged(df)
        if rows.select(*partition_by).distinct().limit(MOST_FOLDERS + 1).count() > MOST_FOLDERS:
            # The rows' own hash cuts a value that very many of them have.
            every = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
            rows.repartitionByRange(*partition_by, every).sortWithinPartitions(*partition_by).write.parquet(f"{path}/{folder}")
        else:
            rows.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
        discard(rows)
    else:
        df.write.parquet(f"{path}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    row = (config_hash(config), canonical(config), rows, folder, df.schema.json())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def read_table(spark: SparkSession, root: str, config: dict, check: bool = True) -> DataFrame | None:
    """The table of a configuration, or None when it is missing or does not agree with its manifest."""
    path = f"{root}/{config_hash(config)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if manifest is None or manifest["config"] != canonical(config):
        return None
    df = spark.read.schema(StructType.fromJson(json.loads(manifest["columns"]))).parquet(f"{path}/{manifest['folder']}")
    return df if not check or df.count() == manifest["n_rows"] else None


def membership_integrity(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per (cloud, scale) of the manifest (cloud_id, scale_idx, n_patches, n_rows): does the table agree?"""
    keys = ["cloud_id", "scale_idx"]
    have = members.groupBy(*keys, "patch_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_p"), F.sum("_n").alias("_r")
    )
    ok = F.coalesce((F.col("_p") == F.col("n_patches")) & (F.col("_r") == F.col("n_rows")), F.lit(False))
    return manifest.join(have, keys, "left").select(*keys, ok.cast("long").alias("valid"))
