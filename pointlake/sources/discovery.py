"""Finding input files: one target per scene folder, or a skipped row with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCENE_SUFFIX = "_raw_pointcloud.ply"


def list_files(spark: SparkSession, root: str, pattern: str = "*" + SCENE_SUFFIX, recursive: bool = True) -> DataFrame:
    """Paths below a folder; only the listing is read, never the contents."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    )


def path_parts(paths: DataFrame) -> DataFrame:
    return paths.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
    )


def resolve_scenes(paths: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Per folder: the file named after it, else the only file that starts with its name, else the only file.

    Returns (scene_name, path, status, error, n_files). ``folders(dir)`` adds folders without any file. Counts
    per preference class are one aggregation; no folder's list of files is collected.
    """
    p = path_parts(paths)
    exact = F.col("file") == F.concat("dir", F.lit(SCENE_SUFFIX))
    prefix = F.startswith("stem", F.col("dir"))
    cls = F.when(exact, 0).when(prefix, 1).otherwise(2)
    p = p.withColumn("_c", cls)

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    g = p.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n_files"), n(exact).alias("_n0"), n(prefix).alias("_n1"),
        F.min_by("path", F.struct("_c", "path")).alias("_first"),
    )
    if folders is not None:
        g = folders.select("dir").distinct().join(g, "dir", "left").fillna(0, ["n_files", "_n0", "_n1"])
    error = (
        F.when(F.col("n_files") == 0, F.lit("no matching files"))
        .when(F.col("_n0") > 1, F.lit("several files named after the scene"))
        .when(F.col("_n0") == 1, F.lit(None))
        .when(F.col("_n1") > 1, F.lit("several scene-matched files"))
        .when(F.col("_n1") == 1, F.lit(None))
        .when(F.col("n_files") > 1, F.lit("several matching files"))
    )
    return g.select(
        F.col("dir").alias("scene_name"), F.when(error.isNull(), F.col("_first")).alias("path"),
        F.when(error.isNull(), F.lit("ready")).otherwise(F.lit("skipped")).alias("status"), error.alias("error"), "n_files",
    )


def file_targets(paths: DataFrame) -> DataFrame:
    """Every file is a target; its scene is the folder when the file is named after it."""
    p = path_parts(paths).where(F.lower(F.col("path")).endswith(".ply"))
    scene = F.when(F.startswith("stem", F.col("dir")), F.col("dir"))
    return p.select("path", scene.alias("scene_name"), F.coalesce(scene, "stem").alias("output_name"))


def resolve_targets(spark: SparkSession, root: str, mode: str = "auto", pattern: str = "*" + SCENE_SUFFIX,
                    recursive: bool = False) -> DataFrame:
    """Targets of a path: (scene_name, path, status, error, n_files).

    ``file``: the path itself; ``scene_dir``: the folder is one scene; ``scan_root``: every subfolder is a
    scene; ``flat_dir``: every file is a target, any ``*.ply`` when the pattern matches none. ``auto`` decides
    from the path.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        raise FileNotFoundError(root)
    is_file = store.getFileStatus(hadoop).isFile()
    if mode not in ("auto", "file", "scene_dir", "scan_root", "flat_dir"):
        raise ValueError(f"unknown input mode {mode}")
    if is_file or mode == "file":
        if not (is_file and root.lower().endswith(".ply")):
            raise ValueError(f"expected a .ply file: {root}")
        t = file_targets(spark.createDataFrame([(root,)], "path string"))
        return _ready(t)
    here = list_files(spark, root, pattern, recursive=False)
    subdirs = [s.getPath().getName() for s in store.listStatus(hadoop) if s.isDirectory()]
    if mode == "auto":
        scene = resolve_scenes(here).where("status = 'ready'").limit(1).count() == 1
        mode = "scene_dir" if scene else ("scan_root" if recursive or subdirs else "flat_dir")
    if mode == "scene_dir":
        return resolve_scenes(here)
    if mode == "scan_root":
        if not subdirs:
            return _ready(file_targets(list_files(spark, root, pattern)))
        depth = F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1) == F.lit(hadoop.getName())
        folders = spark.createDataFrame([(d,) for d in subdirs], "dir string")
        return resolve_scenes(list_files(spark, root, pattern).where(depth), folders)
    flat = here if here.limit(1).count() else list_files(spark, root, "*.ply", recursive=False)
    return _ready(file_targets(flat))


def _ready(targets: DataFrame) -> DataFrame:
    return targets.select(
        F.col("output_name").alias("scene_name"), "path", F.lit("ready").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("n_files"),
    )


def preview(targets: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` targets by path and how many more there are (the dry-run listing)."""
    total = targets.agg(F.count(F.lit(1))).scalar()
    return targets.orderBy("path").limit(n).withColumn("n_more", F.greatest(F.lit(0), total - n))
