"""Many tracks at once: found by their files' names, read in one job, and computed anew only where files have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.functions.signal import complement
from cyclarium.operators.selection import least_common_names
from cyclarium.plans import tasks as plan

#: A track's name in its file's path: the last name without its ending.
STEM = r"([^/]+?)(?:\.[^./]+)?$"
STATE = ["track", "path", "modified", "bytes"]


def find_tracks(spark: SparkSession, path: str, pattern: str = "*.parquet", name: str = STEM) -> DataFrame:
    """(track, path, modified, bytes) of the files or folders of files below ``path`` whose name matches ``pattern``.

    The first group of the expression ``name`` is the track; files that it
    doesn't match are left out. A track's files count together, by their
    number of bytes and the time of the last change.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    glob = "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+{}[]()|\\" else c) for c in pattern) + "$"
    # a track is the outermost file or folder with such a name
    parts = F.split(F.regexp_replace("path", "^[^/]*:/+", "/"), "/")
    at = F.array_position(F.transform(parts, lambda x: x.rlike(glob)), True)
    rows = files.withColumn("_at", at).where("_at > 0").withColumn("_own", F.get(parts, F.col("_at").cast("int") - 1))
    rows = rows.withColumn("path", F.concat(F.regexp_extract("path", "^([^/]*:/+|)", 1), F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), F.col("_at").cast("int")), "/"), "^/", "")))
    rows = rows.withColumn("track", F.regexp_extract("_own", name, 1)).where("track <> ''")
    return rows.groupBy("track", "path").agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"))


def short_names(tracks: DataFrame) -> DataFrame:
    """(track, name): names without the parts that all tracks share."""
    return least_common_names(tracks)


def oligo_names(tracks: DataFrame, length: int = 3) -> DataFrame:
    """(track, oligo) of tracks whose name has an oligo of so many bases between other characters."""
    oligo = F.lower(F.regexp_extract("track", f"(?i)(?:^|[^a-z])([acgt]{{{length}}})(?:[^a-z]|$)", 1))
    return tracks.select("track", oligo.alias("oligo")).distinct().where("oligo <> ''").withColumn("complement", complement(F.col("oligo")))


def read_tracks(spark: SparkSession, path: str, tracks: DataFrame) -> DataFrame:
    """Frames of the ``tracks`` that were found below ``path``, each with its track's name: one scan of all files.

    Only the listed tracks' folders are read. The listing has a row per track,
    so it is no larger than the list of paths that a scan needs anyway.
    """
    rows = tracks.select("track", "path").collect()
    if not rows:
        raise ValueError(f"no tracks below {path}")
    frames = spark.read.parquet(*[r.path for r in rows])
    plain = lambda c: F.regexp_replace(c, "^[^/]*:/+", "/")
    named = tracks.select(F.col("track").alias("_track"), plain(F.col("path")).alias("_path"))
    # a file is its track's path, or lies directly in that folder
    where = plain(F.col("_metadata.file_path"))
    rows = frames.select("*", where.alias("_file"), F.regexp_replace(where, "/[^/]*$", "").alias("_folder"))
    one = lambda column, alias: named.select(F.col("_path").alias(column), F.col("_track").alias(alias))
    rows = rows.join(one("_file", "_by_file"), "_file", "left").join(one("_folder", "_by_folder"), "_folder", "left")
    return rows.withColumn("track", F.coalesce("_by_file", "_by_folder")).drop("_file", "_folder", "_by_file", "_by_folder")


def track_frame(spark: SparkSession, path: str, tasks: list[plan.Task], pattern: str = "*.parquet", name: str = STEM) -> DataFrame:
    """The tasks' result over all tracks found: one plan, whose keys hold the track."""
    return plan.run([plan.InMemoryTrackTask(), *tasks], read_tracks(spark, path, find_tracks(spark, path, pattern, name)))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def update(spark: SparkSession, path: str, tasks: list[plan.Task], folder: str, pattern: str = "*.parquet", name: str = STEM) -> DataFrame:
    """The same, kept in ``folder``: tracks that are new or have changed are computed, results of the others stay, those of lost ones go.

    Another list of tasks has another place in the folder.
    """
    key = plan.digest(tasks)
    results, state = f"{folder}/{key}/results", f"{folder}/{key}/state"
    found = find_tracks(spark, path, pattern, name).cache()
    try:
        known = spark.read.parquet(state) if _exists(spark, f"{state}/_SUCCESS") else None
        stale = found if known is None else found.join(known, STATE, "left_anti")
        todo = [r.track for r in stale.select("track").distinct().collect()]
        if todo:
            made = plan.run([plan.InMemoryTrackTask(), *tasks], read_tracks(spark, path, found.where(F.col("track").isin(*todo))))
            made.repartition("track").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track").parquet(results)
        rows = found.collect()
        if todo or known is None or known.count() != len(rows):
            spark.createDataFrame(rows, found.schema).coalesce(1).write.mode("overwrite").parquet(state)
        return spark.read.parquet(results).where(F.col("track").isin(*[r.track for r in rows]))
    finally:
        found.unpersist()
