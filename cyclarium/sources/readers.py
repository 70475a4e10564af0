"""Readers and writers of tracks and sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.statistics import BEAD


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Frames; a partition column ``track`` prunes files."""
    return spark.read.parquet(path)


def save_tracks(frames: DataFrame, path: str) -> None:
    """One folder per track, its frames in order."""
    frames.repartition("track", "bead").sortWithinPartitions(*BEAD, "frame").write.partitionBy("track").mode("overwrite").parquet(path)


def read_lock_in(spark: SparkSession, path: str, separator: str = ";", header_lines: int = 4) -> DataFrame:
    """(track, seconds, z in µV) from lock-in amplifier text: a few header lines, then time and volts."""
    lines = spark.read.text(path).withColumn("track", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    cells = F.split("value", f"[{separator},]")
    rows = lines.select("track", cells.getItem(0).try_cast("double").alias("seconds"), (cells.getItem(1).try_cast("double") * 1e6).alias("z"))
    return rows.where("seconds is not null and z is not null")


def frame_rate(samples: DataFrame) -> DataFrame:
    """Per track one over the median time between samples."""
    dt = F.col("seconds") - F.lag("seconds").over(W.partitionBy("track").orderBy("seconds"))
    return samples.withColumn("_dt", dt).groupBy("track").agg((1 / F.median("_dt")).alias("framerate"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(hpin, sequence) from "> name" blocks."""
    blocks = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    return blocks.select(F.trim(lines.getItem(0)).alias("hpin"), F.lower(F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), ""), r"\s", "")).alias("sequence"))


def drop_first_cycles(frames: DataFrame, first: int = 3, size: int | None = None) -> DataFrame:
    """Cycles from ``first`` on, without a last one of fewer than ``size`` frames."""
    rows = frames.where(F.col("cycle") >= first)
    return rows if size is None else rows.withColumn("_n", F.count("*").over(W.partitionBy(*BEAD, "cycle"))).where(F.col("_n") >= size).drop("_n")


def keep_calibrated(frames: DataFrame, beads: DataFrame) -> DataFrame:
    """Beads that aren't lost and are calibrated."""
    return frames.join(beads.where("not lost and calibrated"), BEAD, "left_semi")


def scan(spark: SparkSession, tracks: str, overrides: str) -> DataFrame:
    """Pairs of track and override files by their stems; either may be alone."""
    def names(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
        return files.withColumn("key", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).withColumnRenamed("path", name)

    return names(tracks, "track_path").join(names(overrides, "override_path"), "key", "full")


#: Readers by format, tried in this order by ``open_track``.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"parquet": read_parquet, "txt": read_lock_in, "fasta": read_fasta}


def open_track(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the path's ending names."""
    for ending, reader in FORMATS.items():
        if path.rstrip("/").endswith(ending):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")
