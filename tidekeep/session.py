"""Session settings and the shared working folder every job writes through."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (all are session-level)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once for each application; Spark hands the archive to every executor."""
    context = spark.sparkContext
    if getattr(context, "_tidekeep_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidekeep-"), "tidekeep.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join(os.path.basename(package), os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._tidekeep_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a ``local`` master, where driver and executors share one disk, may
    fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidekeep-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created there yet."""
    return os.path.join(shared_folder(spark), "tidekeep", f"{label}-{uuid.uuid4().hex}")


def materialize(df, label: str):
    """Writes a frame to the shared folder and reads it back.

    Cuts lineage and lets several consumers share costly work; the files
    outlive any executor.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def union_all(frames):
    """Union of many frames by name, built as a balanced tree so that its depth stays small."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [a.unionByName(*b) if b else a for a, *b in (frames[i:i + 2] for i in range(0, len(frames), 2))]
    return frames[0]
