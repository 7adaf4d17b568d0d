"""The shared scratch folder, and what a session's queries have in common."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_scratch: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting uses the machine's own temp folder. On a cluster that
    would scatter the data over the executors' disks, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/sensorframe/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    # by its whole name the class is found at once, else every part of the name is looked for as a class
    at = getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Path")(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    at, fs = _file_system(spark, path)
    if not fs.rename(at, _file_system(spark, to)[0]):
        raise OSError(f"cannot move {path} to {to}")


def remove_path(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Make the file ``path`` anew with ``text``, for a line or two that need no job. It is there whole or not at all."""
    at, fs = _file_system(spark, path)
    copying = at.suffix("._COPYING_")  # readers leave such files out
    out = fs.create(copying, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(copying, at):
        raise OSError(f"cannot write {path}")


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this session made, and no others; their number.

    Results that still read from them are void afterwards.
    """
    made = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
    return len(made)


@contextmanager
def settings(spark: SparkSession, chosen: dict[str, object]) -> Iterator[None]:
    """Settings for what is started or listed in here; where the session has its own value, that holds."""
    missing = {k: v for k, v in chosen.items() if spark.conf.get(k, None) is None}
    for k, v in missing.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in missing:
            spark.conf.unset(k)


def short_listing(spark: SparkSession) -> dict[str, object]:
    """For ``settings``: thousands of folders are listed in a few tasks a core, not in a task each."""
    return {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism}


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: differs once the table has been rewritten."""
    at, fs = _file_system(spark, path)
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    For small aggregates of a large table that several branches of a query use: the large table is
    read once, and a lost executor later costs nothing of it.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, once per application: for queries with Python inside tasks."""
    context = spark.sparkContext
    if getattr(context, "_sensorframe_shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/sensorframe_package", "zip", root.parent, root.name)
        context.addPyFile(archive)
        context._sensorframe_shipped = archive
    return spark
