"""Tables loaded in steps: a step counts whole or not at all, and ids go on from one step, and one load, to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.operators.ids import with_dense_id
from sensorframe.session import path_exists

_STEP = "load STRING, step BIGINT"
_MARK = "first BIGINT, n BIGINT"


def _folder(table: str, what: str, load: str, step: int) -> str:
    return f"{table.rstrip('/')}/{what}/load={load}/step={step}"


def marks(spark: SparkSession, table: str) -> DataFrame:
    """``(first, n, load, step)``: first id and number of rows of every finished step."""
    path = f"{table.rstrip('/')}/marks"
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{_MARK}, {_STEP}")
    return spark.read.schema(f"{_MARK}, {_STEP}").parquet(path)


def high_water(spark: SparkSession, table: str) -> int:
    """The last id given out by a finished step, 0 before the first one."""
    return marks(spark, table).agg(F.coalesce(F.max(F.col("first") + F.col("n")) - 1, F.lit(0))).first()[0]


def is_finished(spark: SparkSession, table: str, load: str, step: int) -> bool:
    return path_exists(spark, f"{_folder(table, 'marks', load, step)}/_SUCCESS")


def write_step(rows: DataFrame, table: str, load: str, step: int, first: int = 1) -> None:
    """Write ``rows`` as one step of a load.

    A step is finished once its mark is written, after its rows. One that broke off before is written anew, one that
    is finished is left alone when it is replayed. One writer at a time, and a name for each load, as steps are
    counted anew in every load.
    """
    spark = rows.sparkSession
    if is_finished(spark, table, load, step):
        return
    at = _folder(table, "rows", load, step)
    rows.write.mode("overwrite").parquet(at)
    n = spark.read.parquet(at).count()
    mark = spark.range(1).select(F.lit(first).cast("long").alias("first"), F.lit(n).cast("long").alias("n"))
    mark.coalesce(1).write.mode("overwrite").parquet(_folder(table, "marks", load, step))


def append_step(rows: DataFrame, table: str, load: str, step: int, chunk: str = "chunk", pos: str = "pos", name: str = "id") -> None:
    """``write_step`` with ids after those of all finished steps, dense and in order of ``(chunk, pos)``.

    A step that broke off gets the same ids again. ``rows`` must read the same whenever it is evaluated.
    """
    if not is_finished(rows.sparkSession, table, load, step):
        first = high_water(rows.sparkSession, table) + 1
        numbered = with_dense_id(rows, chunk, pos, name).withColumn(name, F.col(name) + F.lit(first - 1))
        write_step(numbered, table, load, step, first)


def read_steps(spark: SparkSession, table: str, schema: str | T.StructType) -> DataFrame:
    """The rows of the finished steps; other steps are not read."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    path = f"{table.rstrip('/')}/rows"
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType(fields))
    rows = spark.read.schema(T.StructType([*fields, *T.StructType.fromDDL(_STEP).fields])).parquet(path)
    return rows.join(marks(spark, table).select("load", "step"), ["load", "step"], "left_semi").drop("load", "step")
