"""Dense row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions import n_rows


def with_dense_id(df: DataFrame, chunk: str = "chunk", pos: str = "pos", name: str = "id",
                  block_rows: int = 1 << 16) -> DataFrame:
    """Number the rows 1, 2, 3, .. in order of ``(chunk, pos)``, where ``pos`` is unique in its chunk.

    A global ``row_number`` would sort everything in one task. Rows are numbered inside blocks of
    ``block_rows`` positions instead, and shifted by the number of rows in earlier blocks, which
    comes from a small table of block sizes. A chunk holding most of the rows is many blocks.
    """
    # keys that are never null: rows without a chunk come first, and the joins need no null filters,
    # which would make the branches differ and the table be scanned once more
    rows = df.withColumns({
        "_chunk": F.coalesce(F.col(chunk), F.lit(-1)),
        "_block": F.coalesce(F.floor(F.col(pos) / block_rows), F.lit(-1).cast("bigint")),
    })
    sizes = rows.groupBy("_chunk", "_block").agg(n_rows("_rows"))
    earlier_chunks = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("_chunk").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chunk_start = sizes.groupBy("_chunk").agg(F.sum("_rows").alias("_rows")).select(
        "_chunk", F.coalesce(F.sum("_rows").over(earlier_chunks), F.lit(0)).alias("_chunk_start"))
    block_start = sizes.join(chunk_start, "_chunk").select(
        "_chunk", "_block",
        (F.col("_chunk_start") + F.coalesce(F.sum("_rows").over(earlier_blocks), F.lit(0))).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_chunk", "_block").orderBy(pos))
    return (
        rows.withColumn("_n", inside).join(block_start, ["_chunk", "_block"])
        .withColumn(name, F.col("_start") + F.col("_n"))
        .drop("_chunk", "_block", "_n", "_start")
    )
