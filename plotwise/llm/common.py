"""Shared pieces: the column contract of text operators, and their tables between stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.session import cut, reliable  # noqa: F401


def placed(frame: DataFrame) -> DataFrame:
    """The frame with its columns named by place (_0, _1, ...), so none of its names can clash with an operator's own."""
    return frame.toDF(*[f"_{i}" for i in range(len(frame.columns))])


def at(frame: DataFrame, name: str) -> Column:
    """The column of ``placed(frame)`` that ``name`` stands for in ``frame``."""
    return F.col(f"_{frame.columns.index(name)}")


def named(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """The columns that ``placed(frame)`` has in ``rows``, under the frame's names again."""
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(frame.columns)])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null becomes empty), so no other column can clash."""
    return placed(docs).select(
        at(docs, id_col).cast("long").alias("doc_id"),
        F.coalesce(at(docs, text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of each Arrow batch, cut into slices of about ``most_bytes`` of UTF-8.

    A slice holds one row at least, so one very long text makes a slice of its own.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        offsets = pa.compute.cumulative_sum(pa.compute.cast(pa.compute.binary_length(texts), pa.int64())).to_numpy(zero_copy_only=False)
        start, n = 0, len(ids)
        while start < n:
            done = offsets[start - 1] if start else 0
            stop = max(start + 1, int(offsets.searchsorted(done + most_bytes, side="right")))
            yield ids.slice(start, stop - start).to_pylist(), texts.slice(start, stop - start).to_pylist()
            start = stop


def held(frame: DataFrame, most: int) -> DataFrame | None:
    """A frame of at most ``most`` rows as a table of the driver's own, without lineage or files; None if it has more."""
    rows = frame.limit(most + 1).toArrow()
    return frame.sparkSession.createDataFrame(rows, frame.schema) if rows.num_rows <= most else None


def write(frame: DataFrame) -> str:
    """The folder of a new Parquet table of the frame, in the shared checkpoint folder; compressed, unlike a checkpoint."""
    path = f"{reliable(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table that ``write`` made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
