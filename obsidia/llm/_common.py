"""What the operators share: tidy inputs, stable row keys, UTF-8 buffers and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="obsidia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors.

    Shuffle files of the write go when it ends; else they stay until the driver happens to collect its garbage.
    """
    session, path = df.sparkSession, shared_dir(df.sparkSession)
    before = session.conf.get(_CLEANUP, None)
    session.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        session.conf.unset(_CLEANUP) if before is None else session.conf.set(_CLEANUP, before)
    return session.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once all that was made from it is itself written."""
    jvm, session = df.sparkSession._jvm, df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text) and ``text``; together the first two tell rows apart.

    Rows alike in both are repeated rows: they get the same result. ``more``: further columns by name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *(c.alias(k) for k, c in more.items()))


def same_row(left: str, right: str) -> Column:
    """Condition that joins what ``keyed`` made, null ids included."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and each value's length; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, and one row at least."""
    for batch in batches:
        _, lengths = utf8(batch.column(text_col))
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, end to end."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)
