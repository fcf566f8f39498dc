"""Helpers shared by the operators: batches of texts, samples, intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master a temporary one where none is configured."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Narrow intermediate rows, computed once and kept where every executor finds them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def temporary(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, level: int = 3) -> DataFrame:
    """Like ``checkpointed`` for wide rows: column by column, compressed by zstd's ``level``."""
    path = temporary(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name that may hold dots or backquotes, for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def sampled(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of ``key``; all rows if there are
    no more. The count reads the key and the filtered columns only."""
    total = rows.count()
    if total <= bound:
        return rows
    parts = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(parts)) < int(parts * bound / total))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a schema text; for the driver, tasks have no parser."""
    return to_arrow_schema(StructType.fromDDL(schema))


def batches(rows: Iterable[dict[str, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches from dicts of columns."""
    for columns in rows:
        yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in schema], schema=schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def per_document(docs: DataFrame, columns: list[str], schema: str, work: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """One output row for each input row, a record batch at a time.

    ``work()`` runs once a task and returns a function of the batch's columns, which
    gives the new columns. Only ``columns`` are read.
    """

    made = arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        yield from batches((step(*(batch.column(c) for c in columns)) for batch in incoming), made)

    return docs.select(*columns).mapInArrow(run, schema)


def kept_rows(docs: DataFrame, column: str, work: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, for which the function says True."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in incoming:
            yield batch.filter(pa.array(step(batch.column(column)), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
