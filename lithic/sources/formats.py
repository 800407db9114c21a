"""Other files in and out: Arrow IPC, JSON and CSV results, Parquet laid out for fast scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow file that become one Spark batch.
BATCH_ROWS = 65_536


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams; executors read them whole, one task a file."""
    import pyarrow as pa

    files = _contents(spark, path)
    head = bytes(files.select("content").first()[0])
    schema = _open(head).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    names = schema.names

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                for b in _open(content.as_buffer()):
                    for lo in range(0, b.num_rows, BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays(b.slice(lo, BATCH_ROWS).columns, names=names)

    return files.select("content").mapInArrow(rows, from_arrow_schema(schema))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """``content`` of Arrow files, or of a folder that ``write_arrow`` made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return spark.read.parquet(path) if files.limit(1).count() else spark.read.format("binaryFile").load(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """A folder of Arrow IPC streams, one a partition, written by the executors through Spark's own files."""
    import pyarrow as pa

    def pack(batches):
        sink, writer = pa.BufferOutputStream(), None
        for b in batches:
            writer = writer or pa.ipc.new_stream(sink, b.schema)
            writer.write_batch(b)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    df.mapInArrow(pack, "content binary").write.parquet(path)


def _open(data):
    import pyarrow as pa

    try:
        reader = pa.ipc.open_file(data)
        return _Batches(reader.schema, (reader.get_batch(i) for i in range(reader.num_record_batches)))
    except pa.ArrowInvalid:
        reader = pa.ipc.open_stream(data)
        return _Batches(reader.schema, reader)


class _Batches:
    def __init__(self, schema, batches):
        self.schema, self.batches = schema, batches

    def __iter__(self):
        return iter(self.batches)


def to_json_lines(df: DataFrame) -> list[str]:
    """A result as JSON objects, nulls included."""
    return [r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def to_csv_text(df: DataFrame) -> str:
    """A result as CSV with a header; nested values as JSON."""
    import csv
    import io

    nested = (T.ArrayType, T.MapType, T.StructType)
    shown = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(shown.columns)
    w.writerows(["" if v is None else v for v in r] for r in shown.collect())
    return out.getvalue()


def write_ready_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None, row_group_bytes: int = 128 << 20) -> None:
    """Parquet in the order of its keys, so that statistics prune well; ZSTD, dictionaries where they help."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)
