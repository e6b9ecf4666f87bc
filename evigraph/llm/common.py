"""Helpers shared by the training-data operators: Arrow stages over whole texts and tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: (session, folder, whether it holds tables between the steps of one operator)
_made: list[tuple[SparkSession, str, bool]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str, steps: bool = True) -> str:
    """A fresh path in the shared folder; it is removed when the driver's process ends, or by clear_steps()."""
    path = f"{shared_dir(spark)}/evigraph-llm/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path, steps))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_steps() -> None:
    """Removes the tables between the steps of operators whose results have been written or are no longer needed."""
    for x in [x for x in _made if x[2]]:
        remove(x[0], x[1])
        _made.remove(x)


def steps_so_far() -> frozenset[str]:
    return frozenset(path for _, path, steps in _made if steps)


def settled(df: DataFrame, label: str, before: frozenset[str]) -> DataFrame:
    """written(df) without its shuffle files; then the tables that were made between the operator's steps since `before`
    (steps_so_far()) are removed."""
    made = [x for x in _made if x[2] and x[1] not in before]
    out = written(df, label, drop_shuffles=True)
    for x in made:
        remove(x[0], x[1])
        _made.remove(x)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, ... so that columns of an operator's own can't clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _remove_all() -> None:
    for spark, path, _ in _made:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: the folder is left to its owner
            return


#: Spark's setting that removes the shuffle files of a query when it ends; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, steps: bool = True, drop_shuffles: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.

    drop_shuffles: the writing query's shuffle files go as soon as the table is there.
    """
    spark = df.sparkSession
    path = new_folder(spark, label, steps)
    session_s = spark.conf.get(CLEANUP, "false")
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, session_s)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch on its way to Python, where the session has no number of its own; rows that are Python objects at a time.
BATCH_ROWS, SLICE = 1000, 250


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of Spark's 10,000 rows would hold an executor's memory. A number that the session set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_stage(df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[dict]], Iterator[tuple]], out_rows: int = 2000, out_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow with an iterator of dicts of Python lists, of SLICE rows at most, in, and tuples out.

    Tuples are gathered into record batches of at most out_rows rows or about out_bytes of text and binary.
    """
    small_batches(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    sized = [i for i, f in enumerate(kind.fields) if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for row in rows(b.slice(k, SLICE).to_pydict() for b in batches for k in range(0, b.num_rows, SLICE)):
            held.append(row)
            weight += sum(len(row[i]) for i in sized if row[i] is not None)
            if len(held) >= out_rows or weight >= out_bytes:
                yield _batch(held, arrow)
                held, weight = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
