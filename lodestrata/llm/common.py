"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word: anything but a space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that one Arrow batch may hold, so that long texts cannot fill a Python worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one is made if driver and executors are one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files as they end. Else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written as Parquet to the shared folder and read again.

    Unlike localCheckpoint this survives lost executors; unlike checkpoint() the files are
    columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.parquet(path)
    _WRITTEN.add(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of written() that this driver hasn't dropped.
_WRITTEN: set[str] = set()


def _names(df: DataFrame) -> set[str]:
    return {name for f in df.inputFiles() if (name := f.rsplit("/", 2)[-2]).startswith("lodestrata-")}


def _delete(spark: SparkSession, names: set[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for found in [p for p in _WRITTEN if p.rsplit("/", 1)[1] in names]:
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.discard(found)


def dropped(df: DataFrame) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    _delete(df.sparkSession, _names(df))


class Scratch:
    """The tables that written() makes while a with block runs; clear() removes them once what they led to is stored elsewhere."""

    def __init__(self):
        self.paths: set[str] = set()

    def __enter__(self) -> Scratch:
        self._before = set(_WRITTEN)
        return self

    def __exit__(self, *_) -> None:
        self.paths |= _WRITTEN - self._before

    def clear(self, spark: SparkSession) -> None:
        _delete(spark, {p.rsplit("/", 1)[1] for p in self.paths})
        self.paths.clear()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Holds Arrow batches to so many rows, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words of a text as a long, 0 for null; stays in the JVM and makes no array of words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marks, SPACE, "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The same for Python strings.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def unit(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values only, alike in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


def row_map(df: DataFrame, keep: Sequence[Column], value: Column, make: Callable[[], Callable], fields: str) -> DataFrame:
    """The columns `keep` untouched, and beside them what a Python function makes of each value.

    make() runs once a task and returns the function, which takes a value and returns a tuple for `fields`
    (a DDL string), or a plain value where that is a single field. One row out for each row in; batches of
    Arrow rows stream through, so memory is bounded by a batch.
    """
    small_batches(df.sparkSession)
    given = df.select(*keep, value.alias("_value"))
    made = StructType.fromDDL(fields)
    shape = StructType([*given.schema.fields[:-1], *made.fields])
    kinds = [to_arrow_type(f.dataType) for f in made.fields]
    names, single = shape.names, len(kinds) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = [function(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [rows] if single else list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns, kinds)], names=names)

    return given.mapInArrow(run, shape)
