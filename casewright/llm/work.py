"""Shared working tables: where a job may cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20  # of texts on their way to a Python worker


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`); a temporary one where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


KEPT: dict = {}  # what this Python worker keeps from task to task: the vocabularies of tokenizing.py


def forget() -> None:
    KEPT.clear()


def spare() -> None:
    """Gives back memory that this Python worker holds and does not use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
    if trim:
        trim(0)


def sparing(f, keep: bool = False):
    """f, of a task's batches or of a key and one table or two, by a worker that holds no more after it than it uses.

    Workers go on to other steps, and would hold the most that any of them took. What earlier steps kept goes ahead of f, unless `keep`.
    """

    def each(batches):
        keep or forget()
        try:
            yield from f(batches)
        finally:
            spare()

    def group(key, table):
        keep or forget()
        try:
            return f(key, table)
        finally:
            spare()

    def groups(key, left, right):
        keep or forget()
        try:
            return f(key, left, right)
        finally:
            spare()

    return {1: each, 2: group, 3: groups}[f.__code__.co_argcount]


class Work:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    A written table cuts lineage, survives the loss of executors, and gives later joins a true size. The shuffle files that
    its making left go as soon as it stands: nothing reads them again, and without that they stay until the driver's
    garbage is collected.

    batch_bytes: rows go to Python workers in batches of so much, if given. Executors and workers keep the memory of their
    largest batch, and ten thousand texts, Spark's measure, are 20 MB and more on either side.
    """

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        self.spark = spark
        self.settings = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns what was written."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = {k: self.spark.conf.get(k) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_arrow_columns(df: DataFrame, inputs: list[str], fields: list, make) -> DataFrame:
    """df with further columns. make() gives, once a task, a function from Arrow input columns to Arrow output columns."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    places, schema = [df.columns.index(c) for c in inputs], T.StructType([*df.schema.fields, *fields])
    added = to_arrow_schema(T.StructType(fields))

    def run(batches):
        f = make()
        for batch in batches:
            out = f(*(batch.column(i) for i in places))
            columns = [c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(out, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])
            del batch, out, columns
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(sparing(run), schema)
