"""What the corpus operators share: tables that cut lineage, and Arrow plumbing."""

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only in local mode, where there is no other."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/millrace"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lost executors then cost no recomputation.

    The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str):
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *own) -> DataFrame:
    """df's columns in one struct named row, beside columns of our own that cannot clash with them."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *own)


def unpacked(names: list[str], **instead) -> list:
    """The columns that packed() put away, in order; instead: other values for some of them."""
    return [instead.get(c, F.col("row").getField(c)).alias(c) for c in names]


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name cannot clash: id, body (UTF-8 bytes)."""
    return df.select(named(id_col).cast("long").alias("id"), named(text_col).cast("binary").alias("body"), *more)


def release() -> None:
    """Give free memory back to the machine: a Python worker waits for its next task beside its executor's JVM, and what it holds counts there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def freed(run):
    """run, a function of Arrow batches, that releases memory at its end, when its own values are gone."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """make(list of column lists) -> list of column lists, for each Arrow batch of df."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows:
                columns = make([c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(freed(run), target)


def held_out(id_column, modulus: int, remainder: int):
    """Is crc32 of the id's decimal text, modulo modulus, the remainder? False for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))

