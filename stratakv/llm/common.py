"""What the operators share: reading tables, durable intermediate tables, word splitting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs on this machine, as in tests, a folder of our own; elsewhere an error, as
    executors would each write to their own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="stratakv-"))
    return _own[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Spark's setting that shuffle files go as soon as the query that wrote them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frees_shuffles(f):
    """For operators of many steps that each write a table: no step's shuffle files outlive it.

    Only queries made inside f have the setting; the result is a query of the caller's.
    """

    @functools.wraps(f)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(CLEAN, "false")
        conf.set(CLEAN, "true")
        try:
            out = f(df, *args, **options)
        finally:
            conf.set(CLEAN, before)
        return out.select("*")

    return run


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]
