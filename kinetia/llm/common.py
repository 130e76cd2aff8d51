"""What the training-data operators share: tables, shared stage files, small expression helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, under a local master where it is unset, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="kinetia-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    own = f"file://{own}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lost executors don't lose it, and its lineage ends here."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kinetia-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frame of a few short columns as a join's right side: broadcast if it has at most so many rows, else merged."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def free(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def typed(schema: str, df: DataFrame, *names: str) -> str:
    """schema with the types that the named columns, longs in it, have in df."""
    for n in names:
        schema = schema.replace(f"{n} long", f"{n} {df.schema[n].dataType.simpleString()}")
    return schema


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, rows: int, place: str, *by: str) -> DataFrame:
    """At most so many rows, those with the least place, a hash. Places beyond twice the share that is wanted are left out first, so no partition sends many."""
    share = 2.0 * rows / max(1, df.count()) + 1e-6
    least = int(max(-(2.0**63), min(2.0**63 - 1024, -(2.0**63) + share * 2.0**64)))
    return df.where(F.col(place) <= least).orderBy(place, *by).limit(rows)
