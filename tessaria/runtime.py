"""Session helpers: the shared folder for materialised tables, table loading, text helpers.

Executors may be lost at any time, so lineage is cut by writing a Parquet table into the folder
that the cluster names in ``spark.checkpoint.dir``. Only where that setting is unset and the master is local (tests, a
laptop) a temporary folder is used; on a cluster without the setting an error is raised.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Outer blanks removed from keys: ASCII white space, no-break space and the usual Unicode blanks.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Bytes of rows up to which a side is broadcast.
BROADCAST_BYTES = 8 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        base = named.rstrip("/")
    elif spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tessaria-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = "file://" + _LOCAL[app]
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/tessaria-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Write ``df`` once to ``path``; the table read back, and its number of rows, counted as they were written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`materialize` with the number of rows."""
    return save(df, fresh_path(df.sparkSession, name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, path: str, buckets: int, by: str) -> None:
    """Write ``df`` to ``path`` dealt by the hash of a column, so that :func:`read_buckets` can join it by that column where it lies.

    Spark writes buckets only into a table of its catalog; the entry is dropped again, the files stay.
    """
    name = f"tessaria_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_buckets(spark: SparkSession, paths: list[str], schema: str, buckets: int, by: str) -> DataFrame:
    """Tables of :func:`write_buckets`, all of so many buckets by this column, as one: a bucket is one partition. What is joined with it by
    the column, and only by it, comes as ``repartition(buckets, by)``; then only that side moves."""
    jvm, seq = spark.sparkContext._jvm, lambda x: spark.sparkContext._jvm.PythonUtils.toSeq(x)
    some = jvm.scala.Option.apply
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq([by]), seq([]))
    kind = some(spark._jsparkSession.parseDataType(T._parse_datatype_string(schema).json()))
    source = jvm.org.apache.spark.sql.execution.datasources.DataSource(spark._jsparkSession, "parquet", seq(paths), kind, seq([]), some(spec), jvm.PythonUtils.toScalaMap({}), some(None))
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(source.resolveRelation(True, True)), spark)


Save = Callable[[DataFrame, str], tuple[DataFrame, int]]

_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8}


def checked_broadcast(df: DataFrame, rows: int | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, already materialised, as a broadcast side if its rows take at most so many bytes, else as it is.

    Columns of fixed width need only the number of rows (counted here unless given); the bytes of others are summed by a scan.
    """
    wide = [f.name for f in df.schema if type(f.dataType) not in _WIDTH]
    width = sum(_WIDTH.get(type(f.dataType), 0) for f in df.schema)
    if wide or rows is None:
        size = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in wide]
        rows, *long = df.agg(F.count(F.lit(1)), *size).first()
    else:
        long = []
    return F.broadcast(df) if rows * width + sum(long) <= most_bytes else df


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`fresh_path` once nothing will read it again."""
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there whole or not at all; an error if it exists."""
    target, fs = _file_system(spark, path)
    draft, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex[:8]}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise FileExistsError(path)


def get_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Contents of the small files of a folder in the order of their names; none if there is no such folder."""
    target, fs = _file_system(spark, folder)
    if not fs.exists(target):
        return []
    found = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(target) if s.getPath().getName().endswith(suffix))
    out = []
    for _, at in found:
        stream = fs.open(at)
        out.append(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def key(col: Column | str) -> Column:
    """A hash, fingerprint or id for comparison: no outer blanks, lower case; null when blank."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(F.length(k) > 0, k)
