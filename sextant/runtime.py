"""Tables, shared scratch folder and size-checked joins.

Every intermediate result that is used more than once is written to the folder
named by ``spark.checkpoint.dir`` (shared by all executors), so a lost executor
costs a re-read, not a wrong or failed result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a join side may have to be broadcast. The side is counted before the hint is given.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on this machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, keep_order_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage and fixes generated ids.

    An empty frame keeps its schema. The files are deleted when Python exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sextant-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*keep_order_by) if keep_order_by else df
    out.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``cut`` that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/sextant-" in x}:
        _delete(df.sparkSession, f)


def sized(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is."""
    return F.broadcast(df) if len(df.limit(most_rows + 1).select(F.lit(1)).take(most_rows + 1)) <= most_rows else df


def literals(values: list[str]) -> str:
    """``values`` as the inside of an SQL list, for ``IN (...)``; NULL for none."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "NULL"


def skew_join(big: DataFrame, dim: DataFrame, on: str, weight: str, total: int, share: float = 0.005, most_rows: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Inner join of ``big`` with ``dim`` (unique on ``on``) where a few keys may hold most of ``big``.

    ``weight`` counts the rows of ``big`` by key and ``total`` is their sum, so at most ``1 / share``
    keys reach ``share * total``: these few are joined by broadcast, the others by a shuffle.
    A ``dim`` of at most ``most_rows`` rows is broadcast whole; ``rows`` is its number of rows, where the caller
    knows it and it need not be counted. NULL keys match nothing.
    """
    hinted = sized(dim, most_rows) if rows is None else F.broadcast(dim) if rows <= most_rows else dim
    if hinted is not dim:
        return big.join(hinted.drop(weight), on)
    is_hot = F.col(weight) >= F.lit(max(1.0, share * total))
    hot, cold = dim.where(is_hot).drop(weight), dim.where(~is_hot).drop(weight)
    keys = F.broadcast(hot.select(on))
    return big.join(F.broadcast(hot), on).unionByName(big.join(keys, on, "left_anti").join(cold, on))
