"""Tables written to the folder that driver and executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent, a temporary one if all runs on this machine, else an error."""
    where = spark.conf.get(SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='chronoweave-')}"
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder; its size is then known to the optimizer."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of ids (8 bytes each) that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 2_000_000


def semi(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose ``on`` is in ids (distinct, one column of longs): broadcast if counted to fit, else a shuffled join."""
    return df.join(_side(ids, limit), on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose ``on`` is null or not in ids."""
    return df.join(_side(ids, limit), on, "left_anti")


def _side(ids: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= limit else ids.hint("merge")


#: Rows of an id and a version (16 bytes and their table) that may be broadcast.
BROADCAST_KEYS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """The name, or with underscores after it one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _by_row(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str, limit: int) -> DataFrame:
    side = F.broadcast(rows) if rows.count() <= limit else rows.hint("merge")
    i, v = fresh(df, "row_id"), fresh(df, "row_version")
    side = side.select(F.col("doc_id").alias(i), F.col("version").alias(v))
    return df.join(side, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(v)), how)


def semi_row(df: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df named by (doc_id, version): the id, null for null, and the xxhash64 of the text. Beyond ``limit`` rows the join shuffles on both."""
    return _by_row(df, rows, id_col, text_col, "left_semi", limit)


def anti_row(df: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df that (doc_id, version) rows don't name."""
    return _by_row(df, rows, id_col, text_col, "left_anti", limit)
