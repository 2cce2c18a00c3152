"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: The folder of a context that names none.
_local: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as the session has it. Where it is unset and Spark runs in one process
    (tests), a folder of this machine; anywhere else that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        known = sc._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if where is None and sc in _local:
        return _local[sc]
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = _local[sc] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


#: Where the tables of `as_leaf` are that are still there.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def as_leaf(df: DataFrame) -> DataFrame:
    """`df`, computed once into a table of the shared folder and read back.

    The table is a plain scan to what follows: with its size known, and without the constraints that a
    checkpoint hands on, which pile up over the rounds of an iteration. It lies in the application's own folder,
    which can be deleted when that has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry_{spark.sparkContext.applicationId}/leaf_{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def drop_leaf(*leaves: DataFrame) -> None:
    """Deletes tables that `as_leaf` returned, once all that was made of them is written. What else reads them fails from now on."""
    for leaf in leaves:
        path = _written.pop(leaf, None)
        if path is not None:
            jvm = leaf.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(leaf.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
