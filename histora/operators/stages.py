"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where that is unset and all tasks run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs start from its files, whichever executors are lost.

    Files stay as long as the folder does, since the frames that read them are evaluated later.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with the columns numbered by place (_0, _1 and so on), since it can't be given names with dots."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Equality of keys in which null equals null; right's keys are renamed with a leading underscore pair."""
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match, as identifiers that are absent on both sides do. Keys of left are kept."""
    joined = left.join(keyed(right, keys), same(left, right, keys), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))
