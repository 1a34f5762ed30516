"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import save, scratch_path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    save(df, path, codec=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that written() gave, once nothing reads them any more: what was made of them is
    written itself.  Nothing outside the folder of intermediate tables is touched."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/reviewlab/llm-" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent whole to the driver and every executor.  The planner takes a written
    table for its compressed files, and an exploded or aggregated one for less than its rows, and may find it small
    enough for that; tables whose rows follow the input's go through a shuffle."""
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(*taken: str) -> str:
    """A column name that clashes with none of the user's."""
    name = f"__{uuid.uuid4().hex[:8]}"
    return name if name not in taken else fresh(*taken)


def fingerprint_of(df: DataFrame) -> tuple:
    """(rows, order-free checksum) of a table, in one job."""
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()
    return row[0], row[1]
