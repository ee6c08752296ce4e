"""Session, table and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set already. Only a local session, which has no other
    machines, gets a temporary one; on a cluster a missing folder is an error."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="millrace-"))
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame, fresh: bool = False) -> DataFrame:
    """`df`, computed once, with its lineage cut by files in the shared folder, so that it outlives any executor.

    A checkpoint keeps the estimated size of its plan. Where tables of one round are joined into those of the next, these
    estimates multiply until planning takes all memory; `fresh` forgets them, and AQE goes by the sizes it meets.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    if fresh:
        j = out._jdf
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(j.queryExecution().toRdd(), j.schema(), False), spark)
    return out


#: Bytes of a scan up to which it is spread: at most that much is ever shuffled for it.
SPREAD_BYTES = 1 << 28


def spread(df: DataFrame) -> DataFrame:
    """`df` of few bytes in as many partitions as there are cores, for costly work on each row.

    Large tables are split by their files' sizes already and are never shuffled for this, whatever the number of cores: the
    size is that of the optimized plan, which for columns of a scan follows from its files.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: int | None = None, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
