"""Long collection as a stream: each micro-batch passes the gates, is deduplicated against all accepted rows, and is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import first_accepted
from millrace.sources.jsonl import exists


#: Hexadecimal digits of a key's digest that name its folder: 256 folders.
DIGITS = 2


class Collection:
    """Accepted and rejected rows in a folder, with reasons and cycle; digests of the keys of accepted rows are the history of the next cycle.

    `gates` gives the reasons of a row other than being a duplicate; `keys` are its key columns; `order` puts the rows
    of a cycle in order. A cycle that was stored already, as after a restart, is skipped.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], gates: Callable[[], Column]) -> None:
        self.spark, self.folder, self.keys, self.order, self.gates = spark, folder, keys, order, gates

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def accepted(self) -> DataFrame:
        return self.spark.read.parquet(self._path("accepted"))

    def rejected(self) -> DataFrame:
        return self.spark.read.parquet(self._path("rejected"))

    def merge(self, batch: DataFrame, cycle: int) -> None:
        """Takes one cycle in."""
        spark = batch.sparkSession
        if exists(spark, f"{self._path('status')}/cycle={cycle}"):
            return
        # keys are kept as digests, in folders by their first digits; a cycle reads the folders that its own keys lie in
        gated = batch.withColumn("reject_reasons", self.gates()).withColumn("_h", F.sha2(F.to_json(F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys))), 256)).persist()
        history = None
        if exists(spark, self._path("keys")):
            touched = [r[0] for r in gated.select(F.left("_h", F.lit(DIGITS))).distinct().collect()]  # at most 16**DIGITS
            kept = spark.read.schema("_h string, cycle int, part string").parquet(self._path("keys"))
            # a cycle that broke off may have left keys of its own
            history = kept.filter(F.col("part").isin(touched) & (F.col("cycle") != cycle)).select("_h")
        marked = first_accepted(gated, ["_h"], [F.col(c) for c in self.order], F.size("reject_reasons") == 0, history)
        done = marked.withColumn("reject_reasons", F.when(F.col("duplicate"), F.concat(F.array(F.lit("duplicate_pair_or_instruction")), F.col("reject_reasons"))).otherwise(F.col("reject_reasons"))).drop("duplicate").withColumn("cycle", F.lit(cycle)).persist()
        # each cycle has its own folder and replaces it, so one that broke off is written again whole
        new = done.filter(F.size("reject_reasons") == 0)
        new.select("_h", F.left("_h", F.lit(DIGITS)).alias("part")).repartitionByRange("part").write.mode("overwrite").partitionBy("part").parquet(f"{self._path('keys')}/cycle={cycle}")
        new.drop("reject_reasons", "cycle", "_h").write.mode("overwrite").parquet(f"{self._path('accepted')}/cycle={cycle}")
        done.filter(F.size("reject_reasons") > 0).drop("cycle", "_h").write.mode("overwrite").parquet(f"{self._path('rejected')}/cycle={cycle}")
        done.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reject_reasons") == 0).alias("accepted_rows")).write.mode("overwrite").parquet(f"{self._path('status')}/cycle={cycle}")
        self._event(spark, cycle)
        done.unpersist()
        gated.unpersist()

    def _event(self, spark: SparkSession, cycle: int) -> None:
        """One line more in the event log: the cycle is stored."""
        spark.range(1).select(F.lit("cycle_stored").alias("event"), F.lit(cycle).alias("cycle"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(self._path("events"))

    def status(self) -> DataFrame:
        """(rows, accepted_rows, cycle) of each cycle."""
        return self.spark.read.parquet(self._path("status"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes in all that the stream has now, one cycle a micro-batch."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
