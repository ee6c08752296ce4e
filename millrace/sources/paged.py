"""A paged row API as a Spark data source: one partition for each offset, retries on busy answers, failures as rows.

`fetch(offset, length)` is given by the caller and returns {"rows": [...], "total": n};
here, without a network, it reads files or is a stub.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Busy(Exception):
    """An answer that says to come again, with the seconds to wait if it says so."""

    def __init__(self, wait: float = 0.0) -> None:
        self.wait = wait


def with_retries(fetch: Callable[[], dict], retries: int = 3, pause: float = 1.0) -> dict:
    """fetch(), again after a pause while it raises Busy; the last failure is raised."""
    for attempt in range(retries):
        try:
            return fetch()
        except Busy as b:
            if attempt + 1 == retries:
                raise
            time.sleep(b.wait or pause * (attempt + 1))
    raise ValueError("retries must be positive")


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


def row_count(info: Callable[[], dict]) -> int | None:
    """The number of rows that an answer states as `total`; None if there is no answer or it isn't a positive number."""
    try:
        total = with_retries(info, pause=0.01).get("total")
    except Exception:  # noqa: BLE001  without a count, pages are visited in turn
        return None
    return total if isinstance(total, int) and not isinstance(total, bool) and total > 0 else None


def register(spark: SparkSession, name: str, fetch: Callable[[int, int], dict], first: Callable[[], dict] | None = None) -> None:
    """Registers the source `name`; options: offsets (comma-separated), length. first: another way to the first page, if fetch fails there."""

    class Reader(DataSourceReader):
        def __init__(self, options) -> None:
            self.offsets = [int(x) for x in options.get("offsets", "0").split(",")]
            self.length = int(options.get("length", "16"))

        def partitions(self) -> list[Page]:
            return [Page(o) for o in self.offsets]

        def read(self, partition: Page) -> Iterator[tuple]:
            try:
                try:
                    page = with_retries(lambda: fetch(partition.offset, self.length), pause=0.01)
                except Exception:  # noqa: BLE001
                    if partition.offset or first is None:
                        raise
                    page = with_retries(first, pause=0.01)
            except Exception as e:  # noqa: BLE001  a failed page is a row that says so
                yield (partition.offset, None, None, f"{type(e).__name__}: {e}")
                return
            for i, row in enumerate(page["rows"]):
                yield (partition.offset, partition.offset + i, json.dumps(row, sort_keys=True, ensure_ascii=False), None)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "offset long, row_idx long, raw string, error string"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    spark.dataSource.register(Source)


def pages(spark: SparkSession, name: str, offsets: list[int], length: int) -> DataFrame:
    """(offset, row_idx, raw, error) of the pages at the offsets."""
    return spark.read.format(name).option("offsets", ",".join(map(str, offsets))).option("length", str(length)).load()


def enriched(catalog: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A catalogue with what was fetched of its entries: facts (key, facts, error), several or none an entry; the first good answer counts,
    else the first error, which is recorded in `error`."""
    from pyspark.sql import functions as F

    one = facts.groupBy(key).agg(F.min("facts").alias("facts"), F.min("error").alias("_error"))
    return catalog.join(one, key, "left").withColumn("error", F.when(F.col("facts").isNull(), F.col("_error"))).drop("_error")


def search(bank: DataFrame, hits: DataFrame, allowed, limit: int) -> DataFrame:
    """The first `limit` allowed hits of each query of the bank; hits: query, rank, and what `allowed` looks at."""
    from millrace.operators.sampling import head

    return head(bank.join(hits, "query").filter(allowed), "query", ["rank"], limit)
