"""Scoring of requests, in batches or as a stream: each request is answered with a status and a JSON body."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths of requests.
VERIFIER, AGENT = "/score_verifier", "/score_agent"


def responses(requests: DataFrame, schema: str, scorers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(id, status, body) of requests (id, path, body): 200 and the score as JSON, 400 for a body that isn't a JSON object, 404 for an unknown path.

    schema: of a body; scorers: by path, from the parsed body to a struct. All are column expressions, so a stream is scored as a batch is.
    """
    item = F.from_json("body", schema)
    valid = F.trim("body").startswith("{") & F.try_parse_json("body").isNotNull()
    status = F.when(~F.col("path").isin(*scorers), 404).when(~F.coalesce(valid, F.lit(False)), 400).otherwise(200)
    answer = F.lit(None).cast("string")
    for path, score in scorers.items():
        answer = F.when(F.col("path") == path, F.to_json(score(item))).otherwise(answer)
    error = F.when(status == 404, F.lit('{"error":"not found"}')).when(status == 400, F.lit('{"error":"invalid json"}'))
    return requests.select("id", status.alias("status"), F.coalesce(error, answer).alias("body"))


def serve(stream: DataFrame, schema: str, scorers: dict[str, Callable[[Column], Column]], folder: str, checkpoint: str) -> None:
    """Answers all requests that a stream has now, as JSON lines in a folder; a restart answers none again."""
    query = responses(stream, schema, scorers).writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
