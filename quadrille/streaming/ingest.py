"""A folder of N-Triples files as a stream into a triple table partitioned by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadrille.sources.files import ntriples_terms


def triple_stream(spark: SparkSession, folder: str) -> DataFrame:
    """s, p, o of each new file's lines."""
    return ntriples_terms(spark.readStream.text(folder))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there, and stops; repeated triples are dropped when the table is
    loaded as a graph (``TripleGraph.of``)."""
    return stream.writeStream.format("parquet").partitionBy("p").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
