"""A folder of stored graphs and the system graph that describes them.

Each database is a folder of Parquet partitioned by predicate. What happens to one is a row
appended to the log in ``_system``, and its last row is its state; the system graph has
triples of what exists: ``<name> <database_status> "already_built"``, ``<built_time>`` and
``<triples>``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans.syntax import QueryError
from quadrille.sources.graph import TripleGraph

_LOG = "name string, built boolean, at timestamp, triples long"


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _note(self, name: str, built: bool, triples: int) -> None:
        row = self.spark.createDataFrame([(name, built, triples)], "name string, built boolean, triples long")
        row.select("name", "built", F.current_timestamp().alias("at"), "triples").coalesce(1).write.mode("append").parquet(f"{self.folder}/_system")

    def databases(self) -> DataFrame:
        """name, at, triples of the databases that exist."""
        if not self._exists("_system"):
            return self.spark.createDataFrame([], _LOG).select("name", "at", "triples")
        last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("at")))
        log = self.spark.read.schema(_LOG).parquet(f"{self.folder}/_system").withColumn("turn", last)
        return log.where("turn = 1 and built").select("name", "at", "triples")

    def system(self) -> TripleGraph:
        """The system graph."""
        facts = [("database_status", T.literal(F.lit("already_built"))), ("built_time", T.literal(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), T.XSD + "dateTime")), ("triples", T.literal(F.col("triples").cast("string"), T.XSD + "integer"))]
        rows = F.inline(F.array(*[F.struct(T.iri(F.col("name")).alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o")) for p, o in facts]))
        return TripleGraph(self.databases().select(rows))

    def build(self, name: str, graph: TripleGraph) -> TripleGraph:
        """Stores a graph under a name that is free."""
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", name):
            raise QueryError(f"{name!r} can't name a database")
        if name in self.names():
            raise QueryError(f"database {name} exists")
        graph.save(f"{self.folder}/{name}", "overwrite")  # what a build that failed has left goes
        stored = TripleGraph.load(self.spark, f"{self.folder}/{name}")
        self._note(name, True, stored.triples().count())
        return stored

    def names(self) -> list[str]:
        return sorted(r.name for r in self.databases().collect())

    def load(self, name: str) -> TripleGraph:
        if name not in self.names():
            raise QueryError(f"no database {name}")
        return TripleGraph.load(self.spark, f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        self.load(name)
        self._note(name, False, 0)
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
