"""The annotation layer of a corpus: which tables it has, in what state, and what they hold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import numbered, path_exists, read_text, write_text_atomic

#: Sublayers and the ones each builds on.
SUBLAYERS = {"tokens": [], "entities": ["tokens"], "typing": ["entities"], "traits": ["entities"], "relations": ["entities", "typing"], "graph": ["entities", "relations"]}


class AnnotationLayer:
    """Sublayers as folders of tables under ``path``, with a numbered record of every change of state.

    A sublayer is attached once and replaced only when asked; replacing one marks those that build on
    it as stale. A sublayer counts once its record is written, which happens after its tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> dict[str, dict]:
        """The last record of each sublayer: {version, status, tables}."""
        last = numbered(self.spark, f"{self.path}/states")
        return json.loads(read_text(self.spark, f"{self.path}/states/{last[-1]}.json")) if last else {}

    def _record(self, state: dict[str, dict]) -> None:
        write_text_atomic(self.spark, f"{self.path}/states/{len(numbered(self.spark, f'{self.path}/states'))}.json", json.dumps(state, sort_keys=True), once=True)

    def attach(self, name: str, tables: dict[str, DataFrame], overwrite: bool = False) -> None:
        """Store the tables of a sublayer; what it builds on must be there and not stale."""
        if name not in SUBLAYERS:
            raise KeyError(f"unknown sublayer {name}")
        state = self.state()
        if name in state and not overwrite:
            raise ValueError(f"{name} is attached already; ask for overwriting")
        for below in SUBLAYERS[name]:
            self.require(below)
        version = state.get(name, {"version": -1})["version"] + 1
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/{version}/{table}")
        state[name] = {"version": version, "status": "ready", "tables": sorted(tables)}
        for above, needs in SUBLAYERS.items():
            if name in needs and above in state:
                state[above]["status"] = "stale"
        self._record(state)

    def mark(self, name: str, status: str) -> None:
        state = self.state()
        state[name]["status"] = status
        self._record(state)

    def require(self, name: str) -> dict:
        """The record of a sublayer that can be used, an error otherwise."""
        found = self.state().get(name)
        if found is None:
            raise ValueError(f"{name} is not attached")
        if found["status"] != "ready":
            raise ValueError(f"{name} is {found['status']}")
        return found

    def table(self, name: str, table: str) -> DataFrame:
        version = self.require(name)["version"]
        folder = f"{self.path}/{name}/{version}/{table}"
        if not path_exists(self.spark, folder):
            raise KeyError(f"{name} has no table {table}")
        return self.spark.read.parquet(folder)

    def summary(self) -> DataFrame:
        """(sublayer, status, table_name, n_rows) of everything attached."""
        rows = None
        for name, found in sorted(self.state().items()):
            for table in found["tables"]:
                one = self.spark.read.parquet(f"{self.path}/{name}/{found['version']}/{table}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("sublayer"), F.lit(found["status"]).alias("status"), F.lit(table).alias("table_name"), "n_rows")
                rows = one if rows is None else rows.union(one)
        return rows if rows is not None else self.spark.createDataFrame([], "sublayer string, status string, table_name string, n_rows bigint")


def with_profiles(clusters: DataFrame, profiles: DataFrame, key: tuple[str, ...] = ("doc_id", "cluster_id"), overwrite: bool = False) -> DataFrame:
    """Clusters with a profile's columns, null where a cluster has none; columns already there are replaced only when asked."""
    added = [c for c in profiles.columns if c not in key]
    there = [c for c in added if c in clusters.columns]
    if there and not overwrite:
        raise ValueError(f"clusters have {', '.join(there)} already; ask for overwriting")
    return clusters.drop(*there).join(profiles, list(key), "left")
