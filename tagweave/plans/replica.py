"""A partial replica of a published map: it knows a manifest and holds some of its nodes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.nodes import trim
from tagweave.plans.snapshot import manifest, node_id, to_fetch


@dataclass(frozen=True)
class Replica:
    """`nodes` is the manifest of the current root; `held` (hash, k, v) are the rows fetched so far,
    `held_hashes` (hash) the nodes they came from."""

    nodes: DataFrame
    held_hashes: DataFrame
    held: DataFrame
    width: int = 16

    @classmethod
    def from_root(cls, nodes: DataFrame, state_schema: str = "hash string, k bigint, v string", width: int = 16) -> Replica:
        """A replica that knows only the root."""
        spark = nodes.sparkSession
        return cls(nodes, spark.createDataFrame([], "hash string"), spark.createDataFrame([], state_schema), width)

    def update_root(self, nodes: DataFrame | None) -> Replica:
        """Follow a new root; every node whose content is held stays usable. None clears."""
        if nodes is None:
            empty = self.nodes.limit(0)
            return replace(self, nodes=empty, held_hashes=self.held_hashes.limit(0), held=self.held.limit(0))
        return replace(self, nodes=nodes)

    def missing(self) -> DataFrame:
        return to_fetch(self.nodes, self.held_hashes)

    def ensure_range(self, least: object | None = None, most: object | None = None) -> DataFrame:
        """(node_id, hash) to fetch so that the inclusive range is complete; none when it is."""
        return to_fetch(trim(self.nodes, least, most), self.held_hashes).select("node_id", "hash")

    def fetched(self, requests: DataFrame, rows: DataFrame) -> Replica:
        """Install nodes: `requests` (node_id, hash), `rows` (k, v) of those nodes.

        The rows are hashed again; a node whose content doesn't give the requested hash raises an
        error when the replica is read.
        """
        got = manifest(rows, self.width).select("node_id", F.col("hash").alias("_got"))
        proven = requests.select("node_id", "hash").join(got, "node_id", "left").withColumn(
            "hash",
            F.when(F.col("_got") == F.col("hash"), F.col("hash")).otherwise(F.raise_error(F.concat(F.lit("content of node "), F.col("node_id").cast("string"), F.lit(" doesn't have the requested hash")))),
        )
        tagged = rows.withColumn("node_id", node_id(F.col("k"), self.width)).join(proven.select("node_id", "hash"), "node_id").select("hash", "k", "v")
        return replace(
            self,
            held_hashes=self.held_hashes.unionByName(proven.select("hash")).distinct(),
            held=self.held.unionByName(tagged).dropDuplicates(["hash", "k"]),
        )

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(k, status, v): FOUND with the value, ABSENT, or FETCH where the node isn't held."""
        asked = keys.select("k").distinct().withColumn("node_id", node_id(F.col("k"), self.width))
        placed = asked.join(self.nodes.select("node_id", "hash"), "node_id", "left")
        held = placed.join(self.held_hashes.withColumn("_has", F.lit(True)), "hash", "left")
        status = F.when(F.col("hash").isNull(), "ABSENT").when(F.col("_has").isNull(), "FETCH")
        found = held.join(self.held.withColumn("_row", F.lit(True)), ["hash", "k"], "left")
        return found.select("k", F.coalesce(status, F.when(F.col("_row").isNotNull(), "FOUND"), F.lit("ABSENT")).alias("status"), F.when(F.col("_has"), F.col("v")).alias("v"))
