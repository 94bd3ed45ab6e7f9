"""Base table plus delta log: writes are appended, reads merge, compaction folds the delta in.

The answer is the same before and after compaction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.keyed import MapTable, replay
from tagweave.session import cut


@dataclass(frozen=True)
class BufferedMap:
    """`base` is a state (key, values...), `delta` a log (key, values..., seq, op)."""

    base: DataFrame
    delta: DataFrame
    key: str = "k"
    limit: int = 1_000_000

    def write(self, ops: DataFrame) -> BufferedMap:
        """Append operations; they need no order, `seq` decides."""
        return BufferedMap(self.base, self.delta.unionByName(ops.select(*self.delta.columns)), self.key, self.limit)

    def read(self) -> MapTable:
        """base (+) delta. The base is not shuffled when the delta is small enough to broadcast,
        which Spark decides by its size."""
        live = self.delta.filter(F.col(self.key).isNotNull())
        touched = live.select(self.key).distinct()
        changed = replay(live, [self.key])
        return MapTable(self.base.join(touched, self.key, "left_anti").select(*self.base.columns).unionByName(changed.select(*self.base.columns)), self.key)

    def lookup(self, *keys: object) -> DataFrame:
        part = BufferedMap(self.base.filter(F.col(self.key).isin(*keys)), self.delta.filter(F.col(self.key).isin(*keys)), self.key, self.limit)
        return part.read().df

    def needs_compaction(self) -> bool:
        return self.delta.count() > self.limit

    def folded(self) -> BufferedMap:
        """The merged state as base, in the session's checkpoint folder, and an empty delta."""
        return BufferedMap(cut(self.read().df), self.base.sparkSession.createDataFrame([], self.delta.schema), self.key, self.limit)

    def compact(self, path: str) -> BufferedMap:
        """Write the merged state to `path` (not the folder of the current base), empty the delta."""
        spark = self.base.sparkSession
        self.read().df.write.mode("errorifexists").parquet(path)
        return BufferedMap(spark.read.parquet(path), spark.createDataFrame([], self.delta.schema), self.key, self.limit)
