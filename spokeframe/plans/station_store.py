"""Station tables kept up to date month by month: a new month is merged, old ones are not read again.

``<folder>/numbers/part=…`` holds ride numbers, ``<folder>/<side>_bitmaps/part=…`` and
``<folder>/<side>_points/part=…`` the state of each part, ``<folder>/numbered/part=…`` its rides
with their numbers, until their bitmaps are made. The station tables come from the states alone. A part is complete when its entry in ``<folder>/parts/part=…`` is there,
which is written last; what a stopped attempt left is overwritten by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import station_state
from ..operators.keeping import Keep, as_planned
from .store import deleted

SIDES = ("start", "end")
PARTS = "ordinal int"


@dataclass(frozen=True)
class StationStates:
    """The states in one folder, which all executors must reach. One writer at a time."""

    spark: SparkSession
    folder: str

    def _path(self, table: str, part: str | None = None) -> str:
        path = f"{self.folder.rstrip('/')}/{table}"
        return path if part is None else f"{path}/part={part}"

    def parts(self) -> dict[str, int]:
        """Names of the complete parts and their ordinals."""
        try:
            found = self.spark.read.schema(f"{PARTS}, part string").parquet(self._path("parts"))
        except AnalysisException:  # nothing written yet
            return {}
        return {r.part: r.ordinal for r in found.collect()}  # one row per part

    def _of_parts(self, table: str, parts: list[str], schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[self._path(table, part) for part in parts])

    def add(self, part: str, rides: DataFrame, keep: Keep = as_planned) -> None:
        """Merge the rides of a new part (say a month); reads ``rides`` and the ride numbers of the others.

        ``rides`` are clean rides and are read several times: give a stored table.
        """
        if not part or not part.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a part's name consists of letters, digits, - and _")
        done = self.parts()
        if part in done:
            raise ValueError(f"{part} has been added already")
        ordinal = max(done.values(), default=-1) + 1
        known = self._of_parts("numbers", list(done)) if done else None
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        moved = station_state.numbered_rides(rides, ordinal, known, tasks)
        moved.write.mode("overwrite").parquet(self._path("numbered", part))
        numbered = self._of_parts("numbered", [part])
        station_state.numbers_of(numbered).write.mode("overwrite").parquet(self._path("numbers", part))
        for side in SIDES:
            bitmaps = station_state.ride_bitmaps(numbered, side)
            bitmaps.write.mode("overwrite").option("compression", "zstd").parquet(self._path(f"{side}_bitmaps", part))
            points = station_state.part_points(rides, side, keep)
            points.write.mode("overwrite").parquet(self._path(f"{side}_points", part))
        deleted(self.spark, self._path("numbered", part))
        entry = self.spark.range(1).select(F.lit(ordinal).alias("ordinal"))
        entry.write.mode("overwrite").parquet(self._path("parts", part))

    def activity(self, side: str) -> DataFrame:
        """Distinct rides and a map position per station and rider group, over all parts."""
        parts = list(self.parts())
        if not parts:
            raise ValueError(f"no part has been added to {self.folder}")
        return station_state.merged_activity(
            self._of_parts(f"{side}_bitmaps", parts), self._of_parts(f"{side}_points", parts), side
        )
