"""Stored tables that are updated by key in place, a part at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage, drop_scratch

PART = "part"


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table with at most one row per key, in ``parts`` folders by a hash of the key.

    ``upsert`` reads and replaces only the folders that hold a changed key; the files of the
    others stay. It may be repeated: the same rows give the same table, also after a run that
    broke off between two folders. One writer at a time. Null keys are a key like any other.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    parts: int = 64

    def _with_part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))

    def _stored(self) -> DataFrame:
        self._with_part(self.spark.createDataFrame([], self.schema)).drop(PART) \
            .write.mode("ignore").parquet(f"{self.path}/{PART}=-1")             # makes the folder exist
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(PART, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def reset(self) -> None:
        """Leave an empty table."""
        touched = [r[0] for r in self._stored().select(PART).distinct().collect()]      # at most ``parts``
        self._replace(self.spark.createDataFrame([], self.schema), touched)

    def upsert(self, rows: DataFrame, seq: str) -> int:
        """Replace or add rows by key; of several for one key the highest ``seq`` counts. Folders written."""
        names = self.schema.names
        rest = [c for c in names if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(
            *[F.col(c if c in self.key else f"_r.{c}").alias(c) for c in names])
        newest = cut_lineage(self._with_part(newest), "newest")
        touched = [r[0] for r in newest.select(PART).distinct().collect()]              # at most ``parts``
        if not touched:
            return 0
        new = newest.select(*[F.col(c).alias(f"_new_{c}") for c in (*self.key, PART)])
        old = self._stored().where(F.col(PART).isin(touched))
        same = F.col(PART) == F.col(f"_new_{PART}")
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
        self._replace(old.join(new, same, "left_anti").unionByName(newest).drop(PART), touched)
        drop_scratch(newest)
        return len(touched)

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        # what replaces a folder is written elsewhere first, as it is made from that folder
        merged = cut_lineage(self._with_part(rows), "merged")
        merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(PART).parquet(self.path)
        left = {r[0] for r in merged.select(PART).distinct().collect()}
        for part in touched:
            if part not in left and part >= 0:          # nothing is left of this folder
                merged.limit(0).drop(PART).write.mode("overwrite").parquet(f"{self.path}/{PART}={part}")
        drop_scratch(merged)
