"""Tables bucketed by key, so that joins on the key leave them where they are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path


def bucketed(df: DataFrame, keys: list[str], name: str = "buckets", buckets: int | None = None,
             sort: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``keys``, one file a bucket.

    It is shuffled once, here. A later join or aggregation on all of ``keys`` shuffles the other
    side only. ``buckets`` defaults to the shuffle partition count, so both agree. The catalog
    entry goes at once; the files stay until the application ends (see ``scratch_path``).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*keys)
    writer.option("path", scratch_path(spark, name)).format("parquet").saveAsTable(table)
    stored = spark.table(table)
    stored.schema                       # resolved while the entry is there
    spark.sql(f"DROP TABLE {table}")
    return stored
