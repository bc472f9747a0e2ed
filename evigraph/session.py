"""Session setup, reliable lineage cuts and the size checks the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "evigraph", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Broadcasting is left to Catalyst and AQE, which check sizes at run time; no operator
    forces it. Skew joins may add a shuffle, because hub nodes and hot sources are expected.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A shared table; the path is opened by Spark alone, so any store it knows will do."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that every executor sees.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse, which the
    executors share as well. A machine-local temporary folder is never used.
    """
    top = (spark.conf.get("spark.checkpoint.dir", None)
           or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch")
    return f"{top.rstrip('/')}/evigraph-{spark.conf.get('spark.app.id')}"


def _files(spark: SparkSession, path: str):
    """The store of ``path`` and the path in it; ``None`` where Spark gives no access to it."""
    gateway = getattr(spark, "_jvm", None)
    if gateway is None:
        return None
    target = gateway.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


_MADE: list[str] = []


def scratch_made() -> list[str]:
    """All scratch paths of this process, oldest first."""
    return list(_MADE)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder, which goes when the application ends."""
    top = shared_dir(spark)
    store = _files(spark, top)
    if store:
        store[0].mkdirs(store[1])
        store[0].deleteOnExit(store[1])
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "level") -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Iterative operators call this once per level: a lost executor replays one level instead
    of the whole loop, every use of a level reads the same rows, and Catalyst knows the size
    of what it joins next. ``drop_scratch`` removes a level whose readers are done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path; nothing may read it afterwards."""
    store = _files(spark, path)
    if store and path in _MADE:
        store[0].delete(store[1], True)
        _MADE.remove(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut_lineage``; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        store = _files(spark, folder)
        if store and "/evigraph-" in folder:
            store[0].delete(store[1], True)


def rule_rows(rules, columns: tuple[str, ...]) -> list[tuple]:
    """Rows of a rule table (a DataFrame or a list of tuples) on the driver.

    Rule tables are parameters of a job: they are written into its plan or sent to its tasks
    once, and are as large as a plan or a task can hold, not as large as the data.
    """
    if isinstance(rules, DataFrame):
        return [tuple(r) for r in rules.select(*columns).collect()]
    return [tuple(r) for r in rules]
