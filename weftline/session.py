"""Sessions, and the folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "weftline", **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the
    session. Only where that is unset and the master is local (tests, notebooks
    on one machine) a temporary folder is made; a cluster must name one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"weftline-{os.getuid()}")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so
    that iterations keep short lineages and survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files that made ``df`` are removed: work in
    rounds then holds the disk of one round. Spark removes them itself where its
    setting is known; else they go when the driver collects its garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return cut(df.select("*"))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def grows(df: DataFrame) -> DataFrame:
    """Marks a side of a join as one that grows with the data: the join then
    shuffles both sides. The planner's guess of such a side's size can be off by
    as much as a kernel multiplies rows, and would have it broadcast unchecked."""
    return df.hint("merge")
