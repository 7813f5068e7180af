"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "storelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC semantics, AQE and skew handling; callers may override any key."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All day, hour and week arithmetic of the library is defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session (tests) may go without and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder, so that later plans start from them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def large(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast: a table of catalog, index or log size, whose compressed files
    (and the sizes Spark guesses from them for what is derived) can look small enough for it."""
    return df.hint("merge")


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, a folder per value of ``by``: later plans start from a scan of it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
