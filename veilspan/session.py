"""Session helpers for tests, the benchmark and interactive use.

Library code never builds a session; it works with the one it is given.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def local_session(cores: int = 8, name: str = "veilspan", memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites are captured for every column expression otherwise, which takes longer than short jobs
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _single_machine(master: str) -> bool:
    """``local``, ``local[8]`` and ``local[*,2]`` share one disk; ``local-cluster[...]`` and the rest do not."""
    return master == "local" or master.startswith("local[")


def choose_folder(master: str, configured: str | None) -> str:
    """The folder that every executor sees: the configured one; a new local one only on one machine."""
    if configured:
        return configured
    if not _single_machine(master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="veilspan-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables (see ``choose_folder``)."""
    if not hasattr(spark, "_veilspan_folder"):
        conf = spark.sparkContext.getConf()
        configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
        spark._veilspan_folder = choose_folder(spark.sparkContext.master, configured)
    return spark._veilspan_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_folder(spark), "veilspan"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read back column by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veilspan-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables(spark).append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._veilspan_path = path
    return made


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made; no frame that is still to be computed may read them."""
    for frame in frames:
        if (path := vars(frame).get("_veilspan_path")) in _tables(frame.sparkSession):
            _tables(frame.sparkSession).remove(path)
            _delete(frame.sparkSession, path)


def _tables(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_veilspan_tables"):
        spark._veilspan_tables = []
    return spark._veilspan_tables


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made in this session; frames that read them are then of no use."""
    paths = _tables(spark)
    done = len(paths)
    while paths:
        _delete(spark, paths.pop())
    return done
