"""SparkSession defaults and the shared scratch folder.

Nothing here is required on a cluster: every operator takes the caller's session.
``local_session`` is what the tests and the bench use.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # small inputs on one machine: without these a few megabytes end up in one task
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) is a folder of this
    machine used; on a cluster that would leave each executor's part on its own disk, so there
    the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
        os.makedirs(path, exist_ok=True)
        path = "file://" + path
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    This cuts the lineage without tying the result to executors: a lost executor costs
    nothing, because the table lies in the folder that all of them share.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(name: str, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written the first time and read again as long as the files behind
    ``inputs`` (names, sizes and times of change) are the same: an index is built once for a
    state of the corpus, not once for each query over it."""
    spark = inputs[0].sparkSession
    conf, files = spark._jsc.hadoopConfiguration(), []
    for f in sorted({f for df in inputs for f in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(files))
    if key in _held:
        path, schema = _held[key]
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return spark.read.schema(schema).parquet(path)
    df = materialise(build(), name)
    _held[key] = (_written[-1], df.schema)
    return df


_held: dict[tuple, tuple] = {}
_written: list[str] = []


def clear_materialised(spark: SparkSession) -> int:
    """Delete the tables this process has written with ``materialise`` and return their number; to be
    called when the results built on them have been read."""
    done = 0
    _held.clear()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done
