"""Session set-up and the two ways this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here expects (UTC, AQE with skew joins, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that they need no copy of it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    home = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(made))
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing on one machine (tests) a local folder is made and set; with a master that is not
    local a missing setting is an error, since executors would write to folders of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        named = current.rsplit("/", 1)[0] if current else "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    path = os.path.join(shared_dir(spark), "tessera", f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of a table from another: number, size and latest change of its files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    latest, size, count = 0, 0, 0
    files = fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        latest, size, count = max(latest, f.getModificationTime()), size + f.getLen(), count + 1
    return f"{count}-{size}-{latest}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def clear(spark: SparkSession) -> int:
    """Delete the tables :func:`cut` and :func:`scratch` made in this session; their frames cannot be read any more."""
    n = 0
    while _MADE:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    return n


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: the lineage ends there,
    column pruning still reaches the scan, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
