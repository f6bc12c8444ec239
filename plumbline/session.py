"""Session settings, table reading, and cutting of lineage in shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "plumbline") -> SparkSession:
    """A local session with the settings that all operators expect: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: by its folder, and on a cluster also by a zip file that Spark sends."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not sc.master.startswith("local[") and sc.master != "local" and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        path = os.path.join(tempfile.mkdtemp(), "plumbline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(os.path.join(root, "plumbline")):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner removes it
        pass


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        _remove(path, spark)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    The result survives the loss of executors, and what hangs on it isn't computed twice. Shuffle files of the steps
    before it are no longer needed then and are removed at once. The folder is removed when the program ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    if spark.conf.get(_CLEANUP, "false") != "true":  # from here on in this session, so that threads don't disturb each other
        spark.conf.set(_CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path  # for ``drop``
    return out


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by ``materialise`` that nothing needs any longer."""
    path = getattr(df, "_plumbline_path", None)
    if path in _written:
        _remove(path, _written.pop(path))
