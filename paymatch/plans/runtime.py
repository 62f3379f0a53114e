"""Session plumbing: the shared working folder and cuts in the lineage."""

from __future__ import annotations

import re
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict = {}
_SHIPPED: set[str] = set()
_STAGED: list[str] = []
_COLLECTED: dict[str, float] = {}


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application; where they have it already it does no harm."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='paymatch-code-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


#: How many times larger the rows of a few columns can be than Spark's estimate from the compressed files (15 measured on orders).
ESTIMATE_FACTOR = 16
_STATIC, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def broadcast_by_measured_size(spark: SparkSession) -> None:
    """Hold the session's broadcast limit against sizes measured at run time, and against estimates a fraction of it.

    Spark estimates a scan by its compressed files and builds what it takes for small in the driver.  A session that sets the
    adaptive limit itself, or broadcasts nothing, keeps its settings.
    """
    limit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(_STATIC).strip().lower())
    if limit and spark.conf.get(_MEASURED, None) is None:
        size = int(limit[1]) << 10 * " kmgt".index(limit[2] or " ")
        spark.conf.set(_MEASURED, str(size))
        spark.conf.set(_STATIC, str(size // ESTIMATE_FACTOR))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`; a private one only on a local master where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="paymatch-"))


#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 2.0


def collect_garbage(spark: SparkSession) -> bool:
    """Have the driver collect its garbage, unless it did so just now; says whether it did.

    Spark drops the shuffle files and broadcasts of finished steps, on executors too, only when the driver has collected what
    refers to them, and a driver that plans dozens of steps in a row lets its heap grow to the limit first.
    """
    application, now = spark.sparkContext.applicationId, time.monotonic()
    due = now - _COLLECTED.get(application, -COLLECT_EVERY) >= COLLECT_EVERY
    if due:
        _COLLECTED[application] = now
        spark._jvm.System.gc()
    return due


def stage(df: DataFrame) -> DataFrame:
    """Write a result several later steps read to the shared folder and go on from the files.

    Later readers then see one fixed result even if executors are lost, and do not recompute it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/paymatch-stage/{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def staged() -> list[str]:
    """Folders that `stage` wrote and `forget` has not removed, oldest first."""
    return list(_STAGED)


def forget(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> None:
    """Remove staged folders whose readers are done, but for those that `but` still reads."""
    read = but.inputFiles() if but is not None else []
    for path in paths:
        if path in _STAGED and not any(path.rsplit("/", 1)[-1] in file for file in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            _STAGED.remove(path)


def release(*frames: DataFrame) -> None:
    """Remove the staged folders that these tables are read from, once nothing reads them any more."""
    for df in frames:
        names = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
        forget(df.sparkSession, [path for path in staged() if path.rsplit("/", 1)[-1] in names])
