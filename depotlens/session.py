"""Session settings and the shared work folder.

Nothing here picks a physical strategy: broadcast thresholds, partition sizes and skew handling stay with the cluster's
configuration and adaptive execution.  The module only answers two questions every operator has: where may an intermediate
table be written so that all executors see it, and how many partitions suit the data.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (local tests) a temporary one."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _local_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dir = "file://" + tempfile.mkdtemp(prefix="depotlens-")
    return _local_dir


class Workspace:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors, unlike a local checkpoint.  ``drop`` removes tables that are superseded;
    what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Writes df as Parquet; gives the table read back, and its path."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session is gone and cannot delete any more
            pass


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, so that they need no copy of it on their path."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="depotlens-package-"))
        shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
        _shipped.add(app)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole or not at all; False when there is one of that name already."""
    jvm = spark.sparkContext._jvm
    name, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(name) and fs.rename(draft, name):
        return True
    fs.delete(draft, False)
    return False


def get_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    stream = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(name)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, such as one small file, spread over all cores for costly work.

    Larger scans come back as they are, without a shuffle.  For plain scans only: others would be executed to count partitions."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
