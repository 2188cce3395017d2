"""What the operators of this subpackage share: tables, written intermediates, shipped code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh_name(df: DataFrame, wish: str) -> str:
    """A helper column's name that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wish}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def making_room(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns that an operator is about to add, whatever the case of their letters: the operator's take their place."""
    wanted, kept = {n.lower() for n in names}, {k.lower() for k in keep}
    gone = {c for c in df.columns if c.lower() in wanted and c.lower() not in kept}
    return df.select([F.col(f"`{c}`") for c in df.columns if c not in gone]) if gone else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session has one.

    Only where it is unset (a local session, as in tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors once a session, for the operators with Python kernels."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="siltstone-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "siltstone_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
