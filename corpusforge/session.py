"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
#: Where a context keeps the shared folders that were handed out, and the indexes that lie in them.
FOLDERS, INDEXES = "_corpusforge_folders", "_corpusforge_indexes"


def session(app: str = "corpusforge", cores: str = "*") -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the submitter's settings win."""
    return SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their Python path has it already."""
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in known or getattr(spark.sparkContext, "_corpusforge_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="corpusforge-")) / "corpusforge_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*(ROOT / "corpusforge").rglob("*.py"), *ROOT.glob("*.py")]:
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._corpusforge_sent = True


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares (spark.checkpoint.dir); in local mode one below /tmp where none is named."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/checkpoints"
    folder = f"{top.rstrip('/')}/corpusforge-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault(FOLDERS, []).append(folder)
    return folder


def drop_folders(spark: SparkSession) -> int:
    """Remove all shared folders that this session was given, and forget the indexes in them; how many there were.

    Results are lazy and read from these folders: call this when none of them is needed any more.
    """
    own = spark.sparkContext.__dict__
    folders = own.pop(FOLDERS, [])
    own.pop(INDEXES, None)
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, folder: str) -> None:
    """Remove one shared folder that nothing reads any more."""
    spark.sparkContext.__dict__.get(FOLDERS, []).remove(folder)
    _delete(spark, folder)


def settled(df: DataFrame, **options: str) -> DataFrame:
    """df computed once: written to the shared folder (with the writer's options) and read again, so that no lost executor takes it away."""
    return stored(df, shared_folder(df.sparkSession), **options)


def stored(df: DataFrame, folder: str, **options: str) -> DataFrame:
    """settled() into a folder that the caller got from shared_folder() and may drop."""
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pruning(*columns: str) -> dict[str, str]:
    """Writer's options for columns that are looked up by value: a Bloom filter for each row group, beside the least and greatest value that every Parquet file has."""
    return {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
