"""Intermediate tables in the shared checkpoint folder, and the sources that Python tasks need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would lose the table with its executor, so that is an error.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    path = tempfile.mkdtemp(prefix="lectern-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, partition_by: str | None = None, rows_held: int | None = None) -> DataFrame:
    """Write a table that several later steps read, and go on from the written copy.

    A column named by ``partition_by`` becomes folders, which readers can skip. Writers and readers hold
    up to 20,000,000 rows or about 128 MB at once, before decoding; where rows are large, ``rows_held`` is
    the number that they hold.

    The copy cuts the lineage, survives the loss of executors, and tells Spark its size, so
    joins with it can be planned on facts. Each application writes to its own sub-folder,
    which can be dropped once the application is done.
    """
    spark = df.sparkSession
    run = f"lectern-{spark.sparkContext.applicationId}"
    path = f"{staging_dir(spark)}/{run}/{uuid.uuid4().hex}"
    write = df.write.option("parquet.block.row.count.limit", rows_held) if rows_held else df.write
    (write.partitionBy(partition_by) if partition_by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's sources to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    library = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
    with zipfile.ZipFile(file, "w") as out:
        for source in sorted(library.rglob("*.py")):
            out.write(source, source.relative_to(library.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)
