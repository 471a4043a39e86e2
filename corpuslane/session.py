"""Session construction and the few session facts that operators need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution, for tests, benchmarks and small hosts."""
    spark = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each context; also to those that start later."""
    sc = spark.sparkContext
    if not getattr(sc, "_has_corpuslane", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corpuslane-")) / "corpuslane.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._has_corpuslane = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a local master (tests, a single host) gets a folder of its own; on a cluster it is an error, as
    a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpuslane-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder (see shared_dir)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
