"""Session helpers shared by operators, queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "lodestone") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # small inputs still use all threads
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "128k")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a lazily scanned Parquet DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all threads, if they come in fewer partitions than there are; large inputs stay as they are.

    For scans that feed costly functions: one small file would otherwise be one task.
    """
    sc, plan = df.sparkSession.sparkContext, df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # it exchanges rows anyway, and asking for its partitions would run it
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= sc.defaultParallelism else df.repartition(sc.defaultParallelism)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share for intermediate tables.

    A folder that the cluster names (``spark.checkpoint.dir``, or one set on the
    context) is used as it is. Only a local master without one gets a temporary
    folder; on a cluster a machine-local folder would be lost with its machine,
    so there the missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        folder = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; survives the loss of executors.

    What a checkpoint keeps of the plan behind it (constraints, partitionings and their aliases) multiplies
    from one to the next until planning takes longer than running; so the rows come back without it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df._jdf.checkpoint(True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that do not have it on their path; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    # the driver serves this file to the executors for as long as it runs
    folder = tempfile.mkdtemp(prefix="lodestone-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "lodestone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    sc._lodestone_shipped = True
