"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Pruned CSV scans let rows through that the full parse refuses.
    "spark.sql.csv.parser.columnPruning.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "siftwell", **conf) -> SparkSession:
    """A session with the settings the operators are tested under."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own: on a cluster a machine-local path would
    vanish with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never used twice."""
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def written(df):
    """``df`` written once to the shared folder and read back.

    Cuts the lineage like a checkpoint, is computed once, survives a lost
    executor, and lets the planner see how small the result is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of ours, on whatever file system it lies."""
    if not path.startswith(workspace(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# A table the planner puts below this size is read once and dealt out to all
# cores before several passes over it; a larger one is read by each pass.
AT_HAND_BYTES = 256 << 20


@contextlib.contextmanager
def at_hand(df):
    """``df`` for several passes: dealt out and kept in memory where it is small and in too few pieces, else as it is.

    A small Parquet file is often one unsplittable row group, which would leave
    every pass to a single core. A table in enough pieces is read anew by each
    pass, just its columns, which costs less than to hold all of it.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    size = int(plan.optimizedPlan().stats().sizeInBytes())
    if not 0 < size <= AT_HAND_BYTES or 2 * plan.toRdd().getNumPartitions() > cores:
        yield df
        return
    held = df.repartition(cores).persist()
    try:
        yield held
    finally:
        held.unpersist()
