"""Session defaults and lineage cutting.

Iterative operators (pointer jumping, star contraction, agglomeration) cut their lineage with tables written to
the folder the cluster names in ``spark.checkpoint.dir``. Executors may be lost at any moment, so nothing is kept
on executors only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "strandweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; ``master`` is only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, taken from its settings; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


#: Bytes of an Arrow batch where the session says nothing else; Spark's own 64 MB are held several times by a task.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(8 << 20))


#: Bytes of bytecode a generated method may have; the JVM only interprets methods of more than 8,000.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def bound_methods(spark: SparkSession) -> None:
    """Splits generated code that the JVM would not compile, where the session says nothing else.

    A join and the transforms behind it in one method are interpreted, which costs a multiple of the time.
    """
    key, default, ours = METHOD_LIMIT
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, ours)


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per Spark application, and bounds the batches they get."""
    sc = spark.sparkContext
    key, default, ours = ARROW_BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, ours)
    if getattr(sc, "_strandweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "strandweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._strandweave_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` as a table in the shared checkpoint folder and reads it back.

    The written table survives the loss of executors and has its true size, where ``checkpoint()`` would keep the
    size estimate of the plan before it: in a loop with joins that estimate grows without bound.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lineage-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Name of a new folder beside the tables of :func:`cut_lineage`, for files that tasks write themselves."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}


def release_tables(spark: SparkSession) -> int:
    """Deletes the tables :func:`cut_lineage` has written for this application and returns their number.

    For the end of a run: DataFrames that read them can no longer be evaluated.
    """
    sc = spark.sparkContext
    paths = _written.pop(sc.applicationId, [])
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
