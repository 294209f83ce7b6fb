"""Spark session helpers.

The library never creates cluster settings of its own: on a cluster the
session (and its ``spark.checkpoint.dir``) comes from the submitter. Only when
the setting is missing, as in local tests, a scratch folder is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "millwright",
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        # Constraint inference grows combinatorially on the wide as-of plans
        # (a struct of every column carried through union + window + join);
        # with it on, planning a failure-mode lookup of an in-memory table
        # does not finish. Recommended for any session running this library.
        .config("spark.sql.constraintPropagation.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="millwright-ckpt-")
        else:
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    For narrow intermediate tables that several steps read: the lineage is cut, columns are
    pruned on reading, and a lost executor costs its running tasks only.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/millwright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
