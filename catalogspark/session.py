"""Session settings the operators rely on, and where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that results depend on.

    Times are UTC, and a JSON object that names a key twice keeps the last value.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


#: Bytes of a file that one task reads where rows are picked by key, and rows of a batch that goes to Python where they are long texts.
SPLIT, BATCH_ROWS = "16m", 1000


#: Estimated bytes up to which a side of a join is broadcast before anything is measured.
BROADCAST_ESTIMATE = 512 * 1024


def bound_broadcasts(spark: SparkSession) -> SparkSession:
    """Keep what the driver collects for joins small, however large the tables are.

    The planner's estimate starts from the compressed bytes of files and takes any text for 20 bytes. A list of URLs takes fifty times
    that in the driver. So the threshold of the session holds for sizes that adaptive execution has measured, and a lower one for estimates.
    """
    estimated, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_ESTIMATE:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(estimated))
        spark.conf.set(estimated, str(BROADCAST_ESTIMATE))
    return spark


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Keep what one task holds at a time small, however large the tables are.

    A pick per key sorts the rows of a task before the shuffle. Wide rows take forty times the bytes of their columns in Parquet, so
    a split of the usual size would be sorted on disk. A batch of texts is in a Python worker several times over.
    """
    spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, ``spark.checkpoint.dir``, which all executors must reach.

    The setting is fixed when a session starts. A session without it needs a call of ``setCheckpointDir``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("start the session with spark.checkpoint.dir, a folder that all executors can reach")
    return configured


_made: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def close(spark: SparkSession) -> None:
    """Remove all that this application has stored below the shared folder; results that still read it end here."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that several readers share the work.

    Unlike a cache, the table outlives lost executors and its columns and filters are pruned per reader.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns to ``keep`` and new ones that are computed exactly once per row.

    The optimizer copies an expression into every filter and projection above it. It does not
    reach through a generator, so wrapping costly expressions in one keeps them single.
    """
    carrier = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.explode_outer(F.array(carrier)).alias("_once")).select(
        *keep, *[F.col(f"_once.{name}").alias(name) for name in columns]
    )
