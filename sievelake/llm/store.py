"""Where intermediate tables are kept, and how big plans are cut into groups.

Every intermediate table goes to the folder the cluster names in ``spark.checkpoint.dir``.
Without that setting a folder under the system's temp is used if the master is local (tests,
a laptop); on a cluster, whose executors would each write to a disk of their own, it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets a local one where none is configured."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs the running stage only, and whoever reads the
    table twice does not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is already stopped
        return


def discard(*tables: DataFrame) -> None:
    """Delete tables as :func:`materialize` returned them; whoever calls this reads none of them any more, nor anything lazy over them."""
    gone = {t.kept_at for t in tables}
    for spark, path in [x for x in _written if x[1] in gone]:
        _written.remove((spark, path))
        _delete(spark, path)


def written() -> int:
    """How many tables of this process are kept; a mark for :func:`release`."""
    return len(_written)


def release(since: int = 0, keep: int = 0) -> None:
    """Delete the tables written by :func:`materialize` in this process since a mark, but for the last ``keep``."""
    last = _written[len(_written) - keep :]
    gone = _written[since : len(_written) - keep]
    _written[since:] = last
    for spark, path in gone:
        _delete(spark, path)


atexit.register(release)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: file sizes for scans; no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def group_count(df: DataFrame, target_bytes: int = 4 << 20, least: int = 64) -> int:
    """How many hash groups to deal ``df`` into, so that one group stays near ``target_bytes`` of the plan's size.

    It grows with the input, so a group's memory does not. It does not grow with the number of
    shuffle partitions beyond ``least``: groups send one blob to each shard, and their product
    must stay in proportion to the input.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = plan_bytes(df)
    if estimate > 1 << 60:  # no file sizes to go by, e.g. an RDD scan: the bytes of its strings are summed
        size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"), F.lit(0)) + 8 * len(df.columns)
        estimate = int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)
    return max(min(4 * partitions, least), -(-estimate // target_bytes))
