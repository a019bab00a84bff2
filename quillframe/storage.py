"""Tables in the folder that driver and executors share, and row numbers over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import UserError

PART, WITHIN = "__part", "__within"
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process, as in tests, a
    temporary folder is used and remembered. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise UserError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_quillframe_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="quillframe-")
            spark.sparkContext._quillframe_shared = found
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs only the tasks it was
    running, and makes sure that an expensive step runs once however often its
    result is used. Tables that are not discarded earlier go when the process
    ends.
    """
    path = f"{shared_dir(df.sparkSession)}/quillframe/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillframe_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for f in frames:
        _delete(f._quillframe_path)


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    _left.discard(path)


@atexit.register
def _sweep() -> None:
    if _left and SparkContext._jvm is not None:
        try:
            for path in list(_left):
                _delete(path)
        except Exception:  # the JVM went first; the folder is left to its owner
            _left.clear()


def numbered(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """``df`` with column ``name``: contiguous positions in the order of its partitions and rows.

    Partition and position within it are written beside the rows, so that the
    numbers do not depend on how the plan runs a second time. The offsets are
    one row a partition and joined by broadcast; a row whose partition has none
    fails the job.
    """
    placed = materialise(df.withColumns({PART: F.spark_partition_id(), WITHIN: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    return offset(placed, name, start)


def offset(placed: DataFrame, name: str, start: int = 1, counts: dict | None = None) -> DataFrame:
    """Replace the columns ``PART`` and ``WITHIN`` by the position over all parts, of which ``counts`` may have the rows."""
    if counts is None:
        counts = {r[PART]: r["count"] for r in placed.groupBy(PART).count().collect()}
    offsets, total = [], start
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    known = placed.sparkSession.createDataFrame(offsets, f"__known {placed.schema[PART].dataType.simpleString()}, __offset bigint")
    position = F.coalesce(F.col("__offset"), F.raise_error(F.lit("the input gave other partitions when read again")).cast("bigint")) + F.col(WITHIN)
    joined = placed.join(F.broadcast(known), F.col(PART) == F.col("__known"), "left")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in placed.columns if c not in (PART, WITHIN)]
    return joined.select(*kept, position.alias(name))
