"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and proved to have at most this many rows.
BROADCAST_ROWS = 200_000
#: More partitions than this cost the scheduler more than they spare a task.
MOST_PARTS = 20_000
#: The optimizer's size estimate of a join is the product of both sides'; beyond so many bits it tells nothing more.
MOST_BITS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only on one machine, where none is configured (tests), make one and remove it at the end."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # On a cluster every machine would write to a folder of its own.
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="evidra-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a reused intermediate in the shared checkpoint folder, so that a lost executor costs no recomputation of its past."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    # A checkpoint keeps the estimate of what it was made of. In a loop of joins its digits double each time, until the driver's
    # memory holds little else; so a useless one is dropped.
    if size_bits(kept) <= MOST_BITS:
        return kept
    made = kept._jdf.queryExecution()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(made.toRdd(), kept._jdf.schema(), False), df.sparkSession)


def size_bits(df: DataFrame) -> int:
    """Bits of the optimizer's estimate of the size in bytes."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join, broadcasting ``small`` only if its counted ``rows`` stay within the bound; else a shuffled join that AQE may split."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def in_parts(rows: int, per_part: int) -> int:
    """Number of partitions that keeps each at about ``per_part`` rows; beyond MOST_PARTS they grow, as their tasks stream."""
    return min(MOST_PARTS, max(1, -(-rows // per_part)))


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_evidra_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="evidra-")) / "evidra.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._evidra_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
