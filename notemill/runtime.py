"""Session helpers: session builder, shared scratch folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only when a count of it stays under both bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(app: str = "notemill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested under; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_notemill")
        current = sc.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for written tables and stream checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/notemill-{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and is computed once."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Count a dimension (never a fact table) and say whether it may be broadcast."""
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b"),
    ).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint behind a size check; beyond the bound the join shuffles as usual."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df
