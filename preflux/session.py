"""Session defaults: Arrow on, adaptive execution on, UTC, one BLAS thread per worker."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, app: str = "preflux", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys use ``__`` for dots. An existing session is kept."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    return builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
