"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None


def build_session(app_name: str = "cadastrum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """The session's setting inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for materialised tables, in storage every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose driver and
    executors are one process may fall back to a folder of this machine; that folder goes
    when the process ends.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="cadastrum-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch space and read it back.

    Later steps scan a compact table instead of repeating the work, their plans
    stay short, and a lost executor costs a re-read, not a re-run. The size of
    the stored table is known to the planner.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension of a few rows as an inline table, whose size the planner knows."""
    columns = [column.split() for column in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    names = ", ".join(name for name, _ in columns)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")
