"""Folders for tables that are written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; where it names none, a temporary one if all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-fieldgrid-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
