"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Correctness-neutral defaults for local runs; on a cluster the submitter's settings win.
_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "matchloom", cpus: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    merged = {
        **_LOCAL_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        **conf,
    }
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def send_by_value(module: str) -> None:
    """Send a module's functions to the Python workers themselves, so that they need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="matchloom-py-"), "matchloom")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
