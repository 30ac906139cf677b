"""Spark sessions for the library, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; what the environment has set already wins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send the package to the executors once, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="netloom-")) / "netloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
