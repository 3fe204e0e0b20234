"""Sessions and the table loader."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "quillon", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, whatever their working directory."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillon-ship-")) / "quillon_package.zip"
    with zipfile.ZipFile(target, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, Path("quillon") / source.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
