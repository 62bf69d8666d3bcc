"""Session set-up: executors get the package with the job, wherever they run."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Of rows that go to Python at once: texts may be long, and a batch is held twice for a moment.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's executors, once a context, and bound the session's Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get(_BYTES) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if context not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="orrery-")
        path = f"{folder}/orrery_package.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, f"{root.name}/{source.relative_to(root)}")
        context.addPyFile(path)
        _SHIPPED[context] = path
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **options: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map={k.replace("__", "."): v for k, v in options.items()})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
