"""Session defaults and the few SQL settings every operator relies on."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from reqloom.sources.tables import shared_dir

# Only settings that change how Spark may re-plan at run time; nothing about sizes, which belong to the cluster.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partition even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def package_zip() -> bytes:
    """This package's modules as a zip that Python can import from."""
    here = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per Spark application; it lies in the shared folder while that runs."""
    sc = spark.sparkContext
    if getattr(sc, "_reqloom_shipped", False):
        return
    where = f"{shared_dir(spark)}/reqloom-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(package_zip()))
    out.close()
    fs.deleteOnExit(path)
    sc.addPyFile(where)
    sc._reqloom_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time SQL settings on an existing session and send the package to its executors."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


def local_session(app: str = "reqloom", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in RUNTIME.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
