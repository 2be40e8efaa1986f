"""Session settings, the modules that executors need, and the convention of explicit evaluation times."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

#: Evaluation time of the registered queries, the end of the driver's event tables: 2024-01-31T00:00:00Z in epoch ms.
AS_OF = 1706659200000
DAY = 86_400_000


def session(name: str = "skerry", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, so partitions follow the data's size and skewed joins are split; executors get this package."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that workers find its modules wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(spark.sparkContext._temp_dir, "skerry.zip")  # the driver serves it from there as long as it runs
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    out.write(whole, os.path.join("skerry", os.path.relpath(whole, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
