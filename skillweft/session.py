"""A session for one machine; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """UTC, AQE and few shuffle partitions. Larger inputs need more of them: about one for every 128 MB that is shuffled."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("skillweft")
    settings = {
        "spark.driver.memory": os.environ.get("SKILLWEFT_DRIVER_MEMORY", memory),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = b.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
