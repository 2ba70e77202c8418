"""A PySpark-native analytics engine for document knowledge graphs."""

from __future__ import annotations

import os


def importable(spark) -> None:
    """Lets Python workers of this session find the package where it is not installed but on the driver's path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([root, *([have] if have else [])])
