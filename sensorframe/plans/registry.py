"""All registered queries of the sensor library, gathered from the modules of ``sensorframe.plans``."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import sensorframe.plans as plans


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_"))
    return [importlib.import_module(f"sensorframe.plans.{n}") for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["l01_characterize"](spark, sf_dir)
