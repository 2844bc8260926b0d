"""Adapters: raw sensor files to the flat record. ``load(name, spark, path, **options)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgrain.adapters.sources import load_aegis, load_pvs, load_simulated, load_stride, load_uah

ADAPTERS = {"aegis": load_aegis, "pvs": load_pvs, "stride": load_stride, "uah-driveset": load_uah, "simulated": load_simulated}


def load(name: str, spark: SparkSession, path: str, **options) -> DataFrame:
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name!r}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name](spark, path, **options)
