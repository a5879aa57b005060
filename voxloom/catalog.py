"""Registry of the queries over scan tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("overlap", "losses", "intensity", "stencils", "catalogue", "surface", "reports", "diffusion", "grids", "resample", "morphology", "randoms", "streams", "stores", "preprocess")


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) under ``name``, with equivalent SQL if there is any."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: overlap metrics of every predicted mask."""
    return QUERIES["D28_overlap_report"](spark, sf_dir)


for _m in MODULES:
    importlib.import_module(f"voxloom.plans.{_m}_queries")
