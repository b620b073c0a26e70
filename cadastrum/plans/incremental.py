"""Builds only what changed: layers by year, each year with the fingerprint of what it was made from.

An input year's fingerprint sums up its files (name, length, time of change). A layer's is made of those
of the layers it needs and of the rules' version. Only years whose fingerprint differs
from the stored one are built, all stale years of a layer in one job, and published as one snapshot. Layers that
do not need each other are built side by side, so that their many short stages share the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.plans import income, sales
from cadastrum.plans.publish import commune_year
from cadastrum.sources import snapshots
from cadastrum.sources.sinks import EmptyOutput

AT_ONCE = 5  # layers whose jobs run side by side
RULES = "1"  # raise it when a layer's rows change for the same input


def _communes(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("geography_level") == "commune")


@dataclass(frozen=True)
class Layer:
    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]


LAYERS = (
    Layer("sales_silver", ("sales_bronze",), sales.to_silver),
    Layer("sales_national", ("sales_silver",), sales.national),
    Layer("sales_by_department", ("sales_silver",), sales.by_department),
    Layer("sales_by_property_type", ("sales_silver",), sales.by_property_type),
    Layer("sales_by_commune", ("sales_silver",), sales.by_commune),
    Layer("income_gold", ("income_silver",), income.harmonise),
    Layer("income_departments", ("income_gold",), income.departments),
    Layer("commune_year", ("sales_by_commune", "income_gold"), lambda s, gold: commune_year(s, _communes(gold))),
)


def input_fingerprints(spark: SparkSession, folder: str) -> dict[int, str]:
    """A fingerprint per ``year=YYYY`` folder. No file is opened; the driver sees a row per year."""
    files = spark.read.format("binaryFile").load(folder).where("year IS NOT NULL")
    found = files.select(
        F.col("year").cast("long").alias("year"), F.xxhash64("path", "length", "modificationTime").alias("file")
    ).groupBy("year").agg(F.count("*").alias("files"), F.bit_xor("file").alias("mix"), F.sum(F.shiftright("file", 16)).alias("sum"))
    return {r.year: f"{r.files}-{r.mix}-{r['sum']}" for r in found.collect()}


def _digest(layer: Layer, prints: list[str | None]) -> str:
    return hashlib.sha256("\n".join([RULES, layer.name, *(p or "" for p in prints)]).encode()).hexdigest()


def build(spark: SparkSession, inputs: dict[str, str], base: str, layers: tuple[Layer, ...] = LAYERS) -> dict[str, list[int]]:
    """Brings every layer under ``base`` up to date and gives the years built, by layer.

    ``inputs`` has the folders of ``sales_bronze`` and ``income_silver``, both by year. Years that left the
    input leave the layers. Building nothing at all is an error, and a layer whose stale years have no rows keeps its old version.
    """
    prints = {name: input_fingerprints(spark, folder) for name, folder in inputs.items()}
    if not any(prints.values()):
        raise EmptyOutput("no input years")
    stored = {name: snapshots.current(spark, f"{base}/{name}") for name in (layer.name for layer in layers)}

    def rows(name: str, years: list[int]) -> DataFrame:
        table = spark.read.parquet(inputs[name]) if name in inputs else stored[name].read(spark)
        return table.withColumn("year", F.col("year").cast("long")).where(F.col("year").isin(years))

    def bring(layer: Layer) -> tuple[dict[int, str], list[int], snapshots.Snapshot]:
        path = f"{base}/{layer.name}"
        years = sorted(set().union(*(prints[name] for name in layer.needs)))
        wanted = {year: _digest(layer, [prints[name].get(year) for name in layer.needs]) for year in years}
        known = stored[layer.name].years
        stale = [year for year in years if year not in known or known[year].fingerprint != wanted[year]]
        if stale:
            made = layer.make(*(rows(name, stale) for name in layer.needs))
            return wanted, stale, snapshots.publish(made, path, {year: wanted[year] for year in stale}, keep=years)
        return wanted, stale, snapshots.forget(spark, path, years)

    built = {layer.name: [] for layer in layers}
    waiting = list(layers)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while waiting:
            ready = [layer for layer in waiting if all(name in prints for name in layer.needs)]
            if not ready:
                raise KeyError(f"inputs of {[layer.name for layer in waiting]} are missing")
            for layer, (wanted, stale, published) in zip(ready, pool.map(bring, ready), strict=True):
                prints[layer.name], built[layer.name], stored[layer.name] = wanted, stale, published
            waiting = [layer for layer in waiting if layer not in ready]
    return built
