"""All registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.domain import Domain


def entries() -> dict:
    from threadloom.plans import catalog_network, catalog_records, catalog_text, catalog_views

    merged = {}
    for module in (catalog_records, catalog_text, catalog_views, catalog_network):
        merged.update(module.ENTRIES)
    return merged


def spark_queries() -> dict:
    def bind(run):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(Domain(spark, sf_dir))

        return call

    return {name: bind(run) for name, (run, _) in entries().items()}


def oracle_queries() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql is not None}
