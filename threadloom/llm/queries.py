"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    decontaminate, exact, fingerprints, html, language, manifest, minhash, oracle, packing, pii, quality, spelling, tokenfile, toxicity)
from threadloom.llm.common import remainder, table
from threadloom.operators.cutting import Workspace


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def _scored(docs: DataFrame, held_out, accept: float) -> DataFrame:
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(quality.with_score(docs, model), held_out, quality.ACCEPT)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "token-files").path("set")
    tokenfile.write(table(spark, sf_dir, "documents"), folder)
    return tokenfile.read(spark, folder)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(toxicity.with_score(docs, model), held_out, toxicity.ACCEPT)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = language.fit(docs, ~held_out)
    found = language.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ENTRIES = {
    "op1_decontaminate": (op1_decontaminate, oracle.OP1),
    "op2_html": (op2_html, None),
    "op3_quality": (op3_quality, None),
    "op4_near_duplicates": (op4_near_duplicates, None),
    "op5_token_files": (op5_token_files, None),
    "op6_pii": (op6_pii, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_language": (op8_language, None),
    "op9_pack": (op9_pack, None),
    "op10_fingerprints": (op10_fingerprints, None),
    "op11_manifest": (op11_manifest, oracle.OP11),
    "op12_exact_duplicates": (op12_exact_duplicates, oracle.OP12),
    "op13_spelling": (op13_spelling, oracle.OP13),
}


def spark_queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_queries() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql is not None}
