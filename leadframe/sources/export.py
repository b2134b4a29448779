"""Export of one run: a metadata document plus the profiles.

The profiles are written as JSON-lines part files by the executors; only the
one-row metadata (query, terms, counts, time, version, calls) is a separate
small document. Nothing is gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRACTION_VERSION = "2.0"


def run_metadata(profiles: DataFrame, stats: DataFrame, query: str, terms: list[str],
                 generated_at: str, api_calls: int = 0, raw_results: DataFrame | None = None) -> DataFrame:
    """One-row metadata frame: ``search_query, search_terms, total_results,
    generated_at, extraction_version, api_calls_used`` (+ ``raw_results_count``)
    joined with the one-row ``stats`` frame (X21 + V6 counts)."""
    meta = profiles.agg(F.count(F.lit(1)).alias("total_results")).select(
        F.lit(query).alias("search_query"),
        F.array(*[F.lit(t) for t in terms]).cast("array<string>").alias("search_terms"),
        "total_results", F.lit(generated_at).alias("generated_at"),
        F.lit(EXTRACTION_VERSION).alias("extraction_version"),
        F.lit(int(api_calls)).cast("long").alias("api_calls_used"))
    def one(d):
        return d.withColumn("_one", F.lit(1))
    # one-row frames joined on a constant key
    if raw_results is not None:
        meta = one(meta).join(one(raw_results.agg(F.count(F.lit(1)).alias("raw_results_count"))),
                              "_one").drop("_one")
    return one(meta).join(one(stats), "_one").drop("_one")


def export_run_document(profiles: DataFrame, metadata: DataFrame, out_dir: str,
                        raw_results: DataFrame | None = None) -> dict:
    """Write ``metadata/`` (one JSON object), ``profiles/`` (JSON lines) and
    optionally ``raw_search_results/`` under ``out_dir``; returns the paths."""
    paths = {"metadata": f"{out_dir}/metadata", "profiles": f"{out_dir}/profiles"}
    metadata.coalesce(1).write.mode("overwrite").json(paths["metadata"])
    profiles.write.mode("overwrite").json(paths["profiles"])
    if raw_results is not None:
        paths["raw_search_results"] = f"{out_dir}/raw_search_results"
        raw_results.write.mode("overwrite").json(paths["raw_search_results"])
    return paths
