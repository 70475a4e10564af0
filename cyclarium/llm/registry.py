"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cyclarium.llm import decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, packing, personal_data, secret_scan, spelling, toxicity, url_filter, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_toxicity": toxicity.query,
        "op3_secret_scan": secret_scan.query,
        "op4_warc": warc.query,
        "op5_line_dedup": line_dedup.query,
        "op6_packing": packing.query,
        "op7_url_filter": url_filter.query,
        "op8_language_id": language_id.query,
        "op9_ngram_jaccard": ngram_join.query,
        "op10_embedding_dedup": embedding_dedup.query,
        "op11_spelling_variants": spelling.query,
        "op12_vector_codes": vector_codes.query,
        "op13_personal_data": personal_data.query,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "op1_decontaminate": decontaminate.ORACLE_SQL,
        "op4_warc": warc.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op7_url_filter": url_filter.ORACLE_SQL,
        "op9_ngram_jaccard": ngram_join.ORACLE_SQL,
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
