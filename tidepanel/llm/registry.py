"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .classifier import op3_quality_classifier
from .common import table
from .embeddings import op10_embedding_dedup
from .mixing import OP4_SQL, op4_mixing
from .near_dedup import op9_near_dedup
from .packing import op5_packing
from .pii import op8_pii
from .quality_rules import op6_quality_rules
from .sharding import op1_sharding
from .resampling import op12_importance_resampling
from .spelling import op13_spelling_variants
from .sql import OP7_SQL, OP9_SQL, OP10_SQL, OP12_SQL, OP13_SQL
from .substrings import op2_substring_dedup
from .url_filter import op11_url_filter
from .warc import op7_warc


def queries() -> dict:
    return {
        "op1_sharding": lambda spark, d: op1_sharding(table(spark, d, "documents")),
        "op4_mixing": lambda spark, d: op4_mixing(table(spark, d, "documents")),
        "op2_substring_dedup": lambda spark, d: op2_substring_dedup(table(spark, d, "documents")),
        "op3_quality_classifier": lambda spark, d: op3_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_packing": lambda spark, d: op5_packing(table(spark, d, "documents")),
        "op6_quality_rules": lambda spark, d: op6_quality_rules(table(spark, d, "documents")),
        "op7_warc": lambda spark, d: op7_warc(table(spark, d, "pages")),
        "op8_pii": lambda spark, d: op8_pii(table(spark, d, "documents")),
        "op9_near_dedup": lambda spark, d: op9_near_dedup(table(spark, d, "documents")),
        "op10_embedding_dedup": lambda spark, d: op10_embedding_dedup(table(spark, d, "embeddings")),
        "op11_url_filter": lambda spark, d: op11_url_filter(table(spark, d, "pages")),
        "op12_importance_resampling": lambda spark, d: op12_importance_resampling(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op13_spelling_variants": lambda spark, d: op13_spelling_variants(table(spark, d, "documents")),
    }


def oracle_sql() -> dict:
    return {"op4_mixing": OP4_SQL, "op7_warc": OP7_SQL, "op9_near_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_spelling_variants": OP13_SQL}
