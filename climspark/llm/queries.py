"""The operators as queries over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from climspark.llm.collocations import op11_collocations
from climspark.llm.common import table
from climspark.llm.curve import op12_curve_packing
from climspark.llm.decontaminate import op3_decontaminate
from climspark.llm.langid import op8_language
from climspark.llm.licenses import op1_licenses
from climspark.llm.packing import op5_packing
from climspark.llm.pii import op7_pii
from climspark.llm.prefixes import op13_prefix_trie
from climspark.llm.quality import op9_quality
from climspark.llm.sharding import op4_sharding
from climspark.llm.simhash import op6_simhash
from climspark.llm.tokens import op10_tokens
from climspark.llm.urls import op2_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_licenses": lambda spark, d: op1_licenses(table(spark, d, "documents")),
    "op2_urls": lambda spark, d: op2_urls(table(spark, d, "pages")),
    "op3_decontaminate": lambda spark, d: op3_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_sharding": lambda spark, d: op4_sharding(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: op5_packing(table(spark, d, "documents")),
    "op6_simhash": lambda spark, d: op6_simhash(table(spark, d, "documents")),
    "op7_pii": lambda spark, d: op7_pii(table(spark, d, "documents")),
    "op8_language": lambda spark, d: op8_language(table(spark, d, "documents")),
    "op9_quality": lambda spark, d: op9_quality(table(spark, d, "documents")),
    "op10_tokens": lambda spark, d: op10_tokens(table(spark, d, "documents")),
    "op11_collocations": lambda spark, d: op11_collocations(table(spark, d, "documents")),
    "op12_curve_packing": lambda spark, d: op12_curve_packing(table(spark, d, "documents")),
    "op13_prefix_trie": lambda spark, d: op13_prefix_trie(table(spark, d, "conversations")),
}
