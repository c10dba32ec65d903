"""Names under which SQL can call the text functions that need no look-around on other rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (arguments, SQL body)
SQL_FUNCTIONS = {
    "squash": ("s STRING", "STRING", r"regexp_replace(regexp_replace(translate(s, '‘’“”', '\'\'\"\"'), '(?U)\\s+', ''), '[.!?]+$', '')"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
    "short_penalty": ("s STRING", "DOUBLE", r"0.1D * greatest(0D, 1 - length(regexp_replace(s, '(?U)^\\s+|\\s+$', '')) / 80)"),
}


def register(spark: SparkSession) -> None:
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
