"""The SQL functions of a session: expression bodies, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mnemo.functions.expressions import DEFAULT_DECAY, MICROS_PER_DAY

FUNCTIONS = {
    "salience_now": f"""(base DOUBLE, decay DOUBLE, since TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE
        RETURN greatest(0D, least(1D, coalesce(base, 1D) * exp(-coalesce(decay, {DEFAULT_DECAY}D) * (unix_micros(as_of) - unix_micros(coalesce(since, as_of))) / {MICROS_PER_DAY:.0f}D)))""",
    "cosine_sim": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
                          sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))""",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
