"""Functions registered by name, so that SQL text can call them.

Scalar ones are SQL functions, which the optimizer inlines: no Python runs for them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DIGITS = "regexp_replace(translate(x, '०१२३४५६७८९', '0123456789'), '[^0-9]', '')"
_NATIONAL = f"CASE WHEN length({_DIGITS}) = 12 AND {_DIGITS} LIKE '91%' THEN substring({_DIGITS}, 3, 10) WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '0%' THEN substring({_DIGITS}, 2, 10) ELSE {_DIGITS} END"
#: Name to (parameters, type, body).
FUNCTIONS = {
    "phone_key": ("x STRING", "STRING", f"CASE WHEN {_NATIONAL} RLIKE '^[6-9][0-9]{{9}}$' THEN {_NATIONAL} END"),
    "plate_key": ("x STRING", "STRING", r"upper(regexp_replace(x, '[\\s\\-]', ''))"),
    "account_key": ("x STRING", "STRING", f"CASE WHEN contains(x, '@') THEN lower(trim(x)) ELSE {_DIGITS} END"),
    "merge_tier": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.8 THEN 'auto' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END"),
    "span_overlap": (
        "s1 INT, e1 INT, s2 INT, e2 INT", "DOUBLE",
        "CASE WHEN greatest(e1, e2) > least(s1, s2) THEN greatest(0, least(e1, e2) - greatest(s1, s2)) / ((e1 - s1) + (e2 - s2) - greatest(0, least(e1, e2) - greatest(s1, s2))) ELSE 0.0 END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
