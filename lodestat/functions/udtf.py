"""Table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class JsonLeaves:
    """The leaves of a JSON text with their paths; text that is no JSON has none."""

    def eval(self, text: str, skip: str) -> Iterator[tuple[str, str]]:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return
        left = set((skip or "").split(","))

        def walk(node, path: str) -> Iterator[tuple[str, str]]:
            if isinstance(node, dict):
                for k, v in node.items():
                    if k not in left:
                        yield from walk(v, f"{path}.{k}")
            elif isinstance(node, list):
                for i, v in enumerate(node):
                    yield from walk(v, f"{path}[{i}]")
            else:
                yield path, None if node is None else node if isinstance(node, str) else json.dumps(node)

        yield from walk(doc, "$")


def register(spark: SparkSession) -> None:
    """The engine's SQL functions: json_leaves(text, skip), is_close, round_half_up_to, t_two_sided, norm_alnum, norm_name."""
    spark.udtf.register("json_leaves", udtf(JsonLeaves, returnType="path string, value string"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_close(a DOUBLE, b DOUBLE, rtol DOUBLE, atol DOUBLE) RETURNS BOOLEAN "
        "RETURN abs(a - b) <= greatest(rtol * greatest(abs(a), abs(b)), atol)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_alnum(s STRING) RETURNS STRING RETURN regexp_replace(lower(s), '[^a-z0-9]', '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION norm_name(s STRING) RETURNS STRING "
        "RETURN regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '_'), '^_+|_+$', '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION t_two_sided(t DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN CAST(java_method("
        "'org.apache.commons.math3.special.Beta', 'regularizedBeta', df / (df + t * t), df / 2, 0.5D) AS DOUBLE)"
    )
