"""The library's column functions for SQL: temporary functions of a session, whose bodies Spark expands into the query's plan.

``register`` makes them; no Python runs when they are called. Each equals the column function of its name.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOTTED = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: name and parameters: (type, body)
FUNCTIONS = {
    "entropy(s STRING)": (
        "DOUBLE",
        """coalesce(-aggregate(
          transform(array_distinct(filter(split(s, ''), c -> c <> '')), c -> (length(s) - length(replace(s, c, ''))) / length(s)),
          0.0D, (total, share) -> total + share * log2(share)), 0.0D)""",
    ),
    "consonant_run(s STRING)": ("INT", "coalesce(array_max(transform(regexp_extract_all(s, '([A-Zb-df-hj-np-tv-z]+)', 1), x -> length(x))), 0)"),
    "ip_long(ip STRING)": (
        "BIGINT",
        f"CASE WHEN ip RLIKE '{_DOTTED}' THEN aggregate(transform(split(ip, '[.]'), x -> try_cast(x AS BIGINT)), 0L, (total, x) -> total * 256 + x) END",
    ),
    "in_cidr(ip STRING, network STRING)": (
        "BOOLEAN",
        """coalesce(shiftright(ip_long(ip), 32 - cast(coalesce(try_element_at(split(network, '/'), 2), '32') AS INT))
          = shiftright(ip_long(split(network, '/')[0]), 32 - cast(coalesce(try_element_at(split(network, '/'), 2), '32') AS INT)), false)""",
    ),
    "labels(name STRING)": (
        "ARRAY<STRING>",
        r"""CASE WHEN size(filter(split(rtrim('.', lower(trim(name))), '[.]'), x -> x <> '')) > 1
          THEN slice(filter(split(rtrim('.', lower(trim(name))), '[.]'), x -> x <> ''), 1, size(filter(split(rtrim('.', lower(trim(name))), '[.]'), x -> x <> '')) - 1)
          ELSE filter(split(rtrim('.', lower(trim(name))), '[.]'), x -> x <> '') END""",
    ),
    "time_bucket(ts DOUBLE, seconds DOUBLE)": ("BIGINT", "cast(floor(ts / seconds) AS BIGINT)"),
}


def register(spark: SparkSession, prefix: str = "nq_") -> list[str]:
    """Make the functions in a session, their names after ``prefix``; returns the names."""
    made = []
    for signature, (kind, body) in FUNCTIONS.items():
        body = body.replace("ip_long(", f"{prefix}ip_long(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS {kind} RETURN {body}")
        made.append(prefix + signature.split("(")[0])
    return made
