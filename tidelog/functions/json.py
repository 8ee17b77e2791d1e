"""Strict JSON functions over binary or text values, as column expressions and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def type_name(v: Column) -> Column:
    """string, int64, float64 or boolean of a variant; objects, arrays and null count as string."""
    t = F.schema_of_variant(v)
    return F.when(t == "BIGINT", "int64").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float64").when(t == "BOOLEAN", "boolean").otherwise("string")


def _at(value: Column, path: str) -> Column:
    """The variant at a path ($.a.b, $.a[0].b); null for other paths, bad JSON and nothing there."""
    if not path.startswith("$."):
        return F.lit(None).cast("variant")
    return F.try_variant_get(F.try_parse_json(value.cast("string")), path, "variant")


def json_extract(value: Column, path: str) -> Column:
    """JSON text of what is at the path; strings keep their quotes."""
    return F.to_json(_at(value, path))


def json_extract_string(value: Column, path: str) -> Column:
    v = _at(value, path)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_extract_int(value: Column, path: str) -> Column:
    v = _at(value, path)
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def json_extract_float(value: Column, path: str) -> Column:
    v = _at(value, path)
    return F.when(type_name(v).isin("int64", "float64"), F.try_variant_get(v, "$", "double"))


def json_extract_scalar(value: Column, path: str) -> Column:
    """Text of what is at the path; strings without quotes."""
    return F.coalesce(json_extract_string(value, path), json_extract(value, path))


def decode_utf8(value: Column) -> Column:
    return F.try_validate_utf8(value.cast("string"))


def decode_base64(value: Column) -> Column:
    return F.try_to_binary(value, F.lit("base64"))


_AT = "try_variant_get(try_parse_json(cast(v AS STRING)), p, 'variant')"
_KIND = f"schema_of_variant({_AT})"
#: SQL functions; visible to Catalyst as expressions. A path must be a literal.
SQL_FUNCTIONS = {
    "json_extract": ("v BINARY, p STRING", "STRING", f"CASE WHEN startswith(p, '$.') THEN to_json({_AT}) END"),
    "json_extract_string": ("v BINARY, p STRING", "STRING", f"CASE WHEN startswith(p, '$.') AND {_KIND} = 'STRING' THEN try_variant_get(try_parse_json(cast(v AS STRING)), p, 'string') END"),
    "json_extract_int": ("v BINARY, p STRING", "BIGINT", f"CASE WHEN startswith(p, '$.') AND {_KIND} = 'BIGINT' THEN try_variant_get(try_parse_json(cast(v AS STRING)), p, 'bigint') END"),
    "json_extract_float": ("v BINARY, p STRING", "DOUBLE", f"CASE WHEN startswith(p, '$.') AND ({_KIND} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({_KIND}, 'DECIMAL')) THEN try_variant_get(try_parse_json(cast(v AS STRING)), p, 'double') END"),
    "decode_utf8": ("v BINARY", "STRING", "try_validate_utf8(cast(v AS STRING))"),
    "decode_base64": ("v STRING", "BINARY", "try_to_binary(v, 'base64')"),
    "vector_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, metric STRING",
        "DOUBLE",
        """CASE WHEN size(a) <> size(b) THEN CASE WHEN metric IN ('cosine', 'euclidean', 'dot') THEN double('NaN') END
        WHEN metric = 'dot' THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
        WHEN metric = 'euclidean' THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))
        WHEN metric = 'cosine' THEN coalesce(1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
          sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), double('NaN')) END""",
    ),
    "strpos": ("s STRING, t STRING", "INT", "instr(s, t)"),
    "starts_with": ("s STRING, t STRING", "BOOLEAN", "startswith(s, t)"),
    "ends_with": ("s STRING, t STRING", "BOOLEAN", "endswith(s, t)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "to_timestamp_seconds": ("n BIGINT", "TIMESTAMP", "timestamp_seconds(n)"),
    "to_timestamp_millis": ("n BIGINT", "TIMESTAMP", "timestamp_millis(n)"),
    "to_timestamp_micros": ("n BIGINT", "TIMESTAMP", "timestamp_micros(n)"),
    "date_bin": ("step INTERVAL DAY TO SECOND, ts TIMESTAMP", "TIMESTAMP", "timestamp_micros(cast(floor(unix_micros(ts) / (extract(DAY FROM step) * 86400000000 + extract(HOUR FROM step) * 3600000000 + extract(MINUTE FROM step) * 60000000 + cast(extract(SECOND FROM step) * 1000000 AS BIGINT))) * (extract(DAY FROM step) * 86400000000 + extract(HOUR FROM step) * 3600000000 + extract(MINUTE FROM step) * 60000000 + cast(extract(SECOND FROM step) * 1000000 AS BIGINT)) AS BIGINT))"),
    "iszero": ("x DOUBLE", "BOOLEAN", "x = 0"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the SQL functions in the session and return their names."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
