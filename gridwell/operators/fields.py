"""Derived fields: columns made of columns, all lazy and fused by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numeric import number, real

LOGS = {"log_e": F.ln, "log_10": F.log10, "log_2": F.log2}


def add_fields(df: DataFrame, fields: list[str], output: str) -> DataFrame:
    """The sum of fields; a null, or a field that df doesn't have, adds nothing."""
    there = [f for f in fields if f in df.columns]
    total = reduce(lambda a, b: a + b, (F.coalesce(number(F.col(f)), F.lit(0.0)) for f in there), F.lit(0.0))
    return df.withColumn(output, total)


def power_of_field(df: DataFrame, field: str, exponent: float, output: str) -> DataFrame:
    return df.withColumn(output, F.pow(F.col(field), F.lit(float(exponent))))


def log(df: DataFrame, field: str, kind: str = "log_e", output: str | None = None, clamp_min_value: float | None = None) -> DataFrame:
    """The logarithm of a field; without a clamp, values that aren't positive are an error."""
    v = number(F.col(field))
    if clamp_min_value is not None:
        if clamp_min_value <= 0:
            raise ValueError("log: clamp_min_value must be positive")
        v = F.greatest(v, F.lit(float(clamp_min_value)))
    else:
        low = df.filter(real(v)).agg(F.min(v)).first()[0]
        if low is not None and low <= 0:
            raise ValueError(f"log: {field} has values of {low}; give clamp_min_value")
    return df.withColumn(output or f"{kind}({field})", LOGS[kind](v))


def composite_vector(df: DataFrame, fields: list[str], output: str) -> DataFrame:
    if len(fields) not in (2, 3):
        raise ValueError("composite_vector: two or three fields")
    return df.withColumn(output, vectors.vector(*(F.col(f) for f in fields)))


def _is_array(df: DataFrame, field: str) -> bool:
    return df.schema[field].dataType.typeName() == "array"


def vector_magnitude(df: DataFrame, field: str, output: str | None = None) -> DataFrame:
    v = F.col(field)
    if _is_array(df, field):
        value = vectors.array_magnitude(v)
    else:
        value = F.sqrt(reduce(lambda a, b: a + b, (v[n] * v[n] for n in df.schema[field].dataType.names)))
    return df.withColumn(output or f"{field}_magnitude", value)


def vector_component(df: DataFrame, field: str, component: int, output: str) -> DataFrame:
    v = F.col(field)
    return df.withColumn(output, number(F.get(v, F.lit(component)) if _is_array(df, field) else v[df.schema[field].dataType.names[component]]))


def add_domain_ids(df: DataFrame, domain: str = "domain_id", output: str = "domain_ids") -> DataFrame:
    return df.withColumn(output, F.col(domain) if domain in df.columns else F.lit(0))  # a table without domains is one


def add_ranks(df: DataFrame, output: str = "rank") -> DataFrame:
    """The partition that holds a row; it depends on how the table is dealt out."""
    return df.withColumn(output, F.spark_partition_id())


def random_field(df: DataFrame, output: str, seed: int = 0) -> DataFrame:
    return df.withColumn(output, F.rand(seed))
