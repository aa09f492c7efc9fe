"""Registered queries of the engine: name, DataFrame query, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A public test key, for the registry only.
KEY = b"k" * 32


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    from tabforge.queries import evaluation, ingestion, preparation, publication, rule_queries, synthesis  # noqa: F401


def hmac_sql(id_: str, domain: bytes) -> str:
    from tabforge.functions.keyed import pads

    inner, outer = pads(KEY, domain)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || unhex(lpad(to_hex({id_}), 16, '0')))))"


def train_sql(id_: str) -> str:
    from tabforge.functions.keyed import PARTITION_DOMAIN, TRAIN_BELOW

    return f"substr({hmac_sql(id_, PARTITION_DOMAIN)}, 1, 16) < '{TRAIN_BELOW}'"


def priority_sql(id_: str) -> str:
    from tabforge.functions.keyed import PRIORITY_DOMAIN

    return f"substr({hmac_sql(id_, PRIORITY_DOMAIN)}, 1, 16)"


def hmac_text_sql(id_: str, domain: bytes) -> str:
    """The keyed hash of an id's decimal text."""
    from tabforge.functions.keyed import pads

    inner, outer = pads(KEY, domain)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(CAST({id_} AS VARCHAR)))))"
