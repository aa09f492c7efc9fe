"""Parquet and typed CSV scans, small evaluation inputs, and generated fixtures."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.schema import ColumnSchema, EngineError, struct

#: The widest fixture's columns, in order.
SCALE_COLUMNS = (
    ["record_id"] + [f"category_{i:02d}" for i in range(10)] + [f"integer_{i:02d}" for i in range(20)] + [f"float_{i:02d}" for i in range(10)] + [f"boolean_{i:02d}" for i in range(5)]
    + [f"date_{i:02d}" for i in range(5)] + [f"datetime_{i:02d}" for i in range(5)] + [f"text_{i:02d}" for i in range(10)] + ["employee_m", "employee_f", "employee_total", "status"]
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as configuration or as set on the context.

    Where neither is set, a session on one machine gets a temporary folder of its own; on a cluster that is an error, since executors would
    write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("INVALID_STATE", "set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tabforge-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scan_parquet(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Shards of one table, with equal schemas in equal order; only the named columns are read."""
    schemas = [spark.read.parquet(p).schema for p in paths]
    if any([(f.name, f.dataType) for f in s] != [(f.name, f.dataType) for f in schemas[0]] for s in schemas):
        raise EngineError("SCHEMA_INVALID", "shards differ in schema")
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: Sequence[ColumnSchema], null_marker: str) -> DataFrame:
    """A typed CSV with a header and a null marker; a value of the wrong type is an error."""
    return spark.read.schema(struct(schema)).options(header=True, nullValue=null_marker, emptyValue="", mode="FAILFAST", multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def evaluation_input(spark: SparkSession, path: str) -> DataFrame:
    """JSON columns, JSON records, CSV (empty is null) or NPZ without pickles, by the file's suffix and shape."""
    if path.endswith(".csv"):
        return spark.read.options(header=True, inferSchema=True, nullValue="").csv(path)
    if path.endswith(".npz"):
        with np.load(path, allow_pickle=False) as z:
            return spark.createDataFrame([dict(zip(z.files, (v.item() for v in row), strict=True)) for row in zip(*(z[k] for k in z.files), strict=True)])
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    rows = got if isinstance(got, list) else [dict(zip(got, r, strict=True)) for r in zip(*got.values(), strict=True)]
    return spark.createDataFrame(rows)


def scale_fixture(spark: SparkSession, rows: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The deterministic 70-column table, a function of the row number alone."""
    i = F.col("id")
    own = {"record_id": i}
    for k in range(10):
        own[f"category_{k:02d}"] = F.format_string("cat_%02d", (i + k) % 17)
        own[f"float_{k:02d}"] = F.round(((i + k) % 10000).cast("double") / (k + 3), 6)
        own[f"text_{k:02d}"] = F.format_string(f"txt{k:02d}_%08d", i % 100_000_000)
    for k in range(20):
        own[f"integer_{k:02d}"] = (i * (k + 3) + k) % 100_000 if k else F.when(i % 2 == 0, (i * 17) % 10_000).otherwise(F.lit(0).cast("long"))
    for k in range(5):
        own[f"boolean_{k:02d}"] = (i + k) % 2 == 0
        own[f"date_{k:02d}"] = F.date_from_unix_date((F.lit(18262) + (i + k) % 2191).cast("int"))
        own[f"datetime_{k:02d}"] = F.timestamp_seconds(F.lit(1_577_836_800) + (i * 37 + k) % 31_536_000)
    own |= {"employee_m": i % 101, "employee_f": (i * 3) % 97, "employee_total": i % 101 + (i * 3) % 97, "status": F.when(i % 2 == 0, "active").otherwise("inactive")}
    return spark.range(rows).select(*(own[c].alias(c) for c in columns or SCALE_COLUMNS))


def scale_schema() -> tuple[ColumnSchema, ...]:
    kinds = {"record": "integer", "category": "categorical", "integer": "integer", "float": "float", "boolean": "boolean", "date": "date", "datetime": "datetime", "text": "text", "employee": "integer", "status": "categorical"}
    return tuple(ColumnSchema(c, kinds[c.split("_")[0]], timezone="UTC" if c.startswith("datetime") else None) for c in SCALE_COLUMNS)


def scale_rules() -> list[dict]:
    """The six rules that every row of the fixture keeps."""
    return [
        {"id": "record_not_null", "kind": "not_null", "column": "record_id"},
        {"id": "status_allowed", "kind": "allowed_values", "column": "status", "values": ["active", "inactive"]},
        {"id": "integer_range", "kind": "range", "column": "integer_00", "min": 0, "max": 9999},
        {"id": "employee_sum", "kind": "sum_equals", "sources": ["employee_m", "employee_f"], "target": "employee_total"},
        {"id": "fixed_combination", "kind": "fixed_combination", "columns": ["boolean_00", "status"], "allowed_tuples": [[True, "active"], [False, "inactive"]]},
        {"id": "conditional_set", "kind": "conditional_set", "when": {"kind": "comparison", "column": "boolean_01", "op": "eq", "value": True}, "target": "integer_00", "value": 0},
    ]
