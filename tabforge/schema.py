"""Column kinds, declared schemas, canonical JSON and error codes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, is_dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

#: Fixed values.
KINDS = ("integer", "fixed_decimal", "float", "categorical", "boolean", "date", "datetime", "text", "identifier", "excluded")
ROLES = ("model", "derived", "identifier", "excluded")
IDENTIFIER_STRATEGIES = ("sequential", "uuid4")
ROW_ID = "__row_id"
CANDIDATE_INDEX = "__candidate_index__"
MAX_COLUMNS = 70
TEXT_KINDS = ("categorical", "text", "identifier", "excluded")
INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
#: Error codes and the status class of each.
ERROR_STATUS = {
    "SESSION_REQUIRED": 401, "ORIGIN_REJECTED": 403, "HOST_REJECTED": 403, "REPORT_NOT_RELEASE_SAFE": 403,
    "DATASET_NOT_FOUND": 404, "JOB_NOT_FOUND": 404, "ARTIFACT_NOT_FOUND": 404,
    "INVALID_STATE": 409, "SOURCE_RULE_VIOLATION": 409, "RULE_CONFLICT": 409, "RESUME_UNAVAILABLE": 409, "ARTIFACT_NOT_READY": 409,
    "BACKEND_INCOMPATIBLE": 409, "IDEMPOTENCY_CONFLICT": 409, "IMMUTABLE_PATH_EXISTS": 409, "UPLOAD_TOO_LARGE": 413,
    "INPUT_FORMAT_UNSUPPORTED": 422, "CSV_DIALECT_AMBIGUOUS": 422, "XLSX_UNSAFE": 422, "SCHEMA_INVALID": 422, "OUTPUT_INVALID": 422,
    "RULE_FEASIBILITY_EXHAUSTED": 422, "DP_METADATA_NOT_PUBLIC": 422, "DP_DOMAIN_TOO_LARGE": 422,
    "RESOURCE_LIMIT": 507, "DISK_QUOTA_EXCEEDED": 507, "WORKER_FAILED": 500, "CHECKSUM_MISMATCH": 500,
}


class EngineError(Exception):
    """An error with a stable code and, where useful, details."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(f"{code}: {message}")
        self.code, self.status, self.details = code, ERROR_STATUS[code], details


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    kind: str
    nullable: bool = False
    role: str = "model"
    decimal_places: int | None = None
    timezone: str | None = None
    format: str | None = None
    public_min: Any = None
    public_max: Any = None
    public_bins: tuple | None = None
    public_categories: tuple | None = None
    identifier_strategy: str | None = None

    def __post_init__(self):
        for name in ("public_bins", "public_categories"):
            if (v := getattr(self, name)) is not None:
                object.__setattr__(self, name, tuple(v))
        checks = (
            (not self.name, "a column needs a name"),
            (self.kind not in KINDS or self.role not in ROLES, "unknown kind or role"),
            ((self.kind == "fixed_decimal") != (self.decimal_places is not None), "decimal_places goes with fixed_decimal"),
            (self.decimal_places is not None and not 0 <= self.decimal_places <= 18, "decimal_places must be from 0 to 18"),
            ((self.kind == "identifier") != (self.role == "identifier"), "identifier kind and role go together"),
            ((self.kind == "identifier") != (self.identifier_strategy is not None), "identifier_strategy goes with identifiers"),
            (self.identifier_strategy not in (None, *IDENTIFIER_STRATEGIES), "unknown identifier_strategy"),
            ((self.kind == "excluded") != (self.role == "excluded"), "excluded kind and role go together"),
            (self.public_categories is not None and len(set(map(canonical_json, self.public_categories))) < len(self.public_categories), "public_categories repeat"),
            (self.public_bins is not None and len(self.public_bins) < 2, "public_bins needs two edges"),
        )
        for bad, why in checks:
            if bad:
                raise EngineError("SCHEMA_INVALID", f"{self.name or 'column'}: {why}")

    @property
    def spark_type(self) -> T.DataType:
        return {
            "integer": T.LongType(), "fixed_decimal": T.DecimalType(38, self.decimal_places or 0), "float": T.DoubleType(),
            "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(),
        }.get(self.kind, T.StringType())

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type, True, {"kind": self.kind, "role": self.role})


Schema = tuple[ColumnSchema, ...]


def struct(schema: Sequence[ColumnSchema]) -> T.StructType:
    return T.StructType([c.field for c in schema])


def check_columns(columns: Sequence[str], schema: Sequence[ColumnSchema]) -> None:
    """Column names must be the schema's, in its order; row ids may come first."""
    own = [c for c in columns if c != ROW_ID]
    want = [c.name for c in schema]
    if own != want:
        raise EngineError("SCHEMA_INVALID", "columns differ from the schema", missing=[c for c in want if c not in own], unexpected=[c for c in own if c not in want], order=own)
    if len(want) > MAX_COLUMNS:
        raise EngineError("SCHEMA_INVALID", f"more than {MAX_COLUMNS} columns")


def _plain(value: Any) -> Any:
    if is_dataclass(value):
        return _plain(asdict(value))
    if value is None or isinstance(value, bool | int):
        return value
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            raise ValueError("a canonical time needs a zone")
        return value.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float | Decimal):
        if not math.isfinite(value):
            raise ValueError("canonical JSON has finite numbers only")
        if value == 0:
            return "0" if isinstance(value, Decimal) else 0
        if isinstance(value, float):
            return value
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, Mapping):
        out = {unicodedata.normalize("NFC", k): _plain(v) for k, v in value.items()}
        if len(out) < len(value):
            raise ValueError("keys are equal after normalisation")
        return out
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    raise TypeError(f"no canonical JSON for {type(value).__name__}")


def canonical_json(value: Any) -> str:
    """JSON with NFC strings, sorted keys, no spaces, exact decimals as text and finite numbers."""
    return json.dumps(_plain(value), ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def version_of(value: Any) -> str:
    """The identity of a schema or rule set: the first 16 hex digits of its canonical JSON's SHA-256."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]
