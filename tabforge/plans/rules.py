"""Integrity rules: records, JSON form, and the compiler that checks them against a schema and orders reconstruction."""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation
from zoneinfo import ZoneInfo

from tabforge.schema import INT64_MAX, INT64_MIN, TEXT_KINDS, ColumnSchema, EngineError, canonical_json

#: Fixed values.
PROVENANCES = ("public", "private_inferred")
ACTIONS = ("block", "drop_row")
PREDICATE_OPS = ("eq", "ne", "lt", "lte", "gt", "gte")
COMPARE_OPS = ("<", "<=", ">", ">=")
_ID = re.compile(r"[A-Za-z][A-Za-z0-9.:_-]{0,127}")


def conflict(message: str, **details) -> EngineError:
    return EngineError("RULE_CONFLICT", message, **details)


@dataclass(frozen=True)
class When:
    """A condition of conditional_set: a comparison with a value, or is_null.  Null makes a comparison false."""

    kind: str
    column: str
    op: str | None = None
    value: object = None


@dataclass(frozen=True, kw_only=True)
class Rule:
    id: str
    provenance: str = "public"
    source_action: str = "block"
    kind = ""

    def __post_init__(self):
        if not _ID.fullmatch(self.id) or self.provenance not in PROVENANCES or self.source_action not in ACTIONS:
            raise conflict(f"bad id, provenance or source_action: {self.id!r}")
        for k, v in vars(self).items():
            if isinstance(v, list):
                object.__setattr__(self, k, tuple(tuple(x) if isinstance(x, list) else x for x in v))

    @property
    def reads(self) -> frozenset[str]:
        """Columns that the rule looks at."""
        return frozenset()

    @property
    def writes(self) -> frozenset[str]:
        """Columns that reconstruction gives values to."""
        return frozenset()

    @property
    def rebuild_reads(self) -> frozenset[str]:
        """Columns that reconstruction needs."""
        return frozenset()

    @property
    def structural(self) -> frozenset[str]:
        """Columns that leave the model's view."""
        return self.writes


@dataclass(frozen=True, kw_only=True)
class _OnColumn(Rule):
    column: str

    @property
    def reads(self):
        return frozenset((self.column,))


@dataclass(frozen=True, kw_only=True)
class MaskPrefix(_OnColumn):
    keep_chars: int
    kind = "mask_prefix"

    def __post_init__(self):
        super().__post_init__()
        if self.source_action != "block" or self.keep_chars < 0:
            raise conflict(f"{self.id}: a mask only blocks, and keeps no negative number")


@dataclass(frozen=True, kw_only=True)
class NotNull(_OnColumn):
    kind = "not_null"


@dataclass(frozen=True, kw_only=True)
class AllowedValues(_OnColumn):
    values: tuple
    kind = "allowed_values"


@dataclass(frozen=True, kw_only=True)
class Range(_OnColumn):
    min: object
    max: object
    inclusive_min: bool = True
    inclusive_max: bool = True
    kind = "range"


@dataclass(frozen=True, kw_only=True)
class FixedCombination(Rule):
    columns: tuple[str, ...]
    allowed_tuples: tuple[tuple, ...] | None = None
    kind = "fixed_combination"

    @property
    def reads(self):
        return frozenset(self.columns)

    writes = reads


@dataclass(frozen=True, kw_only=True)
class ConditionalSet(Rule):
    when: When
    target: str
    value: object = None
    kind = "conditional_set"

    @property
    def reads(self):
        return frozenset((self.when.column, self.target))

    @property
    def writes(self):
        return frozenset((self.target,))

    @property
    def rebuild_reads(self):
        return frozenset((self.when.column,))

    @property
    def structural(self):
        return frozenset()


@dataclass(frozen=True, kw_only=True)
class SumEquals(Rule):
    sources: tuple[str, ...]
    target: str
    tolerance: Decimal = Decimal(0)
    kind = "sum_equals"

    @property
    def reads(self):
        return frozenset((*self.sources, self.target))

    @property
    def writes(self):
        return frozenset((self.target,))

    @property
    def rebuild_reads(self):
        return frozenset(self.sources)


@dataclass(frozen=True, kw_only=True)
class Compare(Rule):
    left: str
    op: str
    right: str
    granularity: object = None
    kind = "compare"

    @property
    def reads(self):
        return frozenset((self.left, self.right))

    @property
    def writes(self):
        return frozenset((self.right,))

    @property
    def rebuild_reads(self):
        return frozenset((self.left,))


RULES = {c.kind: c for c in (MaskPrefix, NotNull, AllowedValues, Range, FixedCombination, ConditionalSet, SumEquals, Compare)}


def parse_rule(spec: Mapping) -> Rule:
    """A rule from its JSON form, told apart by ``kind``."""
    spec = dict(spec)
    cls = RULES.get(spec.pop("kind", None))
    if cls is None:
        raise conflict("unknown kind of rule")
    if cls is ConditionalSet and isinstance(spec.get("when"), Mapping):
        spec["when"] = When(**spec["when"])
    if cls is SumEquals and "tolerance" in spec:
        spec["tolerance"] = Decimal(str(spec["tolerance"]))
    try:
        return cls(**spec)
    except TypeError as e:
        raise conflict(f"{spec.get('id')}: {e}") from None


def normalized(value, column: ColumnSchema):
    """A rule's scalar as a typed value of the column's kind; texts become dates, aware datetimes and decimals."""
    bad = conflict(f"{value!r} is no {column.kind}", column=column.name)
    if value is None:
        return None
    try:
        if column.kind == "integer":
            if isinstance(value, bool) or value != int(value) or not INT64_MIN <= int(value) <= INT64_MAX:
                raise bad
            return int(value)
        if column.kind == "fixed_decimal":
            d = Decimal(str(value))
            if isinstance(value, bool) or not d.is_finite() or d != d.quantize(Decimal(1).scaleb(-column.decimal_places)):
                raise bad
            return d
        if column.kind == "float":
            if isinstance(value, bool) or not math.isfinite(float(value)):
                raise bad
            return float(value)
        if column.kind == "boolean":
            if not isinstance(value, bool):
                raise bad
            return value
        if column.kind == "date":
            if isinstance(value, dt.datetime):
                raise bad
            return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
        if column.kind == "datetime":
            t = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
            return t if t.tzinfo else t.replace(tzinfo=ZoneInfo(column.timezone or "UTC"))
        if column.kind in TEXT_KINDS and isinstance(value, str):
            return value
    except (TypeError, ValueError, InvalidOperation, OverflowError):
        raise bad from None
    raise bad


@dataclass(frozen=True)
class CompiledRules:
    schema: tuple[ColumnSchema, ...]
    rules: tuple[Rule, ...]
    """Sorted by id, with typed values."""
    rebuild: tuple[str, ...]
    """Ids of the rules that reconstruct columns, each after those it depends on."""
    checked_sums: frozenset[str] = field(default_factory=frozenset)
    """Ids of sums that may leave 64 bits, for all that public bounds say."""

    @property
    def columns(self) -> dict[str, ColumnSchema]:
        return {c.name: c for c in self.schema}

    @property
    def source(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.kind != "mask_prefix")

    @property
    def masks(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.kind == "mask_prefix")

    def rule(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)

    def latent(self, rule: Rule) -> str:
        """The name of the column that stands for the rule's columns in the model's view."""
        purpose = {"fixed_combination": "tuple", "compare": "delta"}[rule.kind]
        return f"__rule_{hashlib.sha256(rule.id.encode()).hexdigest()[:16]}_{purpose}"


def _typed(rule: Rule, columns: Mapping[str, ColumnSchema], public_only: bool) -> Rule:
    """The rule with typed values, after the checks of its kind."""
    for name in rule.reads:
        if name not in columns:
            raise conflict(f"{rule.id}: no column {name!r}")
    col = columns.get(getattr(rule, "column", None))
    if rule.kind == "mask_prefix" and col.kind not in TEXT_KINDS:
        raise conflict(f"{rule.id}: only text is masked")
    if rule.kind == "allowed_values":
        values = tuple(normalized(v, col) for v in rule.values)
        if not values or None in values or len({canonical_json(v) for v in values}) < len(values):
            raise conflict(f"{rule.id}: values are empty, null or repeat")
        if public_only and not {canonical_json(v) for v in values} <= {canonical_json(normalized(v, col)) for v in col.public_categories or ()}:
            raise conflict(f"{rule.id}: values are not among the public categories")
        return replace(rule, values=values)
    if rule.kind == "range":
        if col.kind not in ("integer", "fixed_decimal", "float", "date", "datetime"):
            raise conflict(f"{rule.id}: {col.kind} has no order")
        low, high = normalized(rule.min, col), normalized(rule.max, col)
        if low is None or high is None or low > high or low == high and not (rule.inclusive_min and rule.inclusive_max):
            raise conflict(f"{rule.id}: the range is empty")
        return replace(rule, min=low, max=high)
    if rule.kind == "fixed_combination":
        if len(rule.columns) < 2 or len(set(rule.columns)) < len(rule.columns):
            raise conflict(f"{rule.id}: two or more different columns are needed")
        if rule.allowed_tuples is None:
            if public_only:
                raise conflict(f"{rule.id}: public rules state their tuples")
            return rule
        tuples = tuple(tuple(normalized(v, columns[c]) for v, c in zip(t, rule.columns, strict=True)) if len(t) == len(rule.columns) else None for t in rule.allowed_tuples)
        if not tuples or None in tuples or len({canonical_json(t) for t in tuples}) < len(tuples):
            raise conflict(f"{rule.id}: tuples are missing, uneven or repeat")
        return replace(rule, allowed_tuples=tuples)
    if rule.kind == "conditional_set":
        when = rule.when
        if when.kind == "comparison":
            if when.op not in PREDICATE_OPS or when.value is None:
                raise conflict(f"{rule.id}: bad comparison")
            when = replace(when, value=normalized(when.value, columns[when.column]))
        elif when.kind != "is_null":
            raise conflict(f"{rule.id}: bad predicate")
        value = normalized(rule.value, columns[rule.target])
        if value is None and not columns[rule.target].nullable:
            raise conflict(f"{rule.id}: null for a column that is not nullable")
        return replace(rule, when=when, value=value)
    if rule.kind == "sum_equals":
        kinds = {(columns[c].kind, columns[c].decimal_places) for c in rule.reads}
        if not rule.sources or len(set(rule.sources)) < len(rule.sources) or rule.target in rule.sources or not {k for k, _ in kinds} <= {"integer", "fixed_decimal"} or not rule.tolerance.is_finite() or rule.tolerance < 0:
            raise conflict(f"{rule.id}: sums are of different whole or decimal columns, with a tolerance of 0 or more")
        scale = columns[rule.target].decimal_places or 0
        if any((columns[c].decimal_places or 0) != scale for c in rule.sources):
            raise conflict(f"{rule.id}: scales differ")
        if _static_bounds(rule, columns, least=True) > INT64_MAX or _static_bounds(rule, columns, least=False) < INT64_MIN:
            raise conflict(f"{rule.id}: public bounds leave 64 bits")
    if rule.kind == "compare":
        left, right = columns[rule.left], columns[rule.right]
        if rule.op not in COMPARE_OPS or rule.left == rule.right or (left.kind, left.decimal_places) != (right.kind, right.decimal_places) or left.kind not in ("integer", "fixed_decimal", "float", "date", "datetime"):
            raise conflict(f"{rule.id}: compared columns are two of one ordered kind and scale")
        if left.kind == "float" and (rule.granularity is None or rule.provenance != "public"):
            raise conflict(f"{rule.id}: floats need a public granularity")
        if rule.granularity is not None and (isinstance(rule.granularity, bool) or not math.isfinite(float(rule.granularity)) or unit_of(rule, right) <= 0):
            raise conflict(f"{rule.id}: granularity must be positive and representable")
    return rule


def _scaled(value, column: ColumnSchema) -> int:
    return int(Decimal(str(value)).scaleb(column.decimal_places or 0))


def _static_bounds(rule: SumEquals, columns: Mapping[str, ColumnSchema], least: bool) -> int:
    """The least (or greatest) the sum can be, if public bounds say so; else a value inside 64 bits."""
    bounds = [columns[c].public_min if least else columns[c].public_max for c in rule.sources]
    return sum(_scaled(b, columns[c]) for b, c in zip(bounds, rule.sources, strict=True)) if None not in bounds else 0


def _sum_is_safe(rule: SumEquals, columns: Mapping[str, ColumnSchema]) -> bool:
    known = all(columns[c].public_min is not None and columns[c].public_max is not None for c in rule.sources)
    return known and INT64_MIN <= _static_bounds(rule, columns, True) and _static_bounds(rule, columns, False) <= INT64_MAX


def unit_of(rule: Compare, column: ColumnSchema):
    """The step by which a strict comparison differs, in order units."""
    if rule.granularity is None:
        return 1
    if column.kind == "float":
        return float(rule.granularity)
    return _scaled(rule.granularity, column) if column.kind == "fixed_decimal" else int(rule.granularity)


def compile_rules(specs: Sequence[Rule | Mapping], schema: Sequence[ColumnSchema], public_only: bool = False) -> CompiledRules:
    """Checks rules together and orders reconstruction.

    Ids are unique and give the order of everything; one rule at most writes a column; structural columns are disjoint; no
    condition reads a written column; and reconstruction has no cycle.  ``public_only`` (for differential privacy) refuses whatever comes
    from private data.
    """
    columns = {c.name: c for c in schema}
    parsed = [s if isinstance(s, Rule) else parse_rule(s) for s in specs]
    if len({r.id for r in parsed}) < len(parsed):
        raise conflict("rule ids repeat")
    if public_only and any(r.provenance != "public" for r in parsed):
        raise conflict("private rules under differential privacy")
    rules = sorted((_typed(r, columns, public_only) for r in parsed), key=lambda r: r.id)
    writer: dict[str, str] = {}
    taken: dict[str, str] = {}
    for r in rules:
        for c in sorted(r.writes):
            if c in writer:
                raise conflict(f"{writer[c]} and {r.id} both write {c}")
            writer[c] = r.id
        for c in sorted(r.structural):
            if c in taken:
                raise conflict(f"{taken[c]} and {r.id} both replace {c}")
            taken[c] = r.id
    for r in rules:
        if r.kind == "conditional_set" and r.when.column in writer:
            raise conflict(f"{r.id}: its condition reads {r.when.column}, which {writer[r.when.column]} writes")
    builders = {r.id: r for r in rules if r.writes}
    after = {i: {writer[c] for c in r.rebuild_reads if c in writer} for i, r in builders.items()}
    ready, order = [i for i, needs in after.items() if not needs], []
    heapq.heapify(ready)
    while ready:
        done = heapq.heappop(ready)
        order.append(done)
        for i, needs in after.items():
            if done in needs:
                needs.discard(done)
                if not needs:
                    heapq.heappush(ready, i)
    if len(order) < len(builders):
        raise conflict("reconstruction has a cycle", rules=sorted(set(builders) - set(order)))
    unsafe = frozenset(r.id for r in rules if r.kind == "sum_equals" and not _sum_is_safe(r, columns))
    return CompiledRules(tuple(schema), tuple(rules), tuple(order), unsafe)
