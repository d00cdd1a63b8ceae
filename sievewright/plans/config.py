"""Declared cleaning task: strict records, checked on the driver before anything runs."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from sievewright.functions.patterns import READ, WRITE, compiled, java, replacement, time_pattern
from sievewright.operators.userfn import Limits

OPS = ("trim", "lower", "upper", "nfkc", "replace", "regex_replace", "fill_null", "ffill", "cast", "date_format", "number_format", "slice", "concat", "drop_null", "filter", "dedupe")
CONDITIONS = ("is_empty", "not_empty", "equals", "contains", "starts_with", "ends_with", "in", "gt", "gte", "lt", "lte")
KINDS = ("non_null", "format", "type", "enum", "regex", "length", "range", "unique")  # in the order of evaluation


class ConfigError(ValueError):
    """The task cannot be planned."""


def strict(cls, given: dict[str, Any] | Any):
    """A record from a mapping; unknown keys are refused."""
    if not isinstance(given, dict):
        return given
    known = {f.name for f in dataclasses.fields(cls)}
    if extra := sorted(set(given) - known):
        raise ConfigError(f"{cls.__name__} does not know {', '.join(extra)}")
    return cls(**given)


@dataclass(frozen=True)
class Op:
    op: str
    field: str = ""
    fields: tuple[str, ...] = ()
    dest: str = ""
    pattern: str = ""
    replacement: str = ""
    value: Any = None
    value_kind: str = ""
    date_format: str = ""
    date_formats: tuple[str, ...] = ()
    decimals: int | None = None
    thousands: bool = False
    start: int | None = None
    end: int | None = None
    separator: str = ""
    condition: str = ""
    filter_values: tuple[str, ...] = ()
    filter_action: str = "keep"
    ignore_case: bool = False
    subset: tuple[str, ...] = ()
    scope: str = "task"

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ConfigError(f"no operator {self.op!r}")
        if self.op == "replace" and not self.pattern:
            raise ConfigError("replace needs a pattern")
        if self.op == "regex_replace":
            replacement(self.replacement, compiled(self.pattern).groups, dict(compiled(self.pattern).groupindex))
            java(self.pattern)
        if self.op == "filter" and self.condition not in CONDITIONS:
            raise ConfigError(f"no condition {self.condition!r}")
        if self.op == "filter" and self.filter_action not in ("keep", "drop"):
            raise ConfigError("filter_action is keep or drop")
        if self.op == "cast" and self.value_kind not in ("int", "float", "str", "date", "datetime"):
            raise ConfigError(f"no type {self.value_kind!r}")
        if self.op == "date_format":
            time_pattern(self.date_format, WRITE)
        for f in self.date_formats:
            time_pattern(f, READ)
        if self.op == "number_format" and not 0 <= (self.decimals or 0) <= 12:
            raise ConfigError("decimals lie between 0 and 12")
        if self.op == "dedupe" and self.scope not in ("file", "task"):
            raise ConfigError("scope is file or task")
        if self.op == "concat" and not (self.fields and self.dest):
            raise ConfigError("concat needs fields and dest")


@dataclass(frozen=True)
class Constraint:
    kind: str
    values: tuple[str, ...] = ()
    case_sensitive: bool = True
    pattern: str = ""
    mode: str = "fullmatch"
    min_length: int | None = None
    max_length: int | None = None
    pad_char: str = " "
    min_value: float | None = None
    max_value: float | None = None
    format: str = ""
    formats: tuple[str, ...] = ()
    type: str = ""
    unique_scope: str = "task"
    severity: str = "error"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ConfigError(f"no constraint {self.kind!r}")
        if self.kind == "regex":
            compiled(self.pattern)
            java(self.pattern)
        if self.kind == "unique" and self.severity == "warn":
            raise ConfigError("unique cannot be a warning")
        if self.kind == "enum" and not self.values:
            raise ConfigError("enum needs values")


@dataclass(frozen=True)
class Fallback:
    on_violation: str = "keep"
    default: str | None = None
    unique_suffix: str = "_"
    max_retries: int = 0

    def __post_init__(self) -> None:
        if self.on_violation not in ("keep", "truncate", "retry"):
            raise ConfigError(f"no fallback {self.on_violation!r}")


@dataclass(frozen=True)
class Generate:
    kind: str
    start: int = 0
    step: int = 1
    width: int = 0
    expression: str = ""
    generator: str = ""
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("sequence", "expression", "random"):
            raise ConfigError(f"no generator {self.kind!r}")
        if self.kind == "sequence" and not self.step:
            raise ConfigError("a sequence needs a step")
        if not 0 <= self.width <= 32:
            raise ConfigError("width lies between 0 and 32")


@dataclass(frozen=True)
class FieldSpec:
    dest: str
    source: str = ""
    default: str = ""
    constraints: tuple[Constraint, ...] = ()
    fallback: Fallback = Fallback()
    generate: Generate | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "constraints", tuple(strict(Constraint, c) for c in self.constraints))
        object.__setattr__(self, "fallback", strict(Fallback, self.fallback))
        object.__setattr__(self, "generate", strict(Generate, self.generate))
        if self.fallback.on_violation == "retry" and self.generate is None:
            raise ConfigError(f"{self.dest}: retry needs a generator")


@dataclass(frozen=True)
class Function:
    """User code on rows or columns, before the operators (pre) or after the constraints (post)."""

    name: str
    code: str
    input_fields: tuple[str, ...] = ()
    output_fields: tuple[str, ...] = ()
    phase: str = "pre"
    mode: str = "row"
    on_row_error: str = "keep"
    limits: Limits | None = None

    def __post_init__(self) -> None:
        for n in ("input_fields", "output_fields"):
            object.__setattr__(self, n, tuple(getattr(self, n)))
        if isinstance(self.limits, dict):
            try:
                object.__setattr__(self, "limits", Limits(**self.limits))
            except (TypeError, ValueError) as e:
                raise ConfigError(f"{self.name}: {e}") from e
        if self.phase not in ("pre", "post") or self.mode not in ("row", "column") or self.on_row_error not in ("keep", "empty"):
            raise ConfigError(f"{self.name}: phase is pre or post, mode row or column, on_row_error keep or empty")
        if not self.output_fields:
            raise ConfigError(f"{self.name}: no output fields")


@dataclass(frozen=True)
class Task:
    name: str
    fields: tuple[FieldSpec, ...]
    ops: tuple[Op, ...] = ()
    functions: tuple[Function, ...] = ()
    layout: str = "union"
    on_missing: str = "empty"
    seed: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(strict(FieldSpec, f) for f in self.fields))
        object.__setattr__(self, "ops", tuple(strict(Op, o) for o in self.ops))
        object.__setattr__(self, "functions", tuple(strict(Function, f) for f in self.functions))
        names = [f.dest for f in self.fields]
        if not names or len(set(names)) < len(names):
            raise ConfigError("field names must be there and differ")
        if self.layout not in ("union", "strict") or self.on_missing not in ("empty", "error", "skip_row"):
            raise ConfigError("layout is union or strict; on_missing is empty, error or skip_row")
        if self.layout == "strict" and any(not f.source and f.generate is None for f in self.fields):
            raise ConfigError("a strict layout needs a source for every field")

    @property
    def fingerprint(self) -> str:
        body = dataclasses.asdict(self)
        body.pop("name")
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:32]
