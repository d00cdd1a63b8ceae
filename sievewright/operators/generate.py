"""Column producers: sequence, template and seeded random values.

Every value depends on the seed, the field, the input row number and the attempt only, so any
partitioning, retry or rerun gives the same column.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import patterns
from sievewright.operators.clean import ROW, text_of
from sievewright.plans.config import ConfigError, FieldSpec, Generate


def sequence(rule: Generate, row: Column) -> Column:
    """start + step * row, padded with zeros to ``width`` where it is not negative."""
    value = F.lit(rule.start).cast("bigint") + F.lit(rule.step).cast("bigint") * row
    shown = value.cast("string")
    if rule.width:
        shown = F.when((value >= 0) & (F.length(shown) < rule.width), F.lpad(shown, rule.width, "0")).otherwise(shown)
    return shown


def _draw(seed: int, field: str, row: Column, attempt: Column | int, use: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(field), row, F.lit(attempt) if isinstance(attempt, int) else attempt, F.lit(use))


def random_value(rule: Generate, seed: int, field: str, row: Column, attempt: int = 0) -> Column:
    """choice(values), random_int(min, max) or date(start, end, format), with an optional share of empties."""
    p = rule.params
    draw = _draw(seed, field, row, attempt, "value")
    if rule.generator == "choice":
        values = [str(v) for v in p.get("values") or ()]
        if not values:
            raise ConfigError(f"{field}: choice needs values")
        out = F.element_at(F.array(*map(F.lit, values)), (F.pmod(draw, F.lit(len(values))) + 1).cast("int"))
    elif rule.generator == "random_int":
        low, high = int(p.get("min", 0)), int(p.get("max", 1000))
        if high < low:
            raise ConfigError(f"{field}: max is below min")
        out = (F.lit(low).cast("bigint") + F.pmod(draw, F.lit(high - low + 1))).cast("string")
    elif rule.generator in ("date", "date_between"):
        first, last = date.fromisoformat(p.get("start") or "2000-01-01"), date.fromisoformat(p.get("end") or "2030-12-31")
        if last < first:
            raise ConfigError(f"{field}: the end is before the start")
        day = F.date_add(F.lit(first), F.pmod(draw, F.lit((last - first).days + 1)).cast("int"))
        out = patterns.write_time(day, p.get("format") or "%Y-%m-%d")
    else:
        raise ConfigError(f"{field}: no generator {rule.generator!r}")
    share = float(p.get("null_ratio") or 0)
    if not 0 <= share <= 1:
        raise ConfigError(f"{field}: null_ratio lies between 0 and 1")
    gap = F.pmod(_draw(seed, field, row, attempt, "null"), F.lit(1_000_000)) < int(share * 1_000_000)
    return F.when(gap, F.lit("")).otherwise(out) if share else out


def generated(df: DataFrame, spec: FieldSpec, seed: int = 0, attempt: int = 0) -> Column:
    rule = spec.generate
    if rule.kind == "sequence":
        return sequence(rule, F.col(ROW))
    if rule.kind == "expression":
        return patterns.render(rule.expression, {n: text_of(df, n) for n in df.columns if not n.startswith("_")})
    return random_value(rule, seed, spec.dest, F.col(ROW), attempt)


def generate_columns(df: DataFrame, specs: list[FieldSpec], seed: int = 0) -> DataFrame:
    """In declared order, so that later templates see earlier columns; retries while an error constraint is broken."""
    from sievewright.operators.quality import marked, violation

    for spec in specs:
        if spec.generate is None:
            continue
        df = df.withColumn(spec.dest, generated(df, spec, seed))
        if spec.fallback.on_violation == "retry":
            for attempt in range(1, spec.fallback.max_retries + 1):
                known = marked(df, spec)
                broken = known.withColumn("__broken", violation(known, spec).isNotNull()).select(*df.columns, "__broken")
                df = broken.withColumn(spec.dest, F.when(F.col("__broken"), generated(df, spec, seed, attempt)).otherwise(F.col(spec.dest))).drop("__broken")
    return df
