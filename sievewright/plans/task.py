"""From a declared task and its files to cleaned rows: one plan, counters by observation, report from aggregates."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.text import folded_name
from sievewright.operators import clean, generate, profile, quality, userfn
from sievewright.plans.config import ConfigError, Constraint, FieldSpec, Task
from sievewright.sources import files

ORDER = ("_file", "_file_ord", "_row")


@dataclass
class Mapping:
    sources: dict[str, str | None]  # dest -> header
    missing: list[str]
    unmapped: list[str]


def bind(headers: list[str], specs: tuple[FieldSpec, ...]) -> Mapping:
    """Headers by exact name, else by folded name; the first header of a folded name wins; never by position."""
    folded: dict[str, str] = {}
    for h in headers:
        folded.setdefault(folded_name(h), h)
    sources = {s.dest: (s.source if s.source in headers else folded.get(folded_name(s.source))) if s.source else None for s in specs}
    missing = [s.dest for s in specs if s.source and sources[s.dest] is None]
    used = {h for h in sources.values() if h}
    return Mapping(sources, missing, [h for h in headers if h not in used])


def _headers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in files.META and c != "_unknown"]


def mapped(df: DataFrame, task: Task) -> DataFrame | None:
    """Source and dest columns of one header; None if the layout leaves the file out. All sources are read before any dest is written."""
    headers = _headers(df)
    m = bind(headers, task.fields)
    if m.missing and (task.layout == "strict" or task.on_missing == "error"):
        raise ConfigError(f"missing columns: {', '.join(m.missing)}")
    if m.missing and task.on_missing == "skip_row":
        return None
    dests = {s.dest for s in task.fields}
    made = [F.col(f"`{m.sources[s.dest]}`").alias(s.dest) if m.sources[s.dest] else F.lit(s.default).alias(s.dest) for s in task.fields]
    return df.select(*[F.col(f"`{h}`") for h in headers if h not in dests], *made, *[c for c in ORDER if c in df.columns])


@dataclass
class Plan:
    task: Task
    source: DataFrame
    before: DataFrame
    result: DataFrame
    checked: DataFrame
    counters: dict[str, Observation] = field(default_factory=dict)
    bindings: list[tuple[str, int, Mapping]] = field(default_factory=list)  # first file, number of files, by header

    @property
    def output(self) -> DataFrame:
        return self.result.select(*[s.dest for s in self.task.fields])

    def counts(self) -> dict[str, dict[str, int]]:
        """What the operators counted in the first action; that one should write, as a sort reads its input twice."""
        return {n: dict(o.get) for n, o in self.counters.items()}


def build(task: Task, source: DataFrame, observe: bool = True) -> Plan:
    """The whole plan over mapped rows: operators, generators, constraints with repair, final columns."""
    counters: dict[str, Observation] = {}

    def told(df: DataFrame, name: str, **metrics) -> DataFrame:
        if not observe or df.isStreaming:
            return df
        counters[name] = Observation(f"{task.name}:{name}")
        return df.observe(counters[name], *[m.alias(k) if k != "missing" else F.count(F.lit(1)).alias(k) for k, m in metrics.items()])

    df = clean.apply_ops(_run_functions(source, task, "pre"), task.ops, told)
    df = generate.generate_columns(df, list(task.fields), task.seed)
    for spec in task.fields:
        if spec.constraints:
            df = quality.enforce(df, spec)
    df = _run_functions(df, task, "post")
    return Plan(task, source, source, df, df, counters)


def _run_functions(df: DataFrame, task: Task, phase: str) -> DataFrame:
    """The user functions of a phase, one after another; messages of failed rows stay in ``_error_<name>``."""
    for f in task.functions:
        if f.phase == phase:
            df = userfn.apply_function(df, f.code, list(f.input_fields), list(f.output_fields), f.mode, f.on_row_error, f.limits).withColumnRenamed("_error", f"_error_{f.name}")
    return df


def plan(spark: SparkSession, task: Task, inputs: list[files.Input], row_limit: int | None = None, **options) -> Plan:
    """Files grouped by kind and header, each group one scan, all united by name."""
    parts, bindings = None, []
    groups: dict[tuple, list[files.Input]] = {}
    for i in inputs:
        if i.kind == "csv":
            raw = files.head(spark, i.path)
            encoding = options.get("encoding") or files.sniff_encoding(raw)
            shape = (encoding, raw.decode(encoding, "replace").splitlines()[:1])
        else:
            shape = tuple(files.json_keys(spark, i.path)) if i.kind == "jsonl" else ("one", i.path)
        groups.setdefault((i.kind, str(shape)), []).append(i)
    for items in groups.values():
        read = files.read(spark, items, **options)
        one = mapped(read, task)
        if one is not None:
            bindings.append((items[0].key, len(items), bind(_headers(read), task.fields)))
            if row_limit is not None:
                one = one.filter(F.col("_row") < row_limit)
            parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    if parts is None:
        raise ConfigError("no file has the columns of the task")
    made = build(task, parts)
    made.bindings = bindings
    return made


def dry_run(spark: SparkSession, task: Task, inputs: list[files.Input], rows: int = 20) -> list[dict]:
    """The same plan over the first rows of the first file."""
    p = plan(spark, task, inputs[:1], row_limit=rows)
    return [r.asDict() for r in p.result.orderBy("_file_ord", "_row").select(*[s.dest for s in task.fields]).limit(rows).collect()]


def report_frames(p: Plan) -> dict[str, DataFrame]:
    """The report's figures as frames: files, mapping, constraints, violations, samples of repairs, profiles before and after, top values, generated fields, regression."""
    dests = [s.dest for s in p.task.fields]
    old = [d for d in dests if d in p.before.columns]
    checked = [s for s in p.task.fields if s.constraints]
    rows_in = p.source.groupBy("_file").agg(F.count("*").alias("rows_in"))
    rows_out = p.result.groupBy("_file").agg(F.count("*").alias("rows_out"))
    out = {
        "files": rows_in.join(rows_out, "_file", "left").na.fill(0).withColumn("dropped", F.col("rows_in") - F.col("rows_out")),
        "before and after": profile.compared(profile.counts(p.before, old), profile.counts(p.result, dests), ["field"], ["n", "n_empty", "min_length", "max_length", "mean_length"]),
        "frequent values": profile.compared(profile.top_values(p.before, old, 5), profile.top_values(p.result, dests, 5), ["field", "text"], ["n"]),
    }
    spark = p.result.sparkSession
    if p.bindings:
        bound = [(key, n, s.dest, s.source, m.sources[s.dest], None if m.sources[s.dest] else s.default) for key, n, m in p.bindings for s in p.task.fields]
        out["mapping"] = spark.createDataFrame(bound, "first_file string, n_files int, field string, source string, header string, default string")
    made = [s for s in p.task.fields if s.generate is not None]
    if made:
        rules = spark.createDataFrame([(s.dest, s.generate.kind, s.generate.generator or s.generate.expression) for s in made], "field string, kind string, rule string")
        out["generated fields"] = rules.join(profile.counts(p.result, [s.dest for s in made]).select("field", "n", "n_empty"), "field", "left")
    if checked:
        rules = [(s.dest, k.kind, k.severity, s.fallback.on_violation, json.dumps(_set_values(k), ensure_ascii=False, sort_keys=True)) for s in checked for k in s.constraints]
        out["constraints"] = spark.createDataFrame(rules, "field string, kind string, severity string, policy string, settings string")
        out["repair samples"] = repair_samples(p, checked)
        out["violations"] = quality.violation_counts(p.checked, checked)
        out["regression"] = quality.regression(p.result.drop(*[c for c in p.result.columns if c.startswith("__")]), checked)
    return out


def _set_values(k: Constraint) -> dict:
    """What the constraint sets apart from the defaults."""
    return {f.name: getattr(k, f.name) for f in dataclasses.fields(k) if f.name not in ("kind", "severity") and getattr(k, f.name) != f.default}


def repair_samples(p: Plan, specs: list[FieldSpec], k: int = 5) -> DataFrame:
    """The first ``k`` broken cells of each field and kind with the value they got."""
    at = [c for c in ("_file_ord", "_row") if c in p.checked.columns]
    cells = [F.struct(F.lit(s.dest).alias("field"), F.col(f"__kind_{s.dest}").alias("kind"), F.col(s.dest).cast("string").alias("value")) for s in specs]
    broken = p.checked.select(*at, F.explode(F.filter(F.array(*cells), lambda v: v["kind"].isNotNull())).alias("v")).select("v.field", "v.kind", *at, "v.value")
    first = Window.partitionBy("field", "kind").orderBy(*at, "value")
    return broken.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)


def report(p: Plan) -> str:
    """The frames as Markdown; each is small by construction (by file, field or kind)."""
    parts = [f"# {p.task.name}", f"Configuration `{p.task.fingerprint}`, seed {p.task.seed}."]
    for title, df in report_frames(p).items():
        parts += [f"## {title}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join("–" if v is None else str(v).replace("|", "\\|").replace("\n", " ")[:80] for v in r) + " |" for r in df.orderBy(*df.columns[:2]).limit(1000).collect()]
    parts += ["## Counters"] + [f"- {n}: " + ", ".join(f"{k} {v}" for k, v in c.items()) for n, c in p.counts().items()]
    return redacted("\n".join(parts))


def redacted(text: str) -> str:
    """Masks what looks like a credential."""
    import re

    text = re.sub(r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[:=]\s*)\S+", r"\1\2***", text)
    return re.sub(r"(?i)(://[^/\s:@]+:)[^@\s/]+@", r"\1***@", text)
