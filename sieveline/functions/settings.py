"""Settings: a closed schema, layers, and constraint violations as rows."""

from __future__ import annotations

import math
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as T


@dataclass(frozen=True)
class Rule:
    """What a setting may be: its kind, and limits or choices."""

    kind: str
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


SWITCH, TEXT, TEXTS, PATHS = Rule("switch"), Rule("text"), Rule("texts"), Rule("paths")
COUNT, PERCENT = Rule("count", 1), Rule("number", 0, 100)

#: Modes, project types, and the settings there are with their defaults.
MODES = ("pass_warn_fail", "pass_fail", "pass_warn")
PROJECT_TYPES = ("cpp", "hybrid", "python")
CHECK = {"enabled": SWITCH, "required": SWITCH, "mode": Rule("text", choices=MODES)}
SCHEMA: dict[str, dict[str, Rule]] = {
    "": {"name": TEXT, "version": TEXT, "type": Rule("text", choices=PROJECT_TYPES)},
    "project": {"source_dirs": PATHS, "name": TEXT, "version": TEXT, "type": Rule("text", choices=PROJECT_TYPES)},
    "build.python": {"entrypoint": TEXT},
    "engines.line": CHECK | {"warn_limit": COUNT, "fail_limit": COUNT, "gate_dirs": PATHS, "include_dirs": PATHS, "exclude_dirs": PATHS},
    "engines.lint": CHECK | {"ruff_required": SWITCH},
    "engines.test": CHECK | {"min_tem_score": Rule("number", 0, 5), "min_branch_cov": PERCENT, "min_func_cov": PERCENT, "coverage_required": SWITCH, "python": TEXT},
    "engines.type": CHECK | {"fail_on_error": SWITCH, "warn_on_missing_annotation": SWITCH, "mypy_required": SWITCH},
    "engines.complexity": CHECK | {"warn_cc": COUNT, "fail_cc": COUNT, "warn_nesting": COUNT},
    "engines.sanitize": CHECK,
    "engines.dead": CHECK,
    "engines.dup": CHECK | {"warn_pct": PERCENT, "fail_pct": PERCENT, "min_window": COUNT},
    "engines.exception": CHECK,
    "engines.toolchain": CHECK | {"required_tools": TEXTS, "tools": TEXTS},
}
DEFAULTS = {"engines.line.warn_limit": 500, "engines.line.fail_limit": 1000, "engines.complexity.warn_cc": 15, "engines.complexity.fail_cc": 25, "engines.dup.warn_pct": 5.0, "engines.dup.fail_pct": 15.0}
ORDERED = (("engines.line.warn_limit", "engines.line.fail_limit"), ("engines.complexity.warn_cc", "engines.complexity.fail_cc"), ("engines.dup.warn_pct", "engines.dup.fail_pct"))


def inside(path: str) -> bool:
    """Whether a path stays below where it starts."""
    return not path.startswith("/") and not posixpath.normpath(path).startswith("..")


def trouble(rule: Rule, value) -> str | None:
    """What is wrong with a value, null if nothing."""
    if rule.kind == "switch":
        return None if isinstance(value, bool) else "must be a boolean"
    if rule.kind == "text":
        if not isinstance(value, str) or not value.strip():
            return "must be a non-empty string"
        return None if not rule.choices or value in rule.choices else f"must be one of: {', '.join(sorted(rule.choices))}"
    if rule.kind in ("texts", "paths"):
        if not isinstance(value, list) or any(not isinstance(v, str) or not v for v in value):
            return "must be a list of non-empty strings"
        return "must stay inside the project" if rule.kind == "paths" and not all(map(inside, value)) else None
    if isinstance(value, bool) or not isinstance(value, int if rule.kind == "count" else (int, float)):
        return "must be an integer" if rule.kind == "count" else "must be a number"
    if not math.isfinite(value):
        return "must be finite"
    if rule.least is not None and value < rule.least:
        return f"must be greater than or equal to {rule.least:g}"
    return f"must be less than or equal to {rule.most:g}" if rule.most is not None and value > rule.most else None


def flattened(config: dict, schema: dict | None = None, path: str = "") -> dict[str, object]:
    """Dotted paths and values; tables that the schema does not know stay whole."""
    schema = SCHEMA if schema is None else schema
    out: dict[str, object] = {}
    for key, value in config.items():
        below = f"{path}.{key}" if path else str(key)
        known = below in schema or any(section.startswith(f"{below}.") for section in schema)
        if known and isinstance(value, dict):
            out |= flattened(value, schema, below)
        else:
            out[below] = value
    return out


def problems(config: dict, schema: dict | None = None) -> list[tuple[str, str]]:
    """(path, message) of everything that is wrong with nested settings, in order of path."""
    schema = SCHEMA if schema is None else schema
    flat, found = flattened(config, schema), []
    for path, value in flat.items():
        section, _, key = path.rpartition(".")
        if path in schema or any(name.startswith(f"{path}.") for name in schema):
            found.append((path, "must be a table"))
        elif key not in schema.get(section, {}):
            found.append((path, "is an unknown configuration key"))
        elif said := trouble(schema[section][key], value):
            found.append((path, said))
    wrong = {path for path, _ in found}
    for low, high in ORDERED:
        if not {low, high} & wrong and flat.get(low, DEFAULTS[low]) > flat.get(high, DEFAULTS[high]):
            found.append((low, f"must be less than or equal to {high}"))
    return sorted(found)


def validated(*layers: dict) -> dict:
    """Layers merged, later ones winning; an error names everything that is wrong."""
    config: dict = {}
    for layer in layers:
        config = merged(config, layer)
    if found := problems(config):
        raise ValueError("; ".join(f"{path} {said}" for path, said in found))
    return config


def setting_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, message) of rows (key, path, json): one setting each, its value as JSON.

    The same rules as `problems`, as expressions over a broadcast of the schema, for
    settings of many projects at once.
    """
    value = F.col("json")
    is_text, is_list = value.rlike(r'\A"(?s:.*)"\z'), value.rlike(r"\A\[")
    is_switch, is_count, is_number = value.isin("true", "false"), value.rlike(r"\A-?\d+\z"), value.rlike(r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z")
    text, number = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value.try_cast("double")
    items = F.from_json(value, "array<string>")
    listed = is_list & F.coalesce(F.forall(items, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(False))
    climbs = F.exists(items, lambda v: F.startswith(v, F.lit("/")) | (T.normal_path(F.concat(F.lit("/a/"), v)) != "/a") & ~F.startswith(T.normal_path(F.concat(F.lit("/a/"), v)), F.lit("/a/")) | (T.normal_path(F.concat(F.lit("/a/"), v)) == "/"))
    found = F.lit("is an unknown configuration key")
    for section, rules in SCHEMA.items():
        for name, rule in rules.items():
            if rule.kind == "switch":
                said = F.when(~is_switch, "must be a boolean")
            elif rule.kind == "text":
                said = F.when(~is_text | (F.trim(text) == ""), "must be a non-empty string")
                if rule.choices:
                    said = said.when(~text.isin(*rule.choices), f"must be one of: {', '.join(sorted(rule.choices))}")
            elif rule.kind in ("texts", "paths"):
                said = F.when(~listed, "must be a list of non-empty strings")
                if rule.kind == "paths":
                    said = said.when(climbs, "must stay inside the project")
            else:
                said = F.when(~(is_count if rule.kind == "count" else is_number), "must be an integer" if rule.kind == "count" else "must be a number")
                if rule.least is not None:
                    said = said.when(number < rule.least, f"must be greater than or equal to {rule.least:g}")
                if rule.most is not None:
                    said = said.when(number > rule.most, f"must be less than or equal to {rule.most:g}")
            found = F.when(F.col("path") == (f"{section}.{name}" if section else name), said).otherwise(found)
    judged = rows.select(key, "path", "json", found.alias("message"))
    single = judged.where(F.col("message").isNotNull()).select(key, "path", "message")
    pairs = single.limit(0)
    for low, high in ORDERED:
        both = judged.where(F.col("path").isin(low, high)).groupBy(key).agg(
            F.bool_and(F.col("message").isNull()).alias("fine"),
            *[F.coalesce(F.max(F.when(F.col("path") == path, F.col("json").try_cast("double"))), F.lit(float(DEFAULTS[path]))).alias(name) for path, name in ((low, "low"), (high, "high"))],
        )
        pairs = pairs.unionByName(both.where(F.col("fine") & (F.col("low") > F.col("high"))).select(key, F.lit(low).alias("path"), F.lit(f"must be less than or equal to {high}").alias("message")))
    return single.unionByName(pairs)


def merged(base: dict, over: dict) -> dict:
    """Nested settings, key by key, the right side winning."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def layered(rows: DataFrame, keys: list[str], rank: str = "rank", value: str = "value") -> DataFrame:
    """For each key the value of the highest layer."""
    return rows.groupBy(*keys).agg(F.max_by(value, rank).alias(value))


def violations(rows: DataFrame, key: str, constraints: dict[str, Column]) -> DataFrame:
    """(key, constraint) of every row that breaks one; a null outcome breaks it too."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in constraints.items()]), lambda c: c.isNotNull())
    return rows.select(key, F.explode(broken).alias("constraint"))


def innermost(rows: DataFrame, key: str, depth: str, decision: str) -> DataFrame:
    """For each key the decision of the innermost scope that has one."""
    return rows.where(F.col(decision).isNotNull()).groupBy(key).agg(F.max_by(decision, depth).alias(decision))
