"""The rule catalogue, predicate evaluation and the catalogue audit."""

from __future__ import annotations

import re
from dataclasses import dataclass
from importlib import resources

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lenient_sql

RULE_SCHEMA = (
    "part string, rule_set string, position int, id string, name string, review_order int, "
    "check_type string, predicate string, requirement string, verify string, fail_action string"
)
# functions a predicate may call; anything else makes the rule false
ALLOWED_CALLS = {
    "coalesce", "nullif", "ifnull", "nvl", "if", "array", "array_contains", "arrays_overlap", "size",
    "cardinality", "length", "lower", "upper", "trim", "contains", "startswith", "endswith", "abs",
    "round", "greatest", "least", "isnull", "isnotnull", "year", "datediff", "exists", "forall",
}
_WORDS_BEFORE_BRACKET = {"and", "or", "not", "in", "case", "when", "then", "else", "like", "between", "is"}


@dataclass(frozen=True)
class Rule:
    part: str
    rule_set: str
    position: int
    id: str
    name: str
    review_order: int | None
    check_type: str
    predicate: str | None
    requirement: str | None
    verify: str | None
    fail_action: str | None


def load_catalogue(path: str | None = None) -> list[Rule]:
    """Rules of parts 1 and 2 from a configuration file (the packaged one by default)."""
    if path:
        with open(path, encoding="utf-8") as source:
            config = yaml.safe_load(source)
    else:
        text = resources.files("gatehouse.resources").joinpath("rules.yaml").read_text(encoding="utf-8")
        config = yaml.safe_load(text)
    found = []
    for part in ("part_1_basic", "part_2_by_type"):
        for rule_set, rules in (config.get(part) or {}).items():
            for position, rule in enumerate(rules or []):
                found.append(Rule(
                    part, rule_set, position, rule["id"], rule.get("name", ""), rule.get("order"),
                    rule.get("check_type", ""), rule.get("predicate"), rule.get("requirement"),
                    rule.get("verify"), rule.get("fail_action")))
    return found


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(rule).values()) for rule in rules], RULE_SCHEMA)


def _calls_are_allowed(predicate: str) -> bool:
    without_text = re.sub(r"'[^']*'", "''", predicate)
    calls = {name.lower() for name in re.findall(r"([A-Za-z_][\w.]*)\s*\(", without_text)}
    words = {word.lower() for word in re.findall(r"[A-Za-z_]+", without_text)}
    return calls <= ALLOWED_CALLS | _WORDS_BEFORE_BRACKET and "select" not in words


def predicate_column(suppliers: DataFrame, predicate: str | None) -> Column:
    """The predicate as a Column that is true or false, never null; false if it is not legal here."""
    if not predicate or not _calls_are_allowed(predicate):
        return F.lit(False)
    try:
        checked = suppliers.select(F.expr(predicate).alias("ok")).schema["ok"].dataType
    except PySparkException:
        return F.lit(False)
    if not isinstance(checked, T.BooleanType):
        return F.lit(False)
    return F.coalesce(F.expr(predicate), F.lit(False))


def with_verdicts(suppliers: DataFrame, rules: list[Rule]) -> DataFrame:
    """One boolean column `ok_<rule>` per rule that has a predicate; one projection, no join."""
    spark = suppliers.sparkSession
    with lenient_sql(spark):
        out = suppliers.select("*", *[
            predicate_column(suppliers, rule.predicate).alias(f"ok_{rule.id}")
            for rule in rules if rule.check_type not in ("skip", "")
        ])
        out.schema  # resolve while casts and divisions still give null
    return out


def evaluate_rules(suppliers: DataFrame, rules: list[Rule], key: str = "todo_id") -> DataFrame:
    """(key, rule_id, ok) for every supplier and every rule with a predicate."""
    judged = with_verdicts(suppliers, rules)
    pairs = F.array(*[
        F.struct(F.lit(rule.id).alias("rule_id"), F.col(f"ok_{rule.id}").alias("ok"))
        for rule in rules if rule.check_type not in ("skip", "") and rule.predicate
    ])
    return judged.select(key, F.explode(pairs).alias("pair")).select(key, "pair.rule_id", "pair.ok")


def audit_rules(rules: DataFrame, columns: list[str]) -> DataFrame:
    """Catalogue faults: duplicate ids, missing predicates, unknown columns."""
    spark = rules.sparkSession
    duplicates = (rules.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .select("id", F.lit("duplicate id").alias("fault"), F.lit("").alias("what")))
    missing = (rules.filter("check_type in ('auto', 'material', 'qichacha') and id not in ('E2')")
               .filter("coalesce(predicate, '') = ''")
               .select("id", F.lit("missing predicate").alias("fault"), F.lit("").alias("what")))
    known = spark.createDataFrame([(c.lower(),) for c in columns], "what string")
    plain = F.regexp_replace("predicate", r"'[^']*'", "")
    names = F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(plain), F.lit(r"\b([a-z][a-z0-9]*_[a-z0-9_]+|certifications)\b(?!\s*\()"), F.lit(1))))
    used = rules.filter("predicate is not null").select("id", names.alias("what"))
    unknown = (used.join(known, "what", "left_anti")
               .select("id", F.lit("unknown column").alias("fault"), "what"))
    return duplicates.unionByName(missing).unionByName(unknown)
