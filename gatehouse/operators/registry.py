"""Company registry: matching, related parties and what it changes in the checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, lists
from ..functions.numbers import registry_capital, short_number
from ..functions.ordering import computed_once, unnested
from ..functions.outcome import say
from ..functions.text import blank, has_any, or_null
from .financial import assessment_detail, report_periods

REG_FIELDS = ["company_name", "legal_person", "registered_capital", "reg_status"]


def match_registry(suppliers: DataFrame, registry: DataFrame, keys: list[str],
                   key: str = "todo_id") -> DataFrame:
    """The registry record of the first key, in the order given, that the registry knows.

    Keys become rows, so one equi-join serves all of them; a request keeps at most
    one candidate per key, and the best is taken by a partial aggregate.
    """
    ranked = F.array_compact(F.array(*[
        F.when(or_null(F.col(name).cast("string")).isNotNull(), F.struct(
            F.lit(rank).alias("rank"), F.col(name).cast("string").alias("key")))
        for rank, name in enumerate(keys)]))
    wanted = unnested(suppliers, [key], ranked, "k").select(key, "k.rank", "k.key")
    columns = [c for c in registry.columns if c != "key"]
    best = (wanted.join(registry, "key").groupBy(key).agg(
        # two records under one key: the first in the order of their values
        F.min_by(F.struct("rank", *columns), F.struct("rank", F.to_json(F.struct(*columns)))).alias("m")))
    return best.select(key, F.col("m.rank").alias("match_rank"), *[F.col(f"m.{c}").alias(c) for c in columns])


def related_parties(shareholders: DataFrame, words: list[str] | None = None,
                    name: str = "name") -> DataFrame:
    """Holders whose name contains a related-party word, with the first such word."""
    words = lists.RELATED_WORDS if words is None else words
    hit = F.coalesce(*[F.when(F.col(name).contains(word), F.lit(word)) for word in words])
    return shareholders.withColumn("related_word", hit).filter(F.col("related_word").isNotNull())


def _active(state: Column) -> Column:
    return has_any(state, fixed.ACTIVE_STATES)


def _identity_item() -> tuple[Column, Column, Column, Column]:
    """Whether the evidence is incomplete; status, detail and issue where it is not."""
    incomplete = (F.coalesce("r_accuracy", F.lit("")) != "一致")
    for field in REG_FIELDS:
        incomplete = incomplete | (blank(F.col(f"r_{field}")) == "")
    person, known = blank(F.col("legal_person")), blank(F.col("r_legal_person"))
    stated, system = registry_capital(F.col("r_registered_capital")), F.coalesce("registered_capital", F.lit(0.0))
    state = F.col("r_reg_status")
    capital_off = (F.coalesce(stated, F.lit(0.0)) != 0) & (system != 0) & (
        F.abs(stated - system) / F.greatest(system, F.lit(1.0)) > 0.01)
    found = F.array_compact(F.array(
        F.when((person != "") & (known != "") & (person != known), say(
            "法人不一致（审批系统:", person, " / 工商登记:", known, "）")),
        F.when(capital_off, say("注册资本不一致（审批系统:", short_number(system), "万 / 工商登记:",
                                short_number(stated), "万）")),
        F.when(~_active(state), say("工商登记状态异常：「", state, "」"))))
    text = F.array_join(found, "；")
    passed = say("企查查核验通过：名称/信用代码一致，法定代表人", known, "，注册资本", F.col("r_registered_capital"), "，登记状态「", state, "」")
    odd = F.size(found) > 0
    return (incomplete, F.when(odd, "fail").otherwise("pass"),
            F.when(odd, say("企查查核验发现问题：", text)).otherwise(passed), F.when(odd, say("法律主体资格：", text)))


def _related_item() -> tuple[Column, Column, Column]:
    """Status, detail, issue."""
    holders = F.coalesce("r_shareholders", F.array().cast("array<struct<name:string,share:string>>"))
    controller = blank(F.try_element_at(F.coalesce(
        "r_controllers", F.array().cast("array<string>")), F.lit(1)))
    related = F.transform(
        F.filter(holders, lambda h: has_any(blank(h["name"]), lists.RELATED_WORDS)),
        lambda h: say("股东「", h["name"], "」（持股", F.coalesce(h["share"], F.lit("?")), "）"))
    hits = F.array_join(F.concat(related, F.array_compact(F.array(F.when(
        has_any(controller, lists.RELATED_WORDS), say("实际控制人「", controller, "」"))))), "、")
    shown = F.array_join(F.transform(F.slice(holders, 1, 4), lambda h: say(
        blank(h["name"]), "(", blank(h["share"]), ")")), "、")
    found = hits != ""
    return (
        F.when(found, "fail").otherwise("partial"),
        F.when(found, say("企查查股权穿透发现中交系统关联：", hits)).otherwise(say(
            "企查查股权穿透：未发现中交系统关联（股东：", shown,
            F.when(controller != "", say("，实际控制人", controller)).otherwise(""), "）；身份证有效期仍需人工核验")),
        F.when(found, say("股权穿透发现中交关联：", hits)))


def _reputation_item(has_reg: Column) -> tuple[Column, Column, Column]:
    """A10: status, detail, issue."""
    state = blank(F.col("r_reg_status"))
    odd = has_reg & (state != "") & ~_active(state)
    return (
        F.when(odd, "fail").otherwise("manual"),
        F.when(~has_reg, "企查查未查到该企业数据，商业信誉（失信被执行人/被执行人/限制消费令/经营异常/严重违法）需人工核验")
        .when(odd, say("企查查登记状态异常：「", state, "」，需人工复核"))
        .otherwise(say("企查查登记状态「", state, "」正常；失信被执行人/被执行人/限制消费令/经营异常/严重违法："
                       "企查查无对应数据，需人工核验")),
        F.when(~has_reg, "A10 商业信誉：企查查无数据，需人工核验")
        .when(odd, say("商业信誉：企查查登记状态「", state, "」异常"))
        .otherwise("A10 商业信誉：失信/被执行等专项数据企查查无数据，需人工核验"))


def registry_facts(matched: DataFrame) -> DataFrame:
    """The matched record of each request under names of its own."""
    known = F.coalesce("has_reg_info", F.coalesce(*[F.col(c) for c in REG_FIELDS]).isNotNull())
    return matched.select("todo_id", known.alias("r_has_reg"), *[
        F.col(c).alias(f"r_{c}") for c in [*REG_FIELDS, "accuracy", "shareholders", "controllers", "financial"]])


def enrich_registry(requests: DataFrame, as_of: str) -> DataFrame:
    """K6 + K7: registry findings replace the status of A01, A02, A08 and A10 in `items`.

    `requests` carry their profile, their items and their registry facts, so this is a
    projection. Only the incomplete-evidence branch of A01 respects an earlier `fail`;
    the other branches overwrite it, and A08 is never passed. Adds `registry_issue`.
    """
    day = F.lit(as_of).cast("date")
    has_reg = F.coalesce("r_has_reg", F.lit(False))
    holders = F.size(F.coalesce("r_shareholders", F.array().cast("array<struct<name:string,share:string>>")))
    report = assessment_detail(report_periods(F.col("r_financial")), F.col("has_financial_report"), day)
    incomplete, *identity = _identity_item()

    def parts(applies: Column, values: list[Column] | tuple[Column, ...]) -> Column:
        """The outcome of a rule, null where the registry has nothing to say on it."""
        names = ("status", "detail", "registry_issue")
        return F.when(applies, F.struct(*[v.cast("string").alias(n) for v, n in zip(values, names)]))

    always = F.lit(True)
    outcomes = F.struct(
        (has_reg & incomplete).alias("incomplete"), parts(has_reg & ~incomplete, identity).alias("A01"),
        parts(has_reg | (holders > 0), _related_item()).alias("A02"),
        parts(always, (F.when(~F.col("has_financial_report"), "fail").otherwise("manual"), report, F.lit(None))).alias("A08"),
        parts(always, _reputation_item(has_reg)).alias("A10"))
    known = computed_once(requests, outcomes, "__outcomes")
    o = F.col("__outcomes")
    unsure = F.lit("企查查身份核验不完整或不一致，需人工核验")

    def enriched(item: Column) -> Column:
        rule, failed = item["rule_id"], item["status"] == "fail"
        own = F.struct(item["status"].alias("status"), item["detail"].alias("detail"), F.lit(None).cast("string").alias("registry_issue"))
        doubtful = F.struct(F.when(failed, "fail").otherwise("manual").alias("status"), F.when(failed, item["detail"]).otherwise(unsure).alias("detail"),
                            F.lit("法律主体资格：公开信息不足以确认一致").alias("registry_issue"))
        found = F.coalesce(
            F.when(rule == "A01", F.when(o["incomplete"], doubtful).otherwise(o["A01"])).when(rule == "A02", o["A02"])
            .when(rule == "A08", o["A08"].withField("registry_issue", say("A08 财报：", o["A08"]["detail"]))).when(rule == "A10", o["A10"]), own)
        return (item.withField("status", found["status"]).withField("detail", found["detail"])
                .withField("registry_issue", found["registry_issue"]))

    return known.withColumn("items", F.transform("items", enriched)).drop("__outcomes")
