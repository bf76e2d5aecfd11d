"""Which requests are reviewed by rules, and by which rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, lists
from ..functions.ordering import unnested
from ..functions.text import blank, first_word, has_any, trim
from .rules import Rule


def special_category(sup_type: Column) -> Column:
    """Name of the group-specific category, null if there is none."""
    return first_word(blank(sup_type), lists.SPECIAL_CATEGORIES)


def with_special(df: DataFrame) -> DataFrame:
    return df.withColumn("special_category", special_category(F.col("sup_type")))


def route_stage1(df: DataFrame) -> DataFrame:
    """P5: early decision of a new request, null where the rules decide."""
    special = special_category(F.col("sup_type"))
    bill = F.coalesce(F.nullif(F.col("bill_name"), F.lit("")), F.col("bill_type"))
    foreign_reject = F.col("is_foreign") & (F.col("bill_type") == "P0701")
    decision = (F.when(foreign_reject, "reject").when(F.col("is_foreign"), "manual")
                .when(F.col("is_hmt"), "manual").when(special.isNotNull(), "manual"))
    opinion = (
        F.when(foreign_reject, fixed.OPINION_FOREIGN_REJECT)
        .when(F.col("is_foreign"), F.concat(
            F.lit("转人工复核。国外供应商（审查类型："), bill, F.lit("），需人工审核。")))
        .when(F.col("is_hmt"), fixed.OPINION_HMT)
        .when(special.isNotNull(), F.concat(
            F.lit("转人工复核。该供应商属于集团独有类别（"), special,
            F.lit("），审查标准较复杂，需人工审核。"))))
    return df.withColumn("route_decision", decision).withColumn("route_opinion", opinion)


def route_stage2(df: DataFrame) -> DataFrame:
    """Early result of the re-decision, null where the rules decide."""
    special = special_category(F.col("sup_type"))
    hmt = F.coalesce(F.col("is_hmt"), F.lit(False))
    foreign = F.coalesce(F.col("is_foreign"), F.lit(False))
    reason = F.when(foreign, fixed.SKIP_FOREIGN).when(special.isNotNull(), F.concat(
        F.lit("该供应商属于集团独有类别（"), special, F.lit("），审查标准复杂，需转人工处理")))
    return (
        df.withColumn("route_decision", F.when(hmt, "manual").when(reason.isNotNull(), "skip"))
        .withColumn("route_type", F.when(hmt, "港澳台供应商").when(reason.isNotNull(), "不适用"))
        .withColumn("route_opinion", F.when(hmt, fixed.OPINION_HMT).otherwise(
            F.concat(F.lit("不适用。"), reason, F.lit("。"))))
    )


def labels(sup_type: Column) -> Column:
    """P10: single labels of a combined supplier type."""
    parts = F.transform(F.split(blank(sup_type), fixed.LABEL_SEPARATORS), trim)
    return F.filter(parts, lambda label: label != "")


def is_pure_carrier(parts: Column) -> Column:
    allowed = fixed.CARRIER_LABELS + fixed.CARRIER_SIDE_LABELS
    return F.exists(parts, lambda x: x.isin(fixed.CARRIER_LABELS)) & F.forall(
        parts, lambda x: x.isin(allowed))


def scope_roles(scope: Column) -> Column:
    """struct(carrier, trade); freight phrases are taken out before looking for trade."""
    text = blank(scope)
    rest = F.regexp_replace(text, fixed.CARRIER_SCOPE, "")
    return F.struct(text.rlike(fixed.CARRIER_SCOPE).alias("carrier"),
                    has_any(rest, fixed.TRADE_SCOPE_WORDS).alias("trade"))


def route_rule_sets(df: DataFrame) -> DataFrame:
    """`rule_sets` (in review order), `dropped_rules` and `type_desc` of each supplier."""
    staged = df.select(
        "*", labels(F.col("sup_type")).alias("__labels"), scope_roles(F.col("busi_scope")).alias("__scope"))
    kind, scope, parts = blank(F.col("sup_type")), blank(F.col("busi_scope")), F.col("__labels")
    foreign = F.coalesce(F.col("is_foreign"), F.lit(False))
    trade = F.col("__scope.trade")
    pure = is_pure_carrier(parts)
    by_scope = (F.col("__scope.carrier") & ~trade & ~foreign
                & F.forall(parts, lambda x: x.isin(fixed.GENERIC_LABELS)))
    maker_label = has_any(kind, fixed.MAKER_LABEL_WORDS)
    trader_label = has_any(kind, fixed.TRADER_LABEL_WORDS)
    service_label = kind.contains("服务") & ~has_any(kind, fixed.SERVICE_LABEL_VETO)
    guess_trade = ~foreign & has_any(scope, fixed.TRADE_WORDS)
    guess_make = ~foreign & has_any(scope, fixed.MAKE_WORDS)
    region = F.when(foreign, "境外").when(F.coalesce("is_overseas", F.lit(False)), "港澳台").otherwise("境内")

    def sets(word: str) -> Column:
        return F.when(foreign, f"overseas_{word}").otherwise(f"domestic_{word}")

    def label(word: str) -> Column:
        return F.concat(F.when(foreign, "境外").otherwise("境内"), F.lit(word))

    # the kind of route, in order of precedence
    route = (F.when(pure, "carrier").when(by_scope, "scope_carrier").when(maker_label, "maker")
             .when(trader_label, "trader").when(service_label & trade, "service_trader")
             .when(service_label, "service").when(guess_trade, "guess_trader")
             .when(guess_make, "guess_maker").otherwise("none"))
    staged = staged.withColumn("__route", route)
    route = F.col("__route")
    carrier = route.isin("carrier", "scope_carrier")
    base_set = (
        F.when(carrier & ~foreign, "domestic_carrier")
        .when(route.isin("maker", "guess_maker"), sets("manufacturer"))
        .when(route.isin("trader", "service_trader", "guess_trader"), sets("trader")))
    base_label = (
        F.when(route == "carrier", "运输/承运商").when(route == "scope_carrier", "运输/承运商（经营范围识别）")
        .when(route == "maker", label("厂家")).when(route == "trader", label("贸易商"))
        .when(route == "service_trader", "经销商/服务商（经营范围补充识别）").when(route == "service", "服务商")
        .when(route == "guess_trader", "境内贸易商（推断自经营范围）")
        .when(route == "guess_maker", "境内厂家（推断自经营范围）").otherwise(""))
    makes = (F.coalesce("is_manufacturer", F.lit(False)) | has_any(kind, fixed.MANUFACTURER_TYPE_WORDS)
             | has_any(scope, fixed.MAKE_WORDS)) & ~foreign & ~carrier
    full_label = (
        F.when(makes & (base_label == ""), "境内厂家（经营范围识别）")
        .when(makes & ~base_label.contains("厂家"), F.concat(base_label, F.lit("/厂家（经营范围补充识别）")))
        .otherwise(base_label))
    maker_set = F.when(makes, "domestic_manufacturer")
    rule_sets = F.array_distinct(F.array_compact(F.array(
        F.when(foreign, "overseas").otherwise("domestic"), base_set, maker_set)))
    # the manufacturer's ISO rules are the stricter ones; a carrier has no after-sales rule
    none = F.array().cast("array<string>")
    dropped = F.concat(
        F.when(carrier, F.array(F.lit("A07"))).otherwise(none),
        F.when(makes, F.array(*[F.lit(r) for r in ("D1_03", "D1_04", "D1_05")])).otherwise(none))
    return staged.select(
        *df.columns, rule_sets.alias("rule_sets"), dropped.alias("dropped_rules"),
        F.concat(region, F.when(full_label != "", F.concat(F.lit("·"), full_label)).otherwise("")).alias("type_desc"))


def applies(rule: Rule) -> Column:
    """The rule is in one of the supplier's rule sets and not dropped for it."""
    return F.array_contains("rule_sets", rule.rule_set) & ~F.array_contains("dropped_rules", rule.id)


# a supplier's rule sets always follow each other in this order
SET_ORDER = ["domestic", "overseas", "domestic_carrier", "domestic_trader", "overseas_trader",
             "domestic_manufacturer", "overseas_manufacturer"]


def in_review_order(rules: list[Rule]) -> list[Rule]:
    place = {name: i for i, name in enumerate(SET_ORDER)}
    return sorted(rules, key=lambda r: (place.get(r.rule_set, len(place)), r.position))


def rule_position(rule: Rule, rules: list[Rule]) -> Column:
    """Place in the supplier's list: rule sets in their order, rules in catalogue order."""
    return F.array_position("rule_sets", rule.rule_set) * 1000 + rule.position


def applicable_rules(routed: DataFrame, rules: list[Rule], key: str = "todo_id") -> DataFrame:
    """(key, rule_id, position) of every rule that applies to each supplier."""
    items = F.array_compact(F.array(*[
        F.when(applies(rule), F.struct(
            F.lit(rule.id).alias("rule_id"), rule_position(rule, rules).alias("position")))
        for rule in rules]))
    return unnested(routed, [key], items, "r").select(key, "r.rule_id", "r.position")
