"""One table of documents in, one table of extraction results out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.outcome import OUTCOME_TYPE
from ...functions.text import blank
from .certificates import (
    check_after_sales, check_authorization, check_generic, check_production, check_tax_credit,
    check_transport, page_texts, read_after_sales, read_authorization, read_generic, read_production,
    read_tax_credit, read_transport,
)
from .identity import idcard_text_checks, read_idcard_text
from .iso import check_iso, read_iso
from .licence import check_licence, read_licence

SUPPLIER_COLUMNS = [
    "todo_id", "name", "full_name", "social_credit_code", "legal_person", "registered_capital", "busi_scope"]
DOC_COLUMNS = ["doc_id", "todo_id", "doc_type", "file", "position", "text", "sha256", "engine", "error"]

READERS = {
    "business_license": (["business_license"], read_licence, check_licence),
    "legal_person_id": (["legal_person_id"], read_idcard_text, idcard_text_checks),
    "tax_credit": (["tax_credit"], read_tax_credit, check_tax_credit),
    "iso": (fixed.ISO_TYPES, read_iso, check_iso),
    "authorization": (["authorization"], read_authorization, check_authorization),
    "after_sales": (["after_sales_cert", "after_sales_statement"], read_after_sales, check_after_sales),
    "production": (["production_license"], read_production, check_production),
    "transport": (["transport_license"], read_transport, check_transport),
}
PAGED = {"production", "transport"}
#: Readers that are projections of a row.
PROJECTED = ["legal_person_id", "tax_credit", "iso", "authorization", "after_sales"]
DISABLED = ["financial_report"]
#: What a reading depends on: the content, the engine, and the type it is read as.
READING = ["sha256", "engine", "doc_type"]


def to_extract(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """The documents to read: one per (digest, engine, type) that has no cached reading.

    A document without digest or engine cannot share a reading and is read itself. The choice is made on
    digests alone, by a partial aggregate; texts meet only for the chosen rows. `shared_results` gives the results back.
    """
    known = F.col("sha256").isNotNull() & F.col("engine").isNotNull()
    cached = [c for c in READING if c in cache.columns]
    chosen = (docs.filter(known).select(*READING, "doc_id").join(cache.select(*cached).distinct(), cached, "left_anti")
              .groupBy(*READING).agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    return docs.filter(known).join(chosen, "doc_id", "left_semi").unionByName(docs.filter(~known))


def shared_results(docs: DataFrame, results: DataFrame, cache: DataFrame) -> DataFrame:
    """The result of every upload: its own, or that of the reading it shares.

    `results`: those of the documents `to_extract` chose (doc_id and whatever they hold); `cache`: the same columns with
    `READING` instead of doc_id. Names, positions and requests stay those of the upload.
    """
    known = F.col("sha256").isNotNull() & F.col("engine").isNotNull()
    values = [c for c in results.columns if c not in (*DOC_COLUMNS, *READING) or c == "error"]
    read = docs.select("doc_id", *READING).join(results.select("doc_id", *values), "doc_id")
    by_reading = read.filter(known).drop("doc_id").unionByName(cache.select(*READING, *values).join(
        read.filter(known).select(*READING), READING, "left_anti"))
    own = [c for c in docs.columns if c not in values]
    shared = docs.filter(known).select(*own).join(by_reading, READING, "left")
    alone = docs.filter(~known).select(*own).join(results.select("doc_id", *values), "doc_id", "left")
    return shared.select(*own, *values).unionByName(alone.select(*own, *values))


def _one_pass(rows: DataFrame, as_of: str) -> DataFrame:
    """Results of all kinds whose readers are projections: each reader sees the texts of its own types only, the generic one those that
    are left; a reader does no work on a row without a text.

    A reader's columns are dropped before the next one starts, so a row carries its text, its supplier and its result.
    """
    kept = rows.columns
    covered = [t for n in PROJECTED for t in READERS[n][0]]
    results = []
    for name in PROJECTED:
        types, read, check = READERS[name]
        mine = F.col("doc_type").isin(types) & F.col("error").isNull()
        staged = rows.select(*[c for c in rows.columns if c != "text"], F.col("text").alias("__text"), F.when(mine, blank(F.col("text"))).alias("text"))
        done = check(read(staged), as_of)
        rows = done.select(*[c for c in kept if c != "text"], *results, F.col("__text").alias("text"), F.when(mine, F.col("result")).alias(f"__{name}"))
        results.append(f"__{name}")
    left = ~F.coalesce(F.col("doc_type").isin(covered + DISABLED), F.lit(False)) & F.col("error").isNull()
    rows = rows.withColumn("text", F.when(left, blank(F.col("text"))))
    generic = check_generic(read_generic(rows), as_of).withColumnRenamed("result", "__generic")
    nothing = F.from_json(F.lit('{"fields":{},"checks":{},"issues":[]}'), OUTCOME_TYPE)
    failed = F.from_json(F.lit('{"issues":["OCR 失败，转人工核验"]}'), OUTCOME_TYPE)
    result = (F.when(F.col("error").isNotNull(), failed).when(F.col("doc_type").isin(DISABLED), nothing)
              .when(F.col("doc_type").isin(covered), F.coalesce(*results)).otherwise(F.col("__generic")))
    return generic.withColumn("result", result)


def extract_all(docs: DataFrame, lines: DataFrame, suppliers: DataFrame, as_of: str, types: list[str] | None = None) -> DataFrame:
    """Fields, checks and issues of every document by its type.

    All types but three are read in one pass over `docs` joined to its suppliers. Licences (a similarity in Python) and the
    two kinds that look at pages are branches of their own; `types`, the types that occur, leaves out branches that would find nothing.
    """
    known = suppliers.select(*SUPPLIER_COLUMNS)
    docs = docs.select(*DOC_COLUMNS)

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            "todo_id", "doc_type", "doc_id", "position", "file",
            F.col("result.fields").alias("fields"), F.col("result.checks").alias("checks"),
            F.col("result.issues").alias("issues"), "error", "engine")

    branches = [n for n in READERS if n not in PROJECTED]
    apart = [t for n in branches for t in READERS[n][0]]
    rest = ~F.coalesce(F.col("doc_type").isin(apart), F.lit(False)) | F.col("error").isNotNull()
    out = [finish(_one_pass(docs.filter(rest).join(known, "todo_id", "left"), as_of))]
    for name in branches:
        own, read, check = READERS[name]
        if types is not None and not set(own) & set(types):
            continue
        part = docs.filter(F.col("error").isNull() & F.col("doc_type").isin(own))
        fields = read(part, page_texts(lines)) if name in PAGED else read(part)
        out.append(finish(check(fields.join(known, "todo_id", "left"), as_of)))
    return reduce(DataFrame.unionByName, out)
