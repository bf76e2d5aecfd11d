"""Small builders: rows with only the columns a case needs."""

import pyspark.sql.types as T

from gatehouse import schemas


def frame(spark, schema: str, rows: list[dict]):
    """Rows given as dicts; columns that are not named are null."""
    fields = T.DataType.fromDDL(schema)
    return spark.createDataFrame([tuple(row.get(f.name) for f in fields.fields) for row in rows], fields)


def suppliers(spark, rows):
    return frame(spark, schemas.SUPPLIER, rows)


def applications(spark, rows):
    return frame(spark, schemas.APPLICATION, rows)


def materials(spark, rows):
    seen = {}
    for row in rows:
        row.setdefault("position", seen.setdefault(row["todo_id"], 0))
        seen[row["todo_id"]] += 1
    return frame(spark, schemas.MATERIAL, rows)


def documents(spark, cases):
    """cases: name -> (doc_type, text)."""
    return frame(spark, schemas.OCR_DOC, [
        {"doc_id": name, "todo_id": name, "doc_type": kind, "file": "a.png", "position": 0, "text": text, "engine": "e"}
        for name, (kind, text, *_) in cases.items()])


def lines(spark, rows):
    return frame(spark, schemas.OCR_LINE, rows)


def extract(spark, cases, detail=(), as_of="2026-09-16"):
    """cases: name -> (doc_type, text, supplier dict); gives name -> result row as dict."""
    from gatehouse.operators.extract import extract_all

    known = suppliers(spark, [{"todo_id": name, **(rest[0] if rest else {})} for name, (_, _, *rest) in cases.items()])
    out = extract_all(documents(spark, cases), lines(spark, list(detail)), known, as_of)
    return {r.todo_id: r.asDict() for r in out.collect()}
