"""Table schemas. Every field is nullable unless it is a key."""

APPLICATION = (
    "todo_id string, bill_type string, bill_name string, apply_unit string, business_bill_id string, "
    "proc_inst_id string, act_inst_id string, act_inst_name string, task_id string, title string, "
    "apply_time timestamp"
)
CONFLICT = "struct<file:string,position:string,expected_code:string,actual_code:string>"
SUPPLIER = (
    "todo_id string, name string, full_name string, social_credit_code string, registered_capital double, "
    "actual_capital double, legal_person string, found_time string, established_years int, "
    "company_type string, sup_type string, state string, in_blacklist boolean, money_type string, "
    "busi_scope string, business_address string, is_overseas boolean, is_hmt boolean, is_foreign boolean, "
    "is_cooperation boolean, is_manufacturer boolean, country_name string, certifications array<string>, "
    f"iso_conflicts array<{CONFLICT}>, classified_materials array<string>, has_business_license boolean, "
    "has_legal_id_material boolean, has_production_license boolean, has_authorization boolean, "
    "has_after_sales_cert boolean, has_after_sales_statement boolean, has_tax_cert_material boolean, "
    "tax_credit_rating_ok boolean, has_financial_report boolean, has_inspection_cert boolean, "
    "is_inspection boolean, needs_production_license boolean, production_license_reason string, "
    "tyc_checked boolean, has_violation_3y boolean, is_dishonest boolean, qcc_finance_ok boolean"
)
MATERIAL = (
    "todo_id string, position int, upload_id string, file_name string, type_name string, file_desc string, "
    "file_summ string, file_title string, remark string, file_size bigint, types array<string>"
)
OCR_DOC = (
    "doc_id string, todo_id string, doc_type string, file string, position int, text string, sha256 string, "
    "engine string, error string"
)
OCR_LINE = (
    "doc_id string, page_id int, line_no int, text string, position array<array<double>>, confidence double"
)
EXTRACTION = (
    "todo_id string, doc_type string, doc_id string, position int, file string, "
    "fields map<string,string>, checks map<string,boolean>, issues array<string>, error string, ocr_mode string"
)
REGISTRY = (
    "key string, company_name string, credit_code string, legal_person string, registered_capital string, "
    "reg_status string, accuracy string, shareholders array<struct<name:string,share:string>>, "
    "controllers array<string>, financial string"
)
CARD = (
    "todo_id string, doc_id string, file string, page int, card_index int, side string, name string, "
    "valid_until string, status string"
)
CHECKLIST = (
    "todo_id string, rule_id string, position int, name string, status string, detail string, "
    "files array<string>"
)
PROGRESS = "todoId string, name string, decision string, ts string"
AUDIT_EVENT = (
    "chain string, seq bigint, at string, kind string, payload string, previous string, hash string"
)
TASK_STATUS = (
    "todo_id string, seq bigint, step string, status string, error string, progress int, ocr_mode string, "
    "started_at timestamp, updated_at timestamp"
)
FILE = "todo_id string, dir string, path string, length bigint, modified timestamp"


def conform(df, schema: str):
    """Add the columns of a schema that a table lacks, as null."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    wanted = T.DataType.fromDDL(schema) if hasattr(T.DataType, "fromDDL") else None
    missing = [field for field in wanted.fields if field.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
