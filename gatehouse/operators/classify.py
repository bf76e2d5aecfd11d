"""Classification of uploaded materials, as projections over the materials table.

The dictionaries are short and fixed, so a dictionary is compiled into one array
expression per row: no join, no row blow-up, and any number of matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (
    blank, drop_number_prefix, file_stem, fold_squeeze, fold_width, has, has_any, or_null,
)

EMPTY_TYPES = "array<string>"


def _set(*types: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*types)))


def _none() -> Column:
    return F.array().cast(EMPTY_TYPES)


def slot_types(type_name: Column, slots: dict[str, str] | None = None) -> Column:
    """Type of an exact slot name."""
    slots = fixed.SLOT_TYPES if slots is None else slots
    by_type: dict[str, list[str]] = {}
    for slot, kind in slots.items():
        by_type.setdefault(kind, []).append(slot)
    return _set(*[F.when(type_name.isin(names), F.lit(kind)) for kind, names in by_type.items()])


def keyword_types(text: Column, keywords: list[tuple[str, str]] | None = None) -> Column:
    """Types of all keywords the text contains, whatever their case."""
    keywords = fixed.KEYWORD_TYPES if keywords is None else keywords
    by_type: dict[str, list[str]] = {}
    for word, kind in keywords:
        by_type.setdefault(kind, []).append(word.lower())
    lowered = F.lower(text)
    return _set(*[F.when(has_any(lowered, words), F.lit(kind)) for kind, words in by_type.items()])


def keyword_dimension(spark: SparkSession, keywords: list[tuple[str, str]] | None = None) -> DataFrame:
    keywords = fixed.KEYWORD_TYPES if keywords is None else keywords
    rows = [(word, priority, kind) for priority, (word, kind) in enumerate(keywords)]
    return spark.createDataFrame(rows, "keyword string, priority int, type string")


def classify_by_slot(mats: DataFrame, slots: dict[str, str] | None = None) -> DataFrame:
    return mats.withColumn("slot_types", slot_types(F.col("type_name"), slots))


def classify_by_keyword(mats: DataFrame, keywords: list[tuple[str, str]] | None = None,
                        text: Column | None = None) -> DataFrame:
    text = upload_text() if text is None else text
    return mats.withColumn("keyword_types", keyword_types(text, keywords))


def classify_by_name(files: DataFrame, pairs: list[tuple[list[str], str]] | None = None,
                     name: str = "file_name") -> DataFrame:
    """Type of the first dictionary line one of whose words the name contains."""
    pairs = fixed.NAME_TYPES if pairs is None else pairs
    first = F.coalesce(*[F.when(has_any(F.col(name), words), F.lit(kind)) for words, kind in pairs])
    return files.withColumn("name_type", first)


def upload_text() -> Column:
    """What keywords are looked up in: name, description and summary, never the slot name."""
    return F.concat_ws(" ", *[blank(F.col(c)) for c in ("file_name", "file_desc", "file_summ")])


def _slot_forms(slot: str) -> list[str]:
    return [slot + suffix for suffix in ["", *fixed.ISO_SLOT_SUFFIXES]]


def iso_candidates(file_name: Column, type_name: Column) -> Column:
    """ISO numbers in the name, else the slot or a known stem."""
    name = fold_width(blank(file_name))
    slot = fold_squeeze(type_name)
    numbers = _set(*[F.when(name.contains(code), F.lit("iso" + code)) for code in fixed.ISO_CODES])
    stem = drop_number_prefix(file_stem(name))
    others = _set(
        *[F.when(slot.isin(_slot_forms(words)), F.lit(kind)) for words, kind in fixed.ISO_SLOT_TYPES.items()],
        F.when(stem.isin(fixed.ISO14001_STEMS), F.lit("iso14001")),
    )
    return F.when(F.size(numbers) > 0, numbers).otherwise(others)


def iso_code_of_name(name: Column) -> Column:
    return F.coalesce(*[F.when(name.contains(code), F.lit(code)) for code in fixed.ISO_CODES])


def iso_code_of_slot(slot: Column) -> Column:
    return F.coalesce(*[F.when(slot.rlike(words), F.lit(code)) for words, code in fixed.ISO_SLOT_WORDS])


def resolve_types(types: Column, metadata: Column) -> Column:
    """An accreditation mark on an ISO certificate is not an inspection certificate."""
    iso = F.array(*[F.lit(kind) for kind in fixed.ISO_TYPES])
    marked_only = F.arrays_overlap(types, iso) & ~has(metadata, fixed.EXPLICIT_INSPECTION)
    return F.when(marked_only, F.array_remove(types, "inspection_cert")).otherwise(types)


TYPES = sorted(set(fixed.SLOT_TYPES.values()) | {kind for _, kind in fixed.KEYWORD_TYPES})


def flag(kind: str) -> str:
    return f"is_{kind}"


def listed(flags: dict[str, Column]) -> Column:
    """The names whose flag is set, in the order given (no lambda, so it stays in generated code)."""
    text = F.concat_ws(",", *[F.when(column, F.lit(name)) for name, column in flags.items()])
    return F.when(text == "", _none()).otherwise(F.split(text, ","))


def with_type_flags(mats: DataFrame, slots: dict[str, str] | None = None,
                    keywords: list[tuple[str, str]] | None = None) -> DataFrame:
    """C1-C5 as one boolean column per material type, plus `slot_code` and `name_code` of a clash.

    Texts are normalised once in a step of their own; what follows are plain
    comparisons in generated code.
    """
    slots = fixed.SLOT_TYPES if slots is None else slots
    keywords = fixed.KEYWORD_TYPES if keywords is None else keywords
    name, slot = blank(F.col("file_name")), blank(F.col("type_name"))
    texts = mats.select(
        *[c for c in mats.columns if c != "types"],
        F.lower(upload_text()).alias("__text"), fold_width(name).alias("__name"), slot.alias("__slot"),
        iso_code_of_name(name).alias("__in_name"), iso_code_of_slot(slot).alias("__in_slot"))
    text, slot = F.col("__text"), F.col("__slot")
    clash = F.coalesce(F.col("__in_name") != F.col("__in_slot"), F.lit(False))
    numbered = has_any(F.col("__name"), fixed.ISO_CODES)
    stem = drop_number_prefix(file_stem(F.col("__name")))
    texts = texts.select(
        "*", clash.alias("__clash"), numbered.alias("__numbered"),
        F.when(~numbered, fold_squeeze(slot)).alias("__plain_slot"),
        F.when(~numbered & F.col("__name").contains("环境管理"), stem.isin(fixed.ISO14001_STEMS)).alias("__stem"))
    found = {}
    for kind in sorted(set(slots.values()) | {k for _, k in keywords}):
        hit = F.lit(False)
        places = [s for s, k in slots.items() if k == kind]
        words = [w.lower() for w, k in keywords if k == kind]
        if kind in fixed.ISO_TYPES:
            code = kind[3:]
            iso_places = [f for s, k in fixed.ISO_SLOT_TYPES.items() if k == kind for f in _slot_forms(s)]
            by_slot = slot.isin(places) | F.coalesce(F.col("__plain_slot").isin(iso_places), F.lit(False))
            if kind == "iso14001":
                by_slot = by_slot | F.coalesce("__stem", F.lit(False))
            hit = (has_any(F.col("__name"), [code]) | by_slot | has_any(text, words))
            hit = (hit & ~(F.col("__clash") & (F.col("__in_slot") == code))) | (
                F.col("__clash") & (F.col("__in_name") == code))
        else:
            if places:
                hit = hit | slot.isin(places)
            if words:
                hit = hit | has_any(text, words)
        found[kind] = F.coalesce(hit, F.lit(False))
    flagged = texts.select("*", *[column.alias(flag(kind)) for kind, column in found.items()])
    if "inspection_cert" in found:
        iso = reduce(Column.__or__, [F.col(flag(k)) for k in fixed.ISO_TYPES if k in found], F.lit(False))
        metadata = F.concat_ws(" ", F.col("file_name"), slot, F.col("file_desc"))
        kept = F.col("is_inspection_cert") & (~iso | is_explicit(metadata))
        flagged = flagged.withColumn("is_inspection_cert", kept)
    rest = [c for c in mats.columns if c != "types"]
    return flagged.select(
        *rest, *[flag(kind) for kind in found],
        F.when(F.col("__clash"), F.col("__in_slot")).alias("slot_code"),
        F.when(F.col("__clash"), F.col("__in_name")).alias("name_code"))


def classify_materials(mats: DataFrame, slots: dict[str, str] | None = None,
                       keywords: list[tuple[str, str]] | None = None) -> DataFrame:
    """Uploads with `types` (sorted) and the ISO numbers of a slot/name clash."""
    flagged = with_type_flags(mats, slots, keywords)
    kinds = [c[3:] for c in flagged.columns if c.startswith("is_") and c not in mats.columns]
    rest = [c for c in mats.columns if c != "types"]
    return flagged.select(
        *rest, listed({kind: F.col(flag(kind)) for kind in kinds}).alias("types"), "slot_code", "name_code")


def conflict_of(file: Column, slot: Column, expected: Column, actual: Column) -> Column:
    return F.struct(file.alias("file"), slot.alias("position"),
                    expected.alias("expected_code"), actual.alias("actual_code"))


def iso_conflicts(mats: DataFrame) -> DataFrame:
    """C4: one row per upload whose name and slot state different ISO numbers."""
    return mats.filter("slot_code is not null").select(
        "todo_id", "position", F.col("file_name").alias("file"), F.col("type_name").alias("slot"),
        F.col("slot_code").alias("expected_code"), F.col("name_code").alias("actual_code"))


def first_conflicts(mats: DataFrame) -> DataFrame:
    """The first conflict per ISO number of each request (at most three), from the clashing uploads only."""
    conflict = conflict_of(*[F.col(c) for c in ("file", "slot", "expected_code", "actual_code")])
    firsts = [F.min(F.when(F.col("expected_code") == code, F.struct(F.col("position").alias("at"), conflict.alias("c"))))
              for code in fixed.ISO_CODES]
    return (iso_conflicts(mats).groupBy("todo_id").agg(F.array_compact(F.array(*firsts)).alias("x"))
            .select("todo_id", F.transform("x", lambda r: r["c"]).alias("iso_conflicts")))


def certifications(types: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.array_contains(types, kind), F.lit(kind.upper())) for kind in sorted(fixed.ISO_TYPES)]))


def material_rollup(mats: DataFrame) -> DataFrame:
    """Type set and certifications of each request.

    Every type is one boolean that is combined before the shuffle, so a request
    with any number of uploads costs the same small row per task.
    """
    kinds = [c for c in mats.columns if c.startswith("is_")]
    if not kinds:
        mats = mats.select("todo_id", *[
            F.array_contains(F.coalesce("types", _none()), kind).alias(flag(kind)) for kind in TYPES])
        kinds = [flag(kind) for kind in TYPES]
    rolled = mats.groupBy("todo_id").agg(
        *[F.bool_or(kind).alias(kind) for kind in kinds], F.count(F.lit(1)).alias("uploads"))
    return rolled.select("todo_id", *_roll_columns(kinds), "uploads")


def _roll_columns(kinds: list[str]) -> list[Column]:
    iso = {k.upper(): F.col(flag(k)) for k in sorted(fixed.ISO_TYPES) if flag(k) in kinds}
    return [listed({kind[3:]: F.col(kind) for kind in sorted(kinds)}).alias("classified_materials"),
            listed(iso).alias("certifications")]


def material_facts(mats: DataFrame) -> DataFrame:
    """All that a decision asks of the uploads (with type flags), in one hash aggregate over fixed-width values."""
    from .financial import year_bits, years_of

    kinds = [c for c in mats.columns if c.startswith("is_")]
    financial = F.col("is_financial_report") | has_financial_words()
    low, high = year_bits(financial)
    rolled = mats.groupBy("todo_id").agg(
        *[F.bool_or(kind).alias(kind) for kind in kinds],
        F.bool_or(financial).alias("financial_submitted"),
        F.bit_or(low).alias("__low"), F.bit_or(high).alias("__high"),
        F.bool_or(performance_flag()).alias("has_performance"),
        F.bool_or(transport_flag()).alias("has_transport"),
        *[F.bool_or(F.coalesce(F.col("slot_code") == code, F.lit(False))).alias(f"clash_{code}")
          for code in fixed.ISO_CODES])
    return rolled.select(
        "todo_id", *_roll_columns(kinds), "financial_submitted",
        years_of(F.col("__low"), F.col("__high")).alias("financial_years"), "has_performance", "has_transport",
        *[f"clash_{code}" for code in fixed.ISO_CODES])


def material_summary(mats: DataFrame) -> DataFrame:
    """The facts of `material_facts` with the texts of `proof_files` and `first_conflicts`, from one pass over the uploads.

    Uploads are folded by (request, name if the name is wanted) over fixed-width values first, which spreads a
    large request by its names; per request only the flagged names meet.
    """
    from .financial import year_bits, years_of

    kinds = [c for c in mats.columns if c.startswith("is_")]
    financial = F.col("is_financial_report") | has_financial_words()
    low, high = year_bits(financial)
    rows = mats.select(
        "todo_id", "position", "file_name", "type_name", "slot_code", "name_code", *kinds, low.alias("__low"), high.alias("__high"),
        financial.alias("__financial"), performance_flag().alias("__performance"), transport_flag().alias("__transport"))
    clash = F.col("slot_code").isNotNull()
    named = F.coalesce(F.col("__performance") | F.col("__transport") | clash, F.lit(False))
    keys = [F.when(named, F.col("file_name")).alias("__name"), F.when(clash, F.col("type_name")).alias("__slot"), "slot_code", "name_code"]
    cells = rows.groupBy("todo_id", *keys).agg(
        *[F.bool_or(kind).alias(kind) for kind in kinds], F.bool_or("__financial").alias("__financial"),
        F.bit_or("__low").alias("__low"), F.bit_or("__high").alias("__high"),
        F.bool_or("__performance").alias("has_performance"), F.bool_or("__transport").alias("has_transport"),
        F.min(F.when(F.col("__performance"), F.col("position"))).alias("__proof_at"),
        F.min(F.when(F.col("__transport"), F.col("position"))).alias("__transport_at"),
        F.min(F.when(clash, F.col("position"))).alias("__clash_at"))
    conflict = conflict_of(F.col("__name"), F.col("__slot"), F.col("slot_code"), F.col("name_code"))

    def gathered(seen: Column, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(seen, value)))

    def listed_names(flagged: str, at: str) -> Column:
        return gathered(F.col(flagged), F.struct(F.col(at).alias("at"), F.col("__name").alias("name")))

    rolled = cells.groupBy("todo_id").agg(
        *[F.bool_or(kind).alias(kind) for kind in kinds], F.bool_or("__financial").alias("financial_submitted"),
        F.bit_or("__low").alias("__low"), F.bit_or("__high").alias("__high"),
        F.bool_or("has_performance").alias("has_performance"), F.bool_or("has_transport").alias("has_transport"),
        listed_names("has_performance", "__proof_at").alias("__proofs"), listed_names("has_transport", "__transport_at").alias("__papers"),
        *[F.min(F.when(F.col("slot_code") == code, F.struct(F.col("__clash_at").alias("at"), conflict.alias("c")))).alias(f"__first_{code}")
          for code in fixed.ISO_CODES])

    def text(names: str) -> Column:
        return F.nullif(F.array_join(F.array_distinct(F.transform(names, lambda r: r["name"])), "、"), F.lit(""))

    firsts = F.array_compact(F.array(*[F.col(f"__first_{code}.c") for code in fixed.ISO_CODES]))
    return rolled.select(
        "todo_id", *_roll_columns(kinds), "financial_submitted", years_of(F.col("__low"), F.col("__high")).alias("financial_years"),
        "has_performance", "has_transport", text("__proofs").alias("performance_files"), text("__papers").alias("transport_files"),
        F.when(F.size(firsts) > 0, firsts).alias("iso_conflicts"))


def has_financial_words() -> Column:
    return has_any(F.concat_ws(" ", F.col("file_name"), F.col("type_name")), fixed.FINANCIAL_TITLE)


def hydrate(mats: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-derive ISO types of old records and add them to the supplier row."""
    metadata = F.concat_ws(" ", *[blank(F.col(c)) for c in ("file_name", "type_name", "file_desc")])
    renewed = mats.withColumn("types", F.array_sort(resolve_types(
        F.array_union(F.coalesce("types", _none()), iso_candidates(F.col("file_name"), F.col("type_name"))),
        metadata)))
    iso = F.array(*[F.lit(kind) for kind in fixed.ISO_TYPES])
    found = (renewed.groupBy("todo_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("types", iso))))).alias("__iso")))
    upper = F.transform(F.coalesce("__iso", _none()), lambda kind: F.upper(kind))
    updated = (suppliers.join(found, "todo_id", "left")
               .withColumn("classified_materials", F.array_sort(F.array_union(
                   F.coalesce("classified_materials", _none()), F.coalesce("__iso", _none()))))
               .withColumn("certifications", F.array_sort(F.array_union(
                   F.coalesce("certifications", _none()), upper)))
               .drop("__iso"))
    return renewed, updated


def match_files(files: DataFrame, mats: DataFrame) -> DataFrame:
    """C8 + C9: types of a stored file from all uploads of its owner with that name.

    A file matches under its own name or without its numeric prefix. A sensitive
    word in any matching upload adds the type `sensitive`; an old licence file
    loses its type when the owner filled the canonical licence slot with another file.

    Uploads come with type flags (`with_type_flags`) or with a `types` array. Flags stay booleans until a file's types are
    listed, so that uploads are folded by hash aggregates over fixed-width values; sets of arrays are sorted, texts and all.
    """
    flags = [c for c in mats.columns if c.startswith("is_")]
    if flags:
        return _match_flagged(files, mats, flags)
    description = F.concat_ws(" ", *[blank(F.col(c)) for c in ("file_name", "type_name", "file_desc")])
    extra = _set(
        F.when(has_any(description, fixed.TRANSPORT_WORDS), F.lit("transport_license")),
        F.when(has(description, fixed.SENSITIVE_NAME), F.lit("sensitive")))
    kinds = F.array_union(F.array_union(
        F.coalesce("types", _none()), iso_candidates(F.col("file_name"), F.col("type_name"))), extra)
    # one row per (owner, name): copies of an upload are folded before the join
    by_name = (mats.filter("coalesce(file_name, '') <> ''")
               .groupBy("todo_id", F.col("file_name").alias("__name"))
               .agg(F.array_distinct(F.flatten(F.collect_set(kinds))).alias("__types"),
                    F.max(has(description, fixed.EXPLICIT_INSPECTION)).alias("__explicit"),
                    F.max(F.col("type_name").isin(fixed.CANONICAL_LICENSE_SLOTS)).alias("__canonical")))
    owners = by_name.groupBy("todo_id").agg(F.max("__canonical").alias("__has_canonical"))
    names = F.explode(F.array_distinct(F.array(F.col("file"), drop_number_prefix(F.col("file")))))
    hits = (files.select("todo_id", "file").distinct()
            .select("todo_id", "file", names.alias("__name"))
            .join(by_name, ["todo_id", "__name"])
            .groupBy("todo_id", "file")
            .agg(F.array_distinct(F.flatten(F.collect_set("__types"))).alias("__types"),
                 F.max("__explicit").alias("__explicit"), F.max("__canonical").alias("__canonical")))
    joined = (files.join(hits, ["todo_id", "file"], "left").join(owners, "todo_id", "left"))
    types = F.coalesce("__types", _none())
    old_licence = F.coalesce("__has_canonical", F.lit(False)) & ~F.coalesce("__canonical", F.lit(False))
    types = F.when(old_licence, F.array_remove(types, "business_license")).otherwise(types)
    explicit = F.coalesce("__explicit", F.lit(False)) | has(F.col("file"), fixed.EXPLICIT_INSPECTION)
    iso = F.array(*[F.lit(kind) for kind in fixed.ISO_TYPES])
    types = F.when(F.arrays_overlap(types, iso) & ~explicit,
                   F.array_remove(types, "inspection_cert")).otherwise(types)
    return joined.select(*[F.col(c) for c in files.columns], F.array_sort(types).alias("types"))


def is_sensitive(text: Column) -> Column:
    """`SENSITIVE_NAME` occurs in the text."""
    return has_any(text, fixed.SENSITIVE_WORDS) | has(text, fixed.SENSITIVE_CASED)


def is_explicit(text: Column) -> Column:
    """`EXPLICIT_INSPECTION` occurs in the text."""
    return has_any(text, fixed.EXPLICIT_WORDS) | has(text, fixed.EXPLICIT_CASED)


#: Types whose bits are folded by one aggregate.
FOLDED = 5


def _match_flagged(files: DataFrame, mats: DataFrame, flags: list[str]) -> DataFrame:
    """`match_files` for uploads with one boolean column per type."""
    # without an owner nothing is found; said here, it leaves nothing for the joins to add, and all three read one shuffle of the uploads
    texts = mats.filter("file_name <> '' and todo_id is not null").select(
        "todo_id", F.col("file_name").alias("__name"), "type_name", *flags, fold_width(F.col("file_name")).alias("__folded"),
        fold_squeeze(F.col("type_name")).alias("__slot"),
        F.concat_ws(" ", *[blank(F.col(c)) for c in ("file_name", "type_name", "file_desc")]).alias("__text"))
    folded, slot, text = F.col("__folded"), F.col("__slot"), F.col("__text")
    numbered = has_any(folded, fixed.ISO_CODES)
    found = {name[3:]: F.coalesce(F.col(name), F.lit(False)) for name in flags}
    for kind in fixed.ISO_TYPES:
        places = [form for words, k in fixed.ISO_SLOT_TYPES.items() if k == kind for form in _slot_forms(words)]
        other = slot.isin(places)
        if kind == "iso14001":
            other = other | F.when(folded.contains("环境管理"), drop_number_prefix(file_stem(folded)).isin(fixed.ISO14001_STEMS)).otherwise(False)
        found[kind] = found.get(kind, F.lit(False)) | folded.contains(kind[3:]) | (~numbered & other)
    found["transport_license"] = found.get("transport_license", F.lit(False)) | has_any(text, fixed.TRANSPORT_WORDS)
    found["sensitive"] = is_sensitive(text)
    found["__explicit"] = is_explicit(text)
    found["__canonical"] = F.coalesce(F.col("type_name").isin(fixed.CANONICAL_LICENSE_SLOTS), F.lit(False))
    # one bit per type in one number: a row that is shuffled, sorted or spilled holds that number and no column per type. A few types
    # at a time are set and folded by an aggregate of their own, which is a method of its own; all at once the JVM would not compile
    place = {kind: 1 << i for i, kind in enumerate(found)}
    marks = [F.when(hit, F.lit(place[kind])).otherwise(F.lit(0)) for kind, hit in found.items()]
    folds = [F.bit_or(reduce(Column.bitwiseOR, marks[i:i + FOLDED])).alias(f"__bits{i}") for i in range(0, len(marks), FOLDED)]
    by_name = texts.groupBy("todo_id", "__name").agg(*folds).select(
        "todo_id", "__name", reduce(Column.bitwiseOR, [F.col(f"__bits{i}") for i in range(0, len(marks), FOLDED)]).alias("__bits"))
    owners = by_name.groupBy("todo_id").agg(F.bool_or(F.col("__bits").bitwiseAND(place["__canonical"]) != 0).alias("__has_canonical"))

    def named(which: str) -> DataFrame:
        return by_name.select(F.col("todo_id").alias(f"__{which}_of"), F.col("__name").alias(f"__{which}"), F.col("__bits").alias(f"__{which}_bits"))

    # a file meets the uploads of its own name where it lies, then those of its name without the prefix; there is one row per owner and
    # name, so no file comes twice, and files need neither be told apart nor be gathered again
    joined = (files.join(named("own"), (F.col("todo_id") == F.col("__own_of")) & (F.col("file") == F.col("__own")), "left")
              .join(named("bare"), (F.col("todo_id") == F.col("__bare_of")) & (drop_number_prefix(F.col("file")) == F.col("__bare")), "left")
              .select(*files.columns, F.coalesce("__own_bits", F.lit(0)).bitwiseOR(F.coalesce("__bare_bits", F.lit(0))).alias("__bits"))
              .join(owners, "todo_id", "left"))
    seen = {kind: F.col("__bits").bitwiseAND(at) != 0 for kind, at in place.items()}
    explicit, canonical = seen.pop("__explicit") | is_explicit(F.col("file")), seen.pop("__canonical")
    if "business_license" in seen:
        seen["business_license"] = seen["business_license"] & ~(F.coalesce("__has_canonical", F.lit(False)) & ~canonical)
    if "inspection_cert" in seen:
        iso = reduce(Column.__or__, [seen[kind] for kind in fixed.ISO_TYPES])
        seen["inspection_cert"] = seen["inspection_cert"] & (~iso | explicit)
    # the element of an unnested array is a value of the row: a filter on the types does not list them once more for every use
    return joined.select(*[F.col(c) for c in files.columns], F.explode_outer(F.array(listed(dict(sorted(seen.items()))))).alias("types"))


def performance_flag() -> Column:
    """The name shows proof of past performance (or does so in its slot)."""
    name, slot = fold_squeeze(F.col("file_name")), fold_squeeze(F.col("type_name"))
    proof = has_any(name, fixed.PERFORMANCE_DIRECT) | (
        slot.contains(fixed.PERFORMANCE_SLOT) & has_any(name, fixed.PERFORMANCE_PLAUSIBLE))
    return proof & ~has_any(name, fixed.PERFORMANCE_VETO)


def transport_flag() -> Column:
    """C11: the upload is or claims to be a transport licence."""
    words = F.concat_ws(" ", *[blank(F.col(c)) for c in ("file_name", "type_name", "file_desc")])
    typed = F.col("is_transport_license")
    return (typed | has_any(words, fixed.TRANSPORT_WORDS)) & or_null(F.col("file_name")).isNotNull()


def typed_flags(mats: DataFrame) -> DataFrame:
    """Type flags of uploads that carry a `types` array instead."""
    types = F.coalesce("types", _none())
    return mats.select("*", *[F.array_contains(types, kind).alias(flag(kind)) for kind in TYPES],
                       F.lit(None).cast("string").alias("slot_code"), F.lit(None).cast("string").alias("name_code"))


def proof_files(mats: DataFrame) -> DataFrame:
    """C10 + C11: distinct names of performance and transport files of each request, in upload
    order, each as one text. Only flagged uploads are shuffled, and copies are folded first."""
    from ..functions.ordering import joined_text, unnested

    kinds = F.array_compact(F.array(
        F.when(performance_flag(), F.lit("performance")), F.when(transport_flag(), F.lit("transport"))))
    firsts = (unnested(mats, ["todo_id", "file_name", "position"], kinds, "kind")
              .groupBy("todo_id", "kind", "file_name").agg(F.min("position").alias("position")))
    texts = joined_text(
        firsts, ["todo_id", "kind"], F.struct("position", "file_name"), F.col("file_name"),
        F.floor(F.col("position") / 512), "、", "files")
    return texts.groupBy("todo_id").agg(
        F.max(F.when(F.col("kind") == "performance", F.col("files"))).alias("performance_files"),
        F.max(F.when(F.col("kind") == "transport", F.col("files"))).alias("transport_files"))


def id_name_sets(mats: DataFrame) -> DataFrame:
    """File names known as identity cards, and names known as something else."""
    typed = mats.filter((F.size(F.coalesce("types", _none())) > 0) & (blank(F.col("file_name")) != ""))
    is_card = F.array_contains("types", "legal_person_id")
    return typed.groupBy("file_name").agg(
        F.bool_or(is_card).alias("is_id_card"), F.bool_or(~is_card).alias("is_other"))
