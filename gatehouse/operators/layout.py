"""Page layout: reading order, labelled values beside each other, the best of several readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import canonical_term, day8, is_term, plain_term
from ..functions.ordering import joined_text, unnested
from ..functions.text import find_all, has_any, squeeze

PAGE = ["doc_id", "page_id"]
BAND = 64


def with_bounds(lines: DataFrame) -> DataFrame:
    """Bounding box (x1, y1, x2, y2) of each polygon."""
    def edge(axis: int, pick) -> Column:
        return pick(F.transform("position", lambda p: p[axis]))

    return lines.select(
        "*", edge(0, F.array_min).alias("x1"), edge(1, F.array_min).alias("y1"),
        edge(0, F.array_max).alias("x2"), edge(1, F.array_max).alias("y2"))


#: Boxes of a page up to which it is folded in one piece.
WHOLE = 1 << 15


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("y1", "x1", "line_no", "y2", "text"))).alias("boxes")


def _whole_and_cut(boxes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of pages of at most `most` boxes gathered per page, those of larger pages per block of the page (null: there is none).

    One number per page is shuffled to find the larger ones, of which there are at most one for `most` boxes; the boxes of all others
    are shuffled once and meet nothing.
    """
    placed = boxes.filter(F.col("doc_id").isNotNull() & F.col("page_id").isNotNull() & F.col("y1").isNotNull())
    page = F.xxhash64(*PAGE)
    counts = placed.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("n"))
    large = [row.page for row in counts.where(F.col("n") > most).select("page").collect()]
    small = placed.where(~page.isin(large)) if large else placed
    whole = _with_begins(small.groupBy(*PAGE).agg(_in_order()).withColumn("block", F.lit(0).cast("long")))
    return whole, _with_begins(_in_blocks(placed.where(page.isin(large)))) if large else None


def _in_blocks(boxes: DataFrame) -> DataFrame:
    """Where no later box can reach back to an earlier row, the page is cut: only boxes of one such block are folded together.

    The cuts are found on bands of the page, which are few.
    """
    height = F.col("y2") - F.col("y1")
    reach = F.col("y1") - F.greatest(F.lit(3.0), height * 0.45)
    banded = boxes.select("*", F.floor(F.col("y1") / BAND).alias("__band"))
    bands = banded.groupBy(*PAGE, "__band").agg(F.min(reach).alias("lowest"), F.max("y1").alias("highest"))
    down = Window.partitionBy(*PAGE).orderBy("__band")
    up = Window.partitionBy(*PAGE).orderBy(F.desc("__band"))
    ahead = F.min("lowest").over(up.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.max("highest").over(down.rowsBetween(Window.unboundedPreceding, -1))
    cut = bands.select(*PAGE, "__band", (ahead > behind).alias("__cut"))
    block = F.sum(F.when(F.col("__cut"), 1).otherwise(0)).over(
        down.rowsBetween(Window.unboundedPreceding, 0)).alias("block")
    blocks = cut.select(*PAGE, "__band", block)
    return banded.join(blocks, [*PAGE, "__band"]).groupBy(*PAGE, "block").agg(_in_order()).select(*PAGE, "boxes", "block")


def _with_begins(grouped: DataFrame) -> DataFrame:
    # only the places where a row begins are gathered, so the work grows with the boxes and not with their square
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("size"),
                     F.lit(1).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, b: Column) -> Column:
        size = b["y2"] - b["y1"]
        same = F.coalesce(F.abs(b["y1"] - acc["top"]) <= F.greatest(
            F.lit(3.0), F.least(size, acc["size"]) * 0.45), F.lit(False))
        return F.struct(
            F.when(same, acc["top"]).otherwise(b["y1"]).alias("top"),
            F.when(same, acc["size"]).otherwise(size).alias("size"), (acc["at"] + 1).alias("at"),
            F.when(same, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(acc["at"]))).alias("begins"))

    return grouped.withColumn("begins", F.aggregate("boxes", start, step, lambda acc: acc["begins"]))


def _row(begin: Column, index: Column) -> Column:
    """Boxes of the row that begins there, in the order of the page."""
    end = F.coalesce(F.try_element_at("begins", index + 2), F.size("boxes") + 1)
    return F.slice("boxes", begin, end - begin)


def reading_order(boxes: DataFrame, most: int = WHOLE) -> DataFrame:
    """Boxes (doc_id, page_id, line_no, text, x1, y1, y2) with `block`, `row` and `place`.

    A box joins the row of the first box of that row if their tops are close. A page of more than `most` boxes is split into blocks
    where no row can reach across.
    """
    def row_of(begin: Column, index: Column) -> Column:
        return F.transform(_row(begin, index), lambda b: F.struct(
            (index + 1).alias("row"), b["x1"].cast("double").alias("x1"), b["line_no"].cast("int").alias("line_no"), b["text"].alias("text")))

    whole, cut = _whole_and_cut(boxes, most)
    grouped = whole if cut is None else whole.unionByName(cut)
    placed = F.array_sort(F.flatten(F.transform("begins", row_of)))
    numbered = F.transform(placed, lambda b, i: F.struct(i.alias("place"), b.alias("b")))
    return unnested(grouped, [*PAGE, "block"], numbered, "p").select(
        *PAGE, "block", "p.b.row", "p.place", "p.b.line_no", "p.b.text")


def read_pages(boxes: DataFrame, most: int = WHOLE) -> DataFrame:
    """Text of each page from its boxes: what `page_reading` gives of their `reading_order`, without dealing the boxes again.

    The text of a row is made where its boxes were gathered; only texts of the blocks of larger pages meet once more.
    """
    def text_of(begin: Column, index: Column) -> Column:
        row = F.array_sort(F.transform(_row(begin, index), lambda b: F.struct(
            b["x1"].cast("double").alias("x1"), b["line_no"].cast("int").alias("line_no"), b["text"].alias("text"))))
        return F.concat_ws(" ", F.transform(row, lambda b: b["text"]))

    whole, cut = _whole_and_cut(boxes, most)
    text = F.concat_ws("\n", F.transform("begins", text_of)).alias("page_text")
    texts = whole.select(*PAGE, text)
    if cut is None:
        return texts
    return texts.unionByName(joined_text(cut.select(*PAGE, "block", text), PAGE, F.struct("block"), F.col("page_text"), F.col("block"), "\n", "page_text"))


def row_texts(ordered: DataFrame) -> DataFrame:
    """Text of each row, its boxes left to right."""
    return joined_text(ordered, [*PAGE, "block", "row"], F.struct("place", "text"), F.col("text"),
                       F.floor(F.col("place") / 512), " ", "row_text")


def page_reading(ordered: DataFrame) -> DataFrame:
    """Text of each page, its rows top to bottom."""
    return joined_text(row_texts(ordered), PAGE, F.struct("block", "row", "row_text"), F.col("row_text"),
                       F.col("block"), "\n", "page_text")


def _plain(text: Column) -> Column:
    return F.regexp_replace(squeeze(text), "[:：]", "")


def is_person(value: Column) -> Column:
    return value.rlike(r"^[㐀-鿿·]{2,12}$")


def _labelled(boxes: DataFrame, labels: list[str], valid, shape) -> DataFrame:
    """First label of each page with a value: behind it in its box, or in boxes to its right.

    Boxes are matched to labels by bands of the page height, so only near rows
    are paired; the boxes of one row are joined left to right until they are valid.
    """
    packed = boxes.select(*PAGE, "line_no", _plain(F.col("text")).alias("raw"), "x1", "x2", "y1", "y2",
                          ((F.col("y1") + F.col("y2")) / 2).alias("mid"))
    hit = F.coalesce(*[F.when(F.col("raw").contains(w), F.lit(w)) for w in labels])
    found = packed.select("*", hit.alias("label")).filter("label is not null")
    suffix = F.expr("substring(raw, instr(raw, label) + length(label))")
    found = found.select("*", suffix.alias("own")).select(
        *PAGE, "line_no", "x1", "x2", "mid", F.when(valid(F.col("own")), shape(F.col("own"))).alias("own"),
        F.greatest(F.lit(42.0), (F.col("y2") - F.col("y1")) * 0.9).alias("tol"),
        (F.col("x2") - F.greatest(F.lit(20.0), (F.col("x2") - F.col("x1")) * 0.25)).alias("from_x"))
    inside = found.filter("own is not null").select(*PAGE, "line_no", F.col("own").alias("value"))
    bands = F.sequence(F.floor((F.col("mid") - F.col("tol")) / BAND), F.floor((F.col("mid") + F.col("tol")) / BAND))
    asked = found.filter("own is null").select(
        *PAGE, F.col("line_no").alias("at"), F.col("mid").alias("at_mid"), "tol", "from_x", F.explode(bands).alias("band"))
    others = packed.filter("raw <> ''").select(
        *PAGE, "line_no", "raw", "x1", "mid", F.floor(F.col("mid") / BAND).alias("band"))
    beside = (asked.join(others, [*PAGE, "band"])
              .filter((F.col("line_no") != F.col("at")) & (F.col("x1") >= F.col("from_x"))
                      & (F.abs(F.col("mid") - F.col("at_mid")) <= F.col("tol")))
              .groupBy(*PAGE, "at").agg(F.array_sort(F.collect_list(F.struct("x1", "line_no", "raw"))).alias("row")))
    texts = F.transform("row", lambda b: b["raw"])
    # the text grows box by box and stops as soon as it is a value
    walked = F.aggregate(texts, F.struct(F.lit("").alias("text"), F.lit(False).alias("done")), lambda acc, t: F.struct(
        F.when(acc["done"], acc["text"]).otherwise(F.concat(acc["text"], t)).alias("text"),
        (acc["done"] | valid(F.concat(acc["text"], t))).alias("done")))
    outside = beside.select(*PAGE, F.col("at").alias("line_no"), walked.alias("w")).filter("w.done").select(
        *PAGE, "line_no", shape(F.col("w.text")).alias("value"))
    return inside.unionByName(outside).groupBy(*PAGE).agg(F.min_by("value", "line_no").alias("value"))


def fields_by_layout(boxes: DataFrame) -> DataFrame:
    """Side, name and validity of each identity-card page (boxes with bounds)."""
    filled = boxes.filter("doc_id is not null and page_id is not null")
    whole = joined_text(filled, PAGE, F.struct("line_no", "text"), _plain(F.col("text")),
                        F.floor(F.col("line_no") / 512), "", "all_text")
    size = filled.groupBy(*PAGE).agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    text = F.col("all_text")
    front = sum((F.when(text.contains(w), 1).otherwise(0) for w in fixed.FRONT_WORDS), F.lit(0))
    back = sum((F.when(text.contains(w), 1).otherwise(0) for w in fixed.BACK_WORDS), F.lit(0))
    anchored = text.rlike(r"(?<!\d)\d{17}[\dXx](?!\d)") & text.rlike(r"(?:19|20)\d{2}年\d{1,2}月\d{1,2}[日白]?")
    pages = whole.join(size, PAGE).select(
        *PAGE, "width", "height", front.alias("front"), back.alias("back"), anchored.alias("anchored"))

    def same(value: Column) -> Column:
        return value

    exact = _labelled(filled, fixed.NAME_LABELS, is_person, same).withColumnRenamed("value", "exact")
    fuzzy = _labelled(filled, fixed.DAMAGED_NAME_LABELS, is_person, same).withColumnRenamed("value", "fuzzy")
    term = _labelled(filled, fixed.TERM_LABELS, is_term, canonical_term).withColumnRenamed("value", "term")
    bare = F.regexp_replace(_plain(F.col("text")), r"^[^㐀-鿿·]+", "")
    placed = (filled.join(pages.filter("anchored").select(*PAGE, "width", "height"), PAGE)
              .filter(((F.col("x1") + F.col("x2")) / 2 <= F.col("width") * 0.55)
                      & ((F.col("y1") + F.col("y2")) / 2 <= F.col("height") * 0.45))
              .select(*PAGE, "y1", "x1", bare.alias("bare")).filter(F.col("bare").rlike(r"^[㐀-鿿·]{2,6}$"))
              .groupBy(*PAGE).agg(F.min_by("bare", F.struct("y1", "x1")).alias("placed")))
    raw = plain_term(F.col("text"))
    label = F.regexp_extract(raw, r"^(\D*)", 1)
    rest = F.regexp_replace(raw, r"^\D*", "")
    digits = F.regexp_replace(rest, r"\D", "")
    damaged = (filled.select(*PAGE, "line_no", label.alias("l"), rest.alias("v"), digits.alias("d"))
               .filter(F.length("l").between(2, 8) & F.col("l").rlike("[期限]$") & (F.length("d") == 16)
                       & day8(F.substring("d", 9, 8)).isNotNull())
               .groupBy(*PAGE).agg(F.min_by(canonical_term(F.col("v")), "line_no").alias("damaged")))
    joined = pages
    for part in (exact, fuzzy, term, placed, damaged):
        joined = joined.join(part, PAGE, "left")
    name = F.when(F.col("front") > 0, F.coalesce(
        "exact", F.when(F.col("front") >= 2, F.col("fuzzy")), "placed"))
    until = F.when(F.col("back") > 0, F.coalesce("term", "damaged"))
    side = (F.when(name.isNotNull(), "front").when(until.isNotNull(), "back")
            .when(F.col("front") > F.col("back"), "front").when(F.col("back") > F.col("front"), "back")
            .otherwise("unknown"))
    return joined.select(*PAGE, side.alias("side"), name.alias("name"), until.alias("valid_until"))


def best_reading(readings: DataFrame) -> DataFrame:
    """Best of several readings of a page (boxes with bounds, `attempt` and `page_height`).

    Order: licence words found, layout, share of horizontal text, mean
    confidence; the earlier attempt among equals. A reading through the red
    channel (`is_seal`) replaces the winner only with more complete dates.
    """
    keys = [*PAGE, "attempt", "is_seal"]
    text = squeeze(F.col("text"))
    chars = F.greatest(F.lit(1), F.length(text))
    middle = (F.col("y1") + F.col("y2")) / 2 / F.col("page_height")
    wide = (F.col("x2") - F.col("x1")) >= (F.col("y2") - F.col("y1"))
    head = has_any(text, ["营业执照", "统一社会信用代码"])
    foot = text.contains("登记机关")
    layout = (F.when(head, F.when(middle < 0.55, 1).otherwise(-1)).otherwise(0)
              + F.when(foot, F.when(middle > 0.45, 1).otherwise(-1)).otherwise(0))
    scores = readings.groupBy(*keys).agg(
        F.sum(layout).alias("layout"),
        (F.sum(F.when(wide, chars).otherwise(0)) / F.sum(chars)).alias("horizontal"),
        (F.sum(chars * F.col("confidence")) / F.sum(chars)).alias("confidence"),
        F.sum(F.size(find_all(F.col("text"), fixed.COMPLETE_DATE))).alias("dates"))
    whole = joined_text(readings, keys, F.struct("line_no", "text"), squeeze(F.col("text")),
                        F.floor(F.col("line_no") / 512), "", "all_text")
    words = sum((F.when(F.col("all_text").contains(w), 1).otherwise(0) for w in fixed.LICENCE_PAGE_WORDS), F.lit(0))
    rated = scores.join(whole.select(*keys, words.alias("words"),
                                     F.col("all_text").rlike("有效(?:期|日期)").alias("dated")), keys)
    upright, seal = F.col("is_seal") == F.lit(False), F.col("is_seal")
    best = rated.groupBy(*PAGE).agg(
        F.max_by(F.struct("attempt", "dates", "dated"), F.when(upright, F.struct(
            "words", "layout", "horizontal", "confidence", -F.col("attempt")))).alias("b"),
        F.max_by(F.struct("attempt", "dates"), F.when(seal, F.struct("dates", -F.col("attempt")))).alias("s"))
    better = F.coalesce(F.col("b.dated") & (F.col("s.dates") > F.col("b.dates")), F.lit(False))
    return best.select(*PAGE, F.when(better, F.col("s.attempt")).otherwise(F.col("b.attempt")).alias("attempt"))
