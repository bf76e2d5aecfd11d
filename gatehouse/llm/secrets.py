"""Secret scan in DataFrame functions only: base patterns, and a battery of randomness tests over other long tokens.

Base spans are the leftmost non-overlapping matches of three patterns (see BASE). The text between the matches gives their places, in code
points. Other tokens of at least LEAST characters of an encoding alphabet are tested. The encoding inferred from
its characters (hexadecimal, base 32, base 64) gives the alphabet of k symbols, and three tests ask whether the token could be random there:
  * chi-squared uniformity of the symbols, standardised by its exact mean and variance under randomness;
  * runs of symbols of the alphabet's lower and upper half (Wald-Wolfowitz);
  * serial correlation of neighbouring symbols' positions.
A token that fails one is not random. For the others, the chance that ordinary text of that length would look so is the combination
(Fisher) of a Poisson tail of coinciding symbols and a normal tail of changes between kinds of characters. Within
four classes of length, false discoveries among the tokens of all documents are controlled (Benjamini-Hochberg over a histogram of
log chances), so short tokens need stronger evidence where they are many. Tokens found are spans of kind `random`; base spans stay, and a
token that touches a base span is no span of its own.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows have equal results (their tokens count
twice in the control); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

# The patterns of the base spans and the least length of what they hold.
BASE = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
]
KINDS = ["assign", "access", "hex", "random"]

LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SYMBOLS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Chance that two letters of ordinary text agree, and that neighbours are of different kinds (case, digit, sign).
TEXT_COINCIDENCE = 0.066
TEXT_CHANGES = 0.15
#: A test rejects randomness beyond so many standard deviations.
STRANGE = 3.3
FALSE_SHARE = 0.01
BIN = 0.05
CLASSES = [32, 48, 80]


def _matches(text: Column, pattern: str) -> Column:
    """Structs (s, e) of the non-overlapping matches, leftmost first: code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(whole, F.length)
    none = F.array().cast("array<struct<s:int,e:int>>")

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["between"]
        return F.struct((begin + pair["own"]).alias("at"), F.concat(state["found"], F.array(F.struct(begin.alias("s"), (begin + pair["own"]).alias("e")))).alias("found"))

    pairs = F.zip_with(between, sizes, lambda b, o: F.struct(b.alias("between"), o.alias("own")))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate(F.filter(pairs, lambda p: p["own"].isNotNull()), start, add, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _held(text: Column, pattern: str, least: int) -> Column:
    """Matches whose last group has at least `least` characters."""
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pairs = F.arrays_zip(_matches(text, pattern).alias("m"), held.alias("h"))
    return F.when(text.rlike(pattern), F.transform(F.filter(pairs, lambda p: F.length(p["h"]) >= least), lambda p: p["m"])).otherwise(
        F.array().cast("array<struct<s:int,e:int>>"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic curve that is within 0.0002 of it."""
    return 1 / (1 + F.exp(F.least(F.lit(60.0), 1.5976 * z + 0.070566 * z * z * z)))


def _evidence(token: Column) -> Column:
    """-log10 of the chance that ordinary text of this length looks as random as the token; null if the token fails a test."""
    hexes, base32 = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), token.rlike("^[A-Z2-7]+=*$")
    alphabet = F.when(hexes, SYMBOLS["hex"]).when(base32, SYMBOLS["base32"]).otherwise(SYMBOLS["base64"])
    plain = F.when(hexes, F.lower(token)).otherwise(F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/"))
    symbols = F.split(plain, "")
    k = F.length(alphabet).cast("double")

    def with_places(args: Column) -> Column:
        places, k, chars = args["places"], args["k"], args["chars"]
        n = F.size(places).cast("double")
        total = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
        mean = total / n
        squares = F.aggregate(places, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        same = F.aggregate(F.array_distinct(places), F.lit(0.0), lambda a, p: a + F.pow(F.size(F.filter(places, lambda x: x == p)).cast("double"), 2))
        uniform = (same * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        ahead = F.slice(places, 2, F.size(places) - 1)
        behind = F.slice(places, 1, F.size(places) - 1)
        pairs = F.zip_with(behind, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)) / F.greatest(squares, F.lit(1e-9)) * F.sqrt(n)
        high = F.size(F.filter(places, lambda x: x >= k / 2)).cast("double")
        low = n - high
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))).cast("double")
        expected = 1 + 2 * high * low / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        strange = (F.abs(uniform) > STRANGE) | (F.abs(serial) > STRANGE) | (F.abs((runs - expected) / spread) > STRANGE)
        # coinciding pairs: Poisson, through the normal curve of the square root
        coincide, usual = (same - n) / 2, n * (n - 1) / 2 * TEXT_COINCIDENCE
        few = _normal_tail(2 * (F.sqrt(usual) - F.sqrt(coincide + 0.5)))
        kinds = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: a != b)
        changes = F.size(F.filter(kinds, lambda x: x)).cast("double")
        many = _normal_tail((changes - 0.5 - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES)))
        fisher = -2 * (F.log(F.greatest(few, F.lit(1e-26))) + F.log(F.greatest(many, F.lit(1e-26))))
        chance = F.exp(-fisher / 2) * (1 + fisher / 2)
        return F.when(~strange, -F.log10(F.greatest(chance, F.lit(1e-50))))

    places = F.transform(F.filter(symbols, lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    kind = F.split(F.translate(plain, UPPER + UPPER.lower() + "0123456789", "u" * 26 + "l" * 26 + "d" * 10), "")
    args = F.struct(places.alias("places"), k.alias("k"), F.filter(kind, lambda c: c != "").alias("chars"))
    # one value held in a one-element array, so that each part is computed once
    return F.element_at(F.transform(F.array(args), with_places), 1)


def _length_class(size: Column) -> Column:
    return sum(((size >= edge).cast("int") for edge in CLASSES), F.lit(0))


def tested_tokens(text: Column) -> Column:
    """Structs (s, e, length_class, evidence) of the tokens that pass the battery."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pairs = F.arrays_zip(_matches(text, TOKEN).alias("m"), tokens.alias("t"))
    tested = F.transform(pairs, lambda p: F.struct(
        p["m"]["s"].alias("s"), p["m"]["e"].alias("e"), _length_class(F.length(p["t"])).alias("length_class"), _evidence(p["t"]).alias("evidence")))
    none = F.array().cast("array<struct<s:int,e:int,length_class:int,evidence:double>>")
    return F.when(text.rlike(TOKEN), tested).otherwise(none)


def thresholds(found: DataFrame, share: float = FALSE_SHARE) -> dict[int, float]:
    """The least evidence per class of length at which at most `share` of the discoveries are false; none: no key.

    The driver gets at most one row per class of length and bin of evidence.
    """
    tokens = found.select(F.explode("tokens").alias("t")).select("t.length_class", "t.evidence")
    bins = F.floor(F.coalesce("evidence", F.lit(0.0)) / BIN).cast("int")
    rows = tokens.groupBy("length_class", bins.alias("bin")).count().collect()
    out: dict[int, float] = {}
    for length_class in {r.length_class for r in rows}:
        own = sorted(((r.bin, r["count"]) for r in rows if r.length_class == length_class), reverse=True)
        total, above = sum(c for _, c in own), 0
        for place, count in own:
            above += count
            if 10 ** (-place * BIN) * total / above <= share:
                out[length_class] = place * BIN
    return out


def scan(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, the base spans by kind, and `spans`: structs (s, kind number, e) of all spans in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = [_held(text, BASE[0][1], BASE[0][2]), _matches(text, BASE[1][1]), _matches(text, BASE[2][1])]
    found = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k[0]) for c, k in zip(base, BASE, strict=True)),
                                   tested_tokens(text).alias("tokens")))
    least = thresholds(found, share)

    def marked(name: str, kind: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))

    base_spans = F.array_sort(F.concat(*(marked(k[0], i) for i, k in enumerate(BASE))))

    def passed(t: Column) -> Column:
        out = F.lit(False)
        for length_class, value in sorted(least.items()):
            out = out | ((t["length_class"] == length_class) & (t["evidence"] >= value))
        touches = F.exists("base_spans", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
        return F.coalesce(out, F.lit(False)) & ~touches

    with_base = found.withColumn("base_spans", base_spans)
    random = F.transform(F.filter("tokens", passed), lambda t: F.struct(t["s"].alias("s"), F.lit(3).alias("k"), t["e"].alias("e")))
    return with_base.withColumn("spans", F.array_sort(F.concat("base_spans", random)))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", names[m["k"]], m["s"].cast("string"), m["e"].cast("string"))), ",")


def secret_digests(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    found = scan(docs, share)
    counts = [F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_written("base_spans").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"))
