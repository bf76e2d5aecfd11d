"""Small made-up tables: odd rows of every kind, and documents whose labels a word decides."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, simhash string, bucket int, part int, copies long, size string, h string, s string, p string, spans int, n_lines string, length int"

WORDS = "amber basin cedar delta ember fjord grove haven islet jetty knoll ledge marsh north orbit plain quarry ridge slope tundra".split()


def sentence(rng: random.Random, count: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(count))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 400) for _ in range(60))
    repeated = "This very line stands in many of the documents, word for word."
    rows = [(i, sentence(rng, 30) + "\n" + repeated + "\n" + sentence(rng, 5), "en", "web", None) for i in range(10, 17)]
    rows += [
        (1, None, "en", "web", None), (2, "", "en", "books", None), (3, " \t\n\n ", None, None, None), (4, "one", "en", None, None),
        (5, long, "en", "web", 3), (6, long, "en", "web", 3), (7, "Ünïcode wörds — 漢字 😀 stand here\nand here", "de", "books", None),
        (8, "same text twice", "en", "news", None), (8, "same text twice", "en", "news", None), (None, "no id but some text to read", "en", "web", None),
        (None, None, None, None, None), (9, "\x0bodd\x0cspaces\r\n" + repeated.upper() + "  ", "en", "news", None),
    ]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def with_clashes(docs):
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(EXTRA)
    return docs.select(*(F.col(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def labelled(count: int = 400, seed: int = 1) -> tuple[list[tuple], list[tuple]]:
    """Documents and labels: bad quality is shouted, toxic ones hold an insult."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = sentence(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        docs.append((i, text, "en", "web", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels
