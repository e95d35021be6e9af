"""Awkward documents, and plain answers to compare with."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                      T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCABULARY = ["alpha", "Beta", "gamma,", "delta", "épsilon", "ZETA", "eta.", "theta", "iota", "kappa", "çedille", "mu", "nu!", "xi", "omicron", "pi"]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) + (str(pick.randrange(50)) if pick.random() < 0.5 else "") for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, repeated rows, shared passages, odd white space and one long text."""
    shared = prose(1, 60)
    texts = ["", " \t\n ", None, "one", "one two", "a\x0bb\x0cc\r\nd", prose(2, 34), shared, shared, f"{prose(3, 20)}  {shared}\n{prose(4, 30)}", prose(5, 200), prose(5, 200),
             prose(5, 199) + " changed", " ".join(["again"] * 90), prose(6, 300) + " " + prose(6, 300), "  no break 　 wide", "x<|endoftext|>y <|endoftext|> don't it's 12,345 ...", "i" * 3000,
             prose(7, 9000), "日本語の文 です。 " * 40]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[10], (None, "no id here", None, None, None), (None, None, None, None, None)]


def frame(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape)


def with_clashes(docs, *names):
    """Further columns, some named like results."""
    from pyspark.sql import functions as F

    return docs.withColumns({**{n: F.lit("mine") for n in names}, "extra one": F.lit(1)})


def words(text):
    return WORD.findall(text or "")
