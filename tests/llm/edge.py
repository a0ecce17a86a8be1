"""Frames with every awkward case: null ids and texts, empty, blank and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

#: Names the operators use inside; a caller may have them too.
CLASHING = ["hash", "prefix", "part", "rows", "fp", "n", "rank", "start", "th", "key", "best", "run", "vslot", "word", "m", "i", "ids"]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "delta", "krone", "Übung", "café", "x1", "in,"]) + rng.choice(["", "", "s", "ing"])
                    for _ in range(n)).capitalize() + "."


def rows():
    rng = random.Random(3)
    long = "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(900))
    out = [(None, None), (None, "same text here"), (None, "same text here"), (1, ""), (2, " \t\n "), (3, "a b"), (3, "a b"),
           (4, long), (5, "A b"), (6, long), (7, None), (8, "a b"), (9, "###"), (-4, "a b"), (10, long[:4000]), (10, "other text of ten")]
    out += [(20 + k, "\n".join(sentence(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 6)))) for k in range(30)]
    return out


def frame(spark, key="doc_id", text="text", data=None):
    data = rows() if data is None else data
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text, T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in CLASHING if c not in (key, text)]])
    pad = ("clash",) * (len(schema) - 2)
    return spark.createDataFrame([(*r, *pad) for r in data], schema)


def empty(spark, key="doc_id", text="text"):
    return frame(spark, key, text, [])


def got(df, *cols):
    def order(r):
        return [(x is None, str(type(x)), x if not isinstance(x, (list, tuple)) else str(x)) if x is not None else (True, "", 0) for x in r]
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=order)
