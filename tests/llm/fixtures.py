"""Small tables that hold what the operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and river stone market house garden yellow seven under lamp paper window silver bridge morning train letter candle".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    """doc_id, text, lang, source."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    far = base.split()
    for i in range(0, 60, 6):
        far[i] = "other"
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, " ".join(far), "de", "b"), (5, prose(2, 40), "fr", None), (6, "", "en", "a"), (7, None, None, None),
        (8, "Two words", "en", "b"), (9, "two  WORDS", "en", "c"), (10, " \n\t", "de", "c"), (11, prose(3, 5000), "en", "a"), (12, prose(4, 5), "es", "c"), (2, base, "en", "a"),
    ]
    for k in range(40):  # a hot group of near copies
        w = prose(9, 100).split()
        w[k] = f"variant{k}"
        out.append((100 + k, " ".join(w), "en", "a"))
    return out


def documents(spark, data=None):
    """The table, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("class_id", "component_id", "key", "size", "n", "a", "b", "part", "shard", "taken")})
