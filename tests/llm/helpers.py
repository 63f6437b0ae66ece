"""Small tables for the operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text) or full tuples."""
    full = [r if len(r) > 2 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    import pyspark.sql.functions as F
    names = ("home", "_doc", "_row", "_id", "_added", "copy", "node", "salt", "places", "bucket", "k1", "key", "class_id")
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in names])


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
