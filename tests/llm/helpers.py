"""Small tables with awkward rows, shared by the tests of the corpus operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text[, source[, lang]])"""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a null id"),
    (6, "one"),
    (7, "two words"),
    (8, "naïve façade – ünïcödé   text \U0001f600 end"),
    (9, "word " * 5000),
    (10, "x" * 20000),
    (11, "A b\x00c d"),
]


def clashing(df):
    """The same rows with further columns named as operators may name theirs."""
    from pyspark.sql import functions as F

    extra = ["fp", "key", "u", "v", "n", "b", "size", "target", "copies", "rank", "score", "h", "_", "row", "kept", "label", "weight", "chosen", "lot", "k"]
    extra += ["__size", "__source", "__t", "__source_size", "__target", "__copies", "__copy", "__k", "__h", "__row", "__root", "__null", "__chosen", "__first"]
    return df.withColumns({c: F.lit("clash") for c in extra})
