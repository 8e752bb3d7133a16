"""Frames with the awkward rows that every operator must take."""

from collections import Counter

LONG = "lorem Ipsum dolor, sit. " * 40_000  # about a megabyte


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    from pyspark.sql import functions as F

    # Columns whose names an operator might use for itself.
    names = ("lang", "source", "n_chars", "score", "kept", "component", "component_id", "fp", "text_key", "__key", "id", "ids", "group", "size", "shard", "slot", "part", "block", "item_ids", "quality", "n", "key", "u", "v", "__stat_log_words", "_", "a.b", "row", "start", "value", "within", "licenses")
    return df.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in names])


def kept_whole(before, after):
    """The number of rows after, each of which is a row of before in all its columns."""
    assert after.columns == before.columns
    left = Counter(map(tuple, before.collect()))
    rows = Counter(map(tuple, after.collect()))
    assert not rows - left
    return sum(rows.values())


AWKWARD = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, LONG), (4, "same text here again"), (5, "same text here again"), (5, "same text here again"), (None, "no id"), (None, None), (6, "ünï €😀 x\x1cy\x85z\u3000w"), (7, "a")]
EMPTY = []
