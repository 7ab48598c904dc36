import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "the first line of it\nthe second line of it\nthe third line of it"
WORDS = " ".join(f"word{k}" for k in range(60))
#: Nulls in each column, empty and blank texts, repeated rows, copies, one very long text.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", None),
    (4, f"{LINES}\nown line of four", "en", "b", 1),
    (5, f"{LINES}\nown line of five", "en", "b", 1),
    (5, f"{LINES}\nown line of five", "en", "b", 1),
    (6, LINES, "en", None, 1),
    (7, "x\nx\nx\nx\nx\nx", "en", None, 1),
    (8, WORDS, "en", "ü", 1),
    (9, WORDS, "en", "ü", 1),
    (10, WORDS.replace("word30", "other"), "en", "ü", 1),
    (None, WORDS, "en", "ü", 1),
    (None, None, None, None, None),
    (11, "y" * 400_000, "en", "b", 1),
    (12, "ab cd ef gh " * 30_000, "en", "b", 1),
    (13, "Zwei  Leerzeichen　und \U0001f600 \x00 Ende ", "de", "b", 1),
]
CLASHING = ["id", "tid", "h", "doc", "size", "block", "t", "shard", "ids", "lines", "gone", "words", "kept", "n_words", "media", "n_bytes", "vslot", "slot", "n_removed", "component_id", "n_shingles", "copies", "draws", "base", "found", "near_rid", "rid", "_words", "_lines", "near_row", "s", "clips", "payload", "histogram", "clip", "a.b", "upto_h", "c", "at"]


@pytest.fixture
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rows():
    return ODD
