"""Odd documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

LONG = "".join(f"word{i % 977} runs{i % 13}\n" for i in range(6000))
BODY = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions beside the old river bank"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, BODY, "en", "a", 1),
    (4, BODY, None, "a", 1),
    (4, BODY, None, "a", 1),
    (5, BODY.replace("lazy", "idle"), "en", "b", 1),
    (6, LONG, "en", "b", 1),
    (7, "   \n\t ", "de", "b", None),
    (8, "Ünïcödé <|endoftext|> naïve space 你好 \U0001f600 é", "fr", "c", 3),
    (9, "x" * 70_000, "en", "c", 3),
]
#: A row without a key.
KEYLESS = (None, BODY, "en", "a", 1)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators could use inside.
CLASHING = {"fp": "1", "n": "2", "_block": "3", "entry": "4", "rank": "5", "component_id": "6", "start": "7", "length": "8", "key": "9", "score": "10", "_pii": "11", "_hits": "12", "same": "13", "seed": "14", "batch": "15", "doc": "16"}


def odd(spark, clashing=False, keyless=False):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([*ODD, KEYLESS] if keyless else ODD, SCHEMA)
    return made.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clashing else made


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
