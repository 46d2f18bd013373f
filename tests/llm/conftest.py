import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

# extra columns whose names clash with outputs, nulls everywhere, repeated rows, ties, long and odd texts
EXTRA = ["lang", "source", "n_chars", "n_words", "kept", "size", "key", "id", "label", "hits", "batch", "block", "n_tokens"]
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, PASSAGE), (6, PASSAGE), (6, PASSAGE), (7, PASSAGE + " more words at the end"),
    (8, "Intro line.\n" + PASSAGE.upper() + "\nother é ü ß text"), (None, PASSAGE), (None, None), (9, LONG), (10, LONG + " tail"), (11, "x" * 60_000), (12, "ab " * 4000),
    (13, "é" * 70 + "日本語テキスト" * 12), (14, "日本語テキスト" * 12), (15, "mail a@b.co, c@d@e.fr 1.2.3.4.5, 4111 1111 1111 1111 +1 (303) 555-0199."),
    (16, "same line\nsame line\nsame line\n" * 5), (17, "the the the the the the the the the the the the"), (18, "| ".join(PASSAGE.split())),
    (19, "a\x00b\x0bc\x1cd e f <|endoftext|> g"), (20, PASSAGE[:-1]), (-5, PASSAGE + "\n" + PASSAGE), (21, "1" * 9000 + "." + "0" * 5000 + "7.1.2"),
    (22, "DE89 3704 0044 0532 0130 00 my iban; ssn 123-45-6789; call (303) 555-0199; part 123-45-6780"),
]


@pytest.fixture(scope="session")
def odd(spark):
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(c, StringType()) for c in EXTRA if c not in ("n_chars",)],
                         StructField("n_chars", LongType())])
    rows = [(i, t, *[None if k % 3 == 0 else f"s{k % 4}" for _ in range(len(EXTRA) - 1)], None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
