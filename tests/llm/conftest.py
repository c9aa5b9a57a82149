import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, fp string, key int, _removed int, bucket string, shard string, code string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns whose names operators might use."""
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [
        (1, "a b c d e f g\nsecond line here\nthird line there\nfourth"), (2, "a b c d e f g\nsecond line here\nthird line there\nfifth"),
        (2, "a b c d e f g\nsecond line here\nthird line there\nfifth"), (3, ""), (4, None), (None, "mail me: x.y@example.com now"),
        (None, None), (5, words), (6, words + " tail"), (7, "\n\n\n\n"), (8, "Ünïcödé 漢字 😀 text\twith\ttabs"), (9, "A B C D E F G"),
        (10, "x" * 50_000), (-3, "negative id"), (11, "one two"), (12, "<|endoftext|> and it's 12's 34"),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None, k, "fp", 1, 7, "b", "s", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
