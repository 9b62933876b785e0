import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int, bucket string, key string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) with columns whose names operators use themselves."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), "mine", -1, "b", "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "ken", "lu", "ée"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a very long one, ties, copies and near copies."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    return [
        (1, base), (2, " ".join(near)), (3, base), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "One  two"),
        (10, prose(2, 20_000)), (11, prose(3, 60) + "\n" + prose(4, 80)), (12, prose(5, 40) + " " + prose(4, 80)), (13, "日本語 テスト 😀 don't <|endoftext|>"), (14, "a" * 3000), (15, "aaa " * 200),
    ]
