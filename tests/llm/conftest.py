import random

import pytest

#: Names that operators use inside, to clash with.
CLASH = ["key", "node", "salt", "score", "kept", "host", "cell", "label", "ids", "order"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""
    def build(rows):
        full = [(*r, *(("en", "s")[len(r) - 2:]), len(r[1] or ""), *["x"] * len(CLASH)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASH)
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def awkward():
    """NULLs, blanks, repeated rows and keys, other scripts, and a very long text."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "no key here at all"), (None, None), (4, "same text twice"),
            (4, "same text twice"), (5, "one key"), (5, "two texts"), (6, long), (7, "Ünïcödé 漢字 \U0001f600 שלום Ⅷ²"),
            (8, "x" * 30_000), (9, "<|endoftext|> a<|endoftext|>"), (-7, "negative\x00key\x1f")]
