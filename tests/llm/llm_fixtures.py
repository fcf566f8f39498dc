"""Fixtures of the llm tests, imported by name: a second conftest would hide the first."""

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def docs(spark):
    """A small table from (doc_id, text) pairs, with further columns whose names operators
    use inside or return."""
    extra = ("row string, score string, key string, fp string, root string, spans string, _own string, _fp string, "
             "component_id string, n_words string, shard string, slot string, bucket string")

    def make(rows):
        data = [(k, t, "en", "src", None if t is None else len(t), *[str(i) for i in range(13)]) for i, (k, t) in enumerate(rows)]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts with everything that is special to some operator."""
    rng = random.Random(7)
    parts = ["the", "of", "and", "Ünï", "日本", "a.b@c.de", "1.2.3.4", "999.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111",
             "4111111111111112", "DE89370400440532013000", "\n", "\t", "  ", "#*$", "", "x@y", "+12", "١٢٣", "\x1c", " ", "😀"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [
        None, "", " ", "\n\n", "a", "😀", "x" * 200_000, "word " * 30_000, "@" * 5000, "1." * 5000, "+1(" * 3000]
