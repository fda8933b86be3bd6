import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def documents(spark):
    """Documents from (id, text) or longer tuples, missing fields null."""
    def make(rows, **more):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    return make


@pytest.fixture
def hard(documents):
    """Nulls in every column, empty, blank, symbol-only and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977} the tion" for i in range(20_000))
    return documents([
        (1, None, None, None), (None, "the and of the lazy thing", "en", "a"), (None, None, None, None),
        (2, "", "en", "a"), (3, "  \n\t ", None, "b"), (4, "!!! 123 ???", "en", "b"), (5, long, "en", "a"),
        (6, "x" * 100_000, "en", None), (7, "the same text as the other one is here twice", "en", "a"),
        (7, "the same text as the other one is here twice", "en", "a"),
        (8, "the same text as the other one is here twice", "en", "c"), (9, "\x00 é ü 漢字 🙂 \n\n last", "fr", "c"),
    ])
