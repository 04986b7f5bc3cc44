import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source) rows."""

    def build(rows):
        full = [(r[0], r[1], "en" if len(r) < 4 else r[3], "s" if len(r) < 3 else r[2], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


#: Nulls in any column, empty and blank texts, a long text, ties and repeated rows.
ODD = [
    (1, "a b c d e f g h i j " * 12), (2, None), (3, ""), (4, " \t\r\n \x0b\x0c "), (5, "a b c d e f g h i j " * 12), (5, "a b c d e f g h i j " * 12),
    (None, "a b c d e f g h i j " * 12), (None, None), (6, "ein Wort"), (7, "ein Wort", None, None), (8, "x" * 30_000 + " " + "lorem ipsum dolor " * 3000),
    (9, "éà ünï 漢字 𝒳 " * 40), (10, "line one is here and it is long enough to count\nline two\n\n" * 3, None),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = ["bucket", "part", "blob", "kind", "score", "row", "key", "id", "h", "removed", "n_lines", "mix_slot", "tree", "next_text", "train", "n_words", "kept", "text_", "_source"]
    return odd.withColumns({n: F.lit("own") for n in names})


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
