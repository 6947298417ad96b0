from __future__ import annotations

import pytest

from surveyspan.llm.tools import share_package

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean, "
    "row string, digest string, fp long, _row string, component_id long, rid long, n long, copies int"
)


def document(key, text, lang="en", source="s"):
    """A row whose further columns bear names that operators use inside."""
    return (key, text, lang, source, 1, 2, 3, True, "r", "d", 4, "x", 5, 6, 7, 8)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, clashing names."""
    share_package(spark)
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        document(1, None),
        document(2, ""),
        document(3, " \n\t "),
        document(4, "the same text here now", source=None),
        document(5, "the same text here now", lang=None),
        document(5, "the same text here now", lang=None),
        document(6, long_text, source="t"),
        document(7, "The SAME text here now"),
        document(8, "été à la plage\x1c漢字 <|endoftext|>  two", lang="fr", source="é"),
        document(None, "no id at all", source="u"),
        document(9, "1234 5678", lang="de"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
