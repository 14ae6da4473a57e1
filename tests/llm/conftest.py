import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


from ringweave.llm.common import importable  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id string, size string, fp string, score string, row string"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names."""
    text = "the cat sat on the mat and the dog lay on the rug. "
    rows = [
        (1, text, "en", "a"),
        (1, text, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, text * 20_000, "en", "b"),
        (None, text, None, "b"),
        (None, None, None, None),
        (6, "Ünïcödé <|endoftext|> 日本語 \x1c x  y   z \n \n", "fr", None),
        (7, "der hund und die katze liegen auf dem bett", "de", "c"),
        (8, "́" + "a" * 3000 + " 123,456!!", "de", "c"),
    ]
    clash = ("x",) * 6
    return spark.createDataFrame([(*r, len(r[1] or ""), *clash) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [2.0, 0.1]), (7, [None, 1.0]), (8, []),
        (None, [1.0, 0.0]), (9, [1.0]), (10, [1e300, 1e299]), (100, [1.0, 0.0]), (0, [0.0, 1.0]), (12, [-0.0, 1.0]), (13, [inf, 1.0]), (14, [1e-200, 0.0]),
    ]
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, rank string, node string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


