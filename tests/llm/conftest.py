"""Hard documents: nulls, empty and long texts, repeated rows, clashing extra columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size string, score string, fp string, base string, spans string, th string, n_words string, kept string, taken string, component_id string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30000))


def hard_rows():
    same = "The quick brown fox jumps over the lazy dog near the river bank today"
    return [
        (1, same, "en", "a", len(same)), (2, same, "en", None, len(same)), (2, same, "en", None, len(same)), (3, None, None, "b", None), (4, "", "en", "b", 0),
        (None, "no id here at all", "en", "b", 17), (5, LONG, "en", "a", len(LONG)), (6, " \t\n\x0b\x0c\r ", "en", "c", 7), (7, "one", "en", "c", 3), (9, "É é 中文 😀 word nbsp", "fr", "c", 18), (10, LONG + " tail", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(*r, *["own"] * 10) for r in hard_rows()], DOCS + CLASH)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def as_tables(tmp_path_factory):
    """Write frames as a folder of tables, for the registered queries."""
    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
