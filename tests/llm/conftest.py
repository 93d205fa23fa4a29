import pytest

from isobar.llm.ship import ship

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
CLASHING = "size long, copies long, key string, row long, bits string, component string, word string, cell string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)"""
        table = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", -1, 1, 2, "k", 3, "b", "c", "w", "e") for r in rows]
        return spark.createDataFrame(table, f"{DOCUMENTS}, {CLASHING}")

    return make
