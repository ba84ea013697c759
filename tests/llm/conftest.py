import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def run(pairs, clash=()):
        rows = [(i, t, None, "s", None, *["x"] * len(clash)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in clash))

    return run
