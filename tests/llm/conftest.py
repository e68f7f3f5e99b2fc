import pytest

# Names that operators use inside, as columns of the input.
CLASHES = "keep_id label row_key row_key2 key key2 row rest kept node part bucket cell grp path host digest license class _gone _row_key _kept_text".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with columns whose names clash with those of the operators."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *CLASHES) for i, t in rows], DOCS)

    return make
