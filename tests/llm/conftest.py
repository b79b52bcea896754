import pytest

#: Columns whose names the operators use inside; and nulls, blanks, repeated rows and a long text.
EXTRA = "id string, t string, h string, key string, n string, part string, c string, pos string, score string, copies string, lang string, source string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents of (doc_id, text) or (doc_id, text, source), with columns of clashing names."""
        full = [(r[0], r[1], *["x"] * 10, "en", r[2] if len(r) > 2 else "s") for r in rows]
        return spark.createDataFrame(full, f"doc_id bigint, text string, {EXTRA}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    return [(1, "One line of text that is long enough\nshort\nanother line that is long enough"), (2, None), (3, ""), (4, " \t\n "), (5, "One line of text that is long enough"), (6, "x " * 50_000), (7, "ÉTÉ naïve ﬁ   日本語"), (5, "One line of text that is long enough"), (8, "one LINE of text that is long enough  \nshort")]
