import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text) -> a documents table with the usual further columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return make


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "one two three"), (5, "one two three"), (6, "é" * 30 + "\t\v x"),
       (7, "word " * 6000), (None, "a null id")]
