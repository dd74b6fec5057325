import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def make(spark):
    """A documents frame from (doc_id, text) rows, with clashing extra columns."""
    def f(rows, lang="en"):
        schema = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, id long, "
                  "h long, fp long, kept boolean, size long, first long, __lang string")
        full = [(i, t, (x[0] if x else lang), None, len(t) if t is not None else None, 7, 7, 7, 7, True, 7, 7, "x")
                for i, t, *x in rows]
        return spark.createDataFrame(full, schema)

    return f
