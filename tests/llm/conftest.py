import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Rows with the columns of documents, and two extra ones whose names clash with internal names."""
    def build(rows):
        data = [(i, t, lang, src, None if t is None else len(t), "x", 7) for i, t, lang, src in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row string, fp int").repartition(3)
    return build
