import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(texts, sources=None, ids=None, langs=None):
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en",
                 sources[i] if sources else "s0", len(t) if t is not None else None)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)
    return make
