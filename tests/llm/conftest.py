from __future__ import annotations

import pytest

from alertlens.llm.common import prepare

LONG = "word " * 30_000 + "x" * 5_000
ODD_TEXTS = [None, "", "   \n\t ", "a", "Hello World", "same text again here now ok", "same text again here now ok",
             "Été straße 日本語 \U0001f600 ́x", "tab\x1cfs\x85nel\xa0nbsp", LONG]


@pytest.fixture(scope="session")
def sp(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(sp):
    """Null, empty, blank, tiny, repeated, multilingual and long texts, with extra columns
    that clash with result names."""
    clash = (1, 2.0, "x", 5, 6, 7, 8, 9, "y", "z")
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 1 else f"src{i % 2}", *clash)
            for i, t in enumerate(ODD_TEXTS)] + [(4, "Hello World", "en", "src0", *clash)]
    return sp.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                    "score double, kept string, n_words bigint, sample_id bigint, gone_id bigint, "
                                    "twice_id bigint, stats int, bad_host string, `a.b` string").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(sp):
    return sp.createDataFrame([], "doc_id bigint, quality int, toxic int")
