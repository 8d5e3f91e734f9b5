from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, wordless, very long, tied and repeated rows, and extra columns."""
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    other = "el rápido zorro marrón salta sobre el perro perezoso cerca del viejo río hoy"
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \n\t ", None, "b"),
        (3, "123 !!! 456", "en", "a"),
        (4, line + "\n" + other, "en", "a"),
        (5, line + "\n" + other, "es", "b"),
        (6, line, "en", None),
        (6, line, "en", None),
        (7, "\n".join(f"{line} number {i} of many words" for i in range(900)), "en", "c"),
        (8, other + " mañana", "es", "c"),
        (9, "a", "en", "ß"),
        (None, line + " once more", "en", "a"),
        (10, "one word\x0b\x0cand\r\nothers", "en", "é"),
    ]
    return spark.createDataFrame(
        [
            (i, t, lang, s, None if t is None else len(t), "x", 1)
            for i, t, lang, s in rows
        ],
        DOCUMENTS + ", _lang_extra string, size int",
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
