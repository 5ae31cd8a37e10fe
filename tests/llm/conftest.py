import random

import pytest

from corpus_helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def few_cells(monkeypatch):
    """A small table of token counts, which a small corpus does not fill."""
    from cairn.llm import line_dedup

    monkeypatch.setattr(line_dedup, "CELL_BITS", 12)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): prose, copies, near copies, nulls, empty and very long texts, repeated rows."""
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randrange(20, 120)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(6)]
    for i in range(6):
        words = base[i].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words), "s1"))
    near = prose(rnd, 200).split()
    for i in range(30):
        words = list(near)
        words[5 * i % 190] = f"v{i}"
        rows.append((300 + i, " ".join(words), "s2"))
    rows += [(400, None, "s0"), (401, "", "s0"), (402, "", None), (403, "... !!!", "s1"), (404, "short", "s1"), (405, "Short", "s1"), (406, prose(rnd, 30000), "s2"), (407, "\n".join(base[:3]), "s1")]
    return [*rows, rows[0], rows[0], (0, "same id, other text here now", "s0")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
