"""Small corpora for the tests of this folder."""

import random

import pytest

import __spark_entry__  # noqa: F401  workers get the package's path from it

#: Columns whose names the operators use themselves.
CLASHES = ["n", "rep", "bands", "component", "hits", "items", "ids", "row", "rank", "seeds", "h", "kind", "spans", "licenses", "good", "slot", "text_crc32", "key"]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd characters, empty and long ones."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta", "Gamma9", "délta", "of", "the", "a", "ß", "x-y", "is"]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))
    passage = say(30)
    texts = [None, "", " \t\n", "one", "two words", "one", say(4), say(5), passage, "Zoë x y 日本 😀 " + say(12)]
    for _ in range(6):
        whole = say(rng.randrange(25, 80))
        texts += [whole, whole, whole.upper()]
        words = whole.split()
        for _ in range(4):
            changed = list(words)
            for _ in range(rng.randrange(1, 4)):
                changed[rng.randrange(len(changed))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(changed))
    texts += [say(10) + " " + passage + "\n" + say(7), passage + "  " + passage, say(3000), "x " * 60, "w" * 5000]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents frame with clashing extra columns from (doc_id, text) rows."""
    def make(rows, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
        full = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", len(t) if t is not None else None, *["clash"] * len(CLASHES)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)
    return make
