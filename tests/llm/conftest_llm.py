"""Small documents with every awkward case, shared by the tests of this folder."""

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORDS.findall(t or "")


def sample(seed=3, n=60):
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, runs, blanks, nulls and one long text."""
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "DELTA!!", "été", "naïve", "x", "of", "the", "and", "***", "|", "straße", "日本", "emoji😀"]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))
    passage, line = text(30), "A repeated line here."
    out = []
    for i in range(n):
        t = text(r.choice([0, 1, 3, 8, 25, 60, 120]))
        if i % 5 == 1:
            t += passage + text(10)
        if i % 9 == 2:
            t = f"{line}\n" * 4 + t
        if i % 11 == 3:
            t += "run " * 45
        out.append(t)
    out[7], out[8], out[9], out[10] = None, "", " \n\t ", "   lead and trail   "
    out[20] = out[30] = out[40]
    out[41] = (out[40] or "") + " more"
    out[50] = text(4000)
    out[51] = "Released under the MIT License. Apache License, Version 2.0; GNU General Public License, version 3 or later. CC BY-NC 4.0"
    return [(i * 3 + 1, t, r.choice(["en", None]), r.choice(["s1", "s2", "s2", "s2", "é", None]), len(t or "")) for i, t in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
