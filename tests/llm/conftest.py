import random

import pytest

WORDS = "the of and to in a is that for it was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): prose, exact and near copies, shared passages, repeats, nulls, empty and long texts, other scripts."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " more", texts[9].replace(" ", "\n"), "x " + passage + " y", passage, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)]
    texts += [None, None, "", " ", "\n\n", "a", "word " * 300, "z" * 400, "aaaa" * 60, "Ünï çödé \U0001f600 ▁ test  two   three", "tab\tand\x0bfeed\x0c end", prose(rng, 6000), "same line\n" * 40, "\x00\x01 odd", "été " * 30]
    near = texts[20].split() + prose(rng, 120).split()
    texts += [" ".join(near), " ".join(near[:50] + ["changed"] + near[51:]), " ".join(near[:-1])]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, corpus):
    """The corpus with repeated rows, null ids, and extra columns whose names the operators use themselves."""
    rows = [*corpus, *corpus[:5], *((None, t, None, None, 1) for t in ("null id " * 30, None, corpus[3][1]))]
    extra = ", n_bytes string, part string, chunk string, block string, kind string, key string, copies string, size string, fp string, ids string, score string, kept string, row string"
    return spark.createDataFrame([(*r, *["?"] * 13) for r in rows], SCHEMA + extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
