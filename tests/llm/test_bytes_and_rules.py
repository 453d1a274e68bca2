"""Compression rules and URL rules against direct computation."""

import re

import duckdb
import zstandard

from lumenrel.llm import compression_rules as C
from lumenrel.llm import url_rules as U
from lumenrel.llm.queries import OP5_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = text.split("\n")
    dups = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(ch) for ch in "#*$%&|<>"), dups, len(inside), failed


def test_base_measures_and_verdicts(odd_docs, corpus):
    got = C.measure(odd_docs).collect()
    assert len(got) == len(corpus) + 8
    text = {r[0]: r[1] for r in corpus}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
            assert not (r.base_failed and r.kept)


def test_bands():
    packer = zstandard.ZstdCompressor(level=3)
    prose = ("Some plain text about rivers, towns and the people who lived there, long ago and not so long ago; "
             "it names a mill, two bridges, an inn with a green door, and several dogs of different sizes. ")  # fmt: skip
    assert C.measure_text(prose.encode(), C.Bands(), packer)[-1]
    varied = " ".join(f"w{i} again{i % 7}" for i in range(40))
    assert not C.measure_text((varied + " " + "spam ham eggs " * 2000).encode(), C.Bands(), packer)[-1]
    import random

    noise = bytes(random.Random(1).randrange(128, 256) for _ in range(6000))
    noise = b" ".join(noise[i : i + 20] for i in range(0, 6000, 20))
    assert not C.measure_text(noise, C.Bands(), packer)[-1]


def test_keep_keeps_columns(odd_docs, docs, no_docs):
    kept = C.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {r.doc_id for r in C.measure(docs).collect() if r.kept}
    assert {r.doc_id for r in C.keep(docs).collect()} == want
    assert C.keep(no_docs).count() == 0 and C.measure(no_docs).count() == 0


URLS = [
    "http://example.org/es/1", "https://www.Example.ORG/en/12?x=1", "http://example.org/en/2", "http://a.b.example.org/es/", "http://org/", "http://borg/x", "http://x.org", "http://x.org/?q", "no scheme", "", None,
    "http://x.com/fr/1", "http://x.com/de/1#f", "http://notexample.org/es/1", "http://example.org:80/es/", "http://com/fr/", "http://..org/a", "x://y://example.org/es/", "http://example.org/ES/", "http://example.org?/es/", "://",
]


def test_url_rules_match_sql(spark):
    import pandas as pd

    rows = [(i, u) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows * 2], "page_id long, url string, host string, stack string")
    got = U.judge(pages, U.default_rules(spark))
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    want = {r[0]: tuple(r[1:]) for r in db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP5_SQL})").fetchall()}
    got = got.collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], URLS[r.page_id]


def test_url_rules_general(spark):
    rules = [("a.example", "/", "block"), ("a.example", "/x", "allow"), ("a.example", "/x/y", "block"), ("b.a.example", "/x", "block"), ("example", "/x/y/z/long", "allow"), ("a.example", "/x", "block"), (None, "/", "block")]
    made = spark.createDataFrame(rules, U.RULE_SCHEMA)
    urls = ["http://a.example/", "http://a.example/x", "http://a.example/x/y", "http://a.example/x/y/z/long/1", "http://b.a.example/x", "http://q.example/x", "http://b.a.example/z"]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), made, deals=3).collect()}
    best = lambda host, path: max(((len(h + p), h + p, "block" if (h, p, "block") in rules else "allow") for h, p, _ in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        assert got[i] == best(host, "/" + path)[1:], u
    none = spark.createDataFrame([], U.RULE_SCHEMA)
    assert [r.verdict for r in U.judge(spark.createDataFrame([(1, "http://x/")], "page_id long, url string"), none, "block").collect()] == ["block"]
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), made).count() == 0
