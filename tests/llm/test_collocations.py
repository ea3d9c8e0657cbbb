"""Collocations against a plain count in Python."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from loomvec.llm import collocations as M


def plain(rows, max_words=3, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    by_lang = {}
    for (lang, *w), a in held.items():
        if any(p[0] == lang and len(p) > len(w) + 1 and any(list(p[1 + i : 1 + i + len(w)]) == w for i in range(len(p))) and 100 * b >= share * a for p, b in held.items()):
            continue
        cuts = [(int(Fraction(1_000_000 * a * a, f[(lang, *w[:k])] * f[(lang, *w[k:])])), k) for k in range(1, len(w))]
        s, k = min(cuts)
        by_lang.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in by_lang.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def texts(seed, rows=300):
    rng = random.Random(seed)
    words = ["the", "New", "york", "is", "a", "big", "Été", "été", "city", "x y", " ", "of", "ÄB"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for _ in range(rng.randrange(80))), rng.choice(["en", "de", None, "und", ""])) for _ in range(rows)]


def held(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, phrase int")
    return {tuple(r) for r in M.mine(docs, **kw).collect()}


def test_against_a_plain_count(spark):
    rows = texts(0) + [(None, "en"), ("", "fr"), (" \t.", "it"), ("Word", None)]
    got = held(spark, rows)
    assert got == plain(rows) and {r[0] for r in got} >= {"en", "und", ""}
    assert held(spark, rows, least=2, top=5, share=80) == plain(rows, least=2, top=5, share=80)


def test_four_words_and_a_full_filter(spark, monkeypatch):
    rows = texts(1)
    assert held(spark, rows, max_words=4, least=2) == plain(rows, max_words=4, least=2)
    monkeypatch.setattr(M.Filter.over, "__defaults__", (64,))  # a filter that lets nearly everything through changes nothing
    assert held(spark, rows, max_words=4, least=2) == plain(rows, max_words=4, least=2)


def test_small_flushes_long_texts_repeats_and_empty_tables(spark):
    rows = [("new york city " * 30_000, "en"), *[("red fox", "en")] * 15, ("a a a a a a a a a a a a a", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {(r["phrase"], r["f"]) for r in M.exploded(docs, 2, flush=50).groupBy("phrase").agg(F.sum("f").alias("f")).collect()} == {("new york", 30_000), ("york city", 30_000), ("city new", 29_999), ("red fox", 15), ("a a", 12)}
    assert held(spark, rows) == plain(rows)
    assert M.mine(docs.limit(0)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 3_100_000_013, 3_200_000_011
    counts = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, size int, phrase string, f long")
    assert M.scored(counts, 3).first()["score"] == 1_000_000 * a * a // (left * right)


class Task:
    """Stands for a table: keeps what a task runs."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, kind):
        self.run = run
        return self


def peak(texts_):
    """(bytes that a task holds at most, words that it counts) over 1,000 new words a text."""
    task = M.exploded(Task(), 1)
    batches = (pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(f"w{1000 * i + k}" for k in range(1000))])], names=["lang", "text"]) for i in range(texts_))
    tracemalloc.start()
    try:
        n = sum(sum(f for p, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if p is not None) for b in task.run(batches))
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


def test_a_task_holds_no_more_for_more_words():
    peak(1)  # imports
    (small, n), (large, m) = peak(300), peak(900)
    assert (n, m) == (300_000, 900_000) and large < 1.2 * small


def test_counts_of_tasks_are_dealt_out_before_they_are_added(spark):
    docs = spark.createDataFrame([("red fox", "en")] * 15, "text string, lang string")
    t = M.summed(M.exploded(docs, 2, flush=5))
    below = t._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(below) == 2 and "Aggregate" in below[0] and "Aggregate" not in below[1]
    assert [tuple(r) for r in t.collect()] == [("en", "red fox", 15)]


def test_few_words_held_at_a_time(spark):
    rows = texts(2)
    docs = spark.createDataFrame([(t or "", lang or "und") for t, lang in rows], "text string, lang string")
    for size in (1, 2, 3):
        got, want = ({tuple(r) for r in M.summed(M.exploded(docs, size, **kw)).collect()} for kw in ({"vocabulary": 5}, {}))
        assert got == want and len(got) > 10
