"""The pipeline's stages one by one on awkward tables, and run() against a plain version."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from loomvec.llm import toxicity as X
from loomvec.llm.common import read_table

WORDS = [f"w{i}" for i in range(600)]


def table(seed=1):
    """Documents with toxic ones, copies, near copies, secrets, three sources, and nulls."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(240):
        w = list(rng.choice(WORDS, int(rng.integers(30, 120))))
        if i % 10 == 0:
            w[5:5] = ["you", "gruwel", "idiot"]
        if i % 9 == 4:
            w[7:7] = ["password=hunter2222"]
        labels.append((i, int(i % 10 == 0)))
        rows.append((i, " ".join(w), "en", "abc"[i % 3], len(" ".join(w))))
    for i in range(240, 280):
        base = rows[(i * 7) % 200][1].split(" ")
        if i % 2:
            base[len(base) // 2] = "changed"
        rows.append((i, " ".join(base), "en", None, len(" ".join(base))))
    rows += [(280, None, "en", "a", 0), (281, "", None, "b", 0), (None, "a row without an id", "en", "c", 19)]
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = table()
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_near(rows):
    """All pairs by hand: one row of each component of five-word Jaccard similarity 0.8 or more."""
    s = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(s[i] & s[j]), len(s[i] | s[j])
            if s[i] == s[j] or either and both >= 0.8 * either:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_run_against_a_plain_version(spark, folder):
    rows, _ = table()
    model = X.learn(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    g = X.Grammar(model)
    kept = plain_near([r for r in rows if g.score(r[1]) < X.THRESHOLD])
    kept = {r[0]: re.sub(r"password=[A-Za-z0-9]+", "[SECRET]", r[1] or "") for r in kept}
    docs = read_table(spark, folder, "documents")
    for name, stage in C.STAGES[:3]:
        docs = C.cut(stage(spark, docs, folder))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    assert {r["doc_id"]: r["text"] or "" for r in docs.collect()} == kept and all(r["n_chars"] == len(r["text"] or "") for r in docs.collect() if r["text"])
    assert not any(i is not None and i < 240 and i % 10 == 0 for i in kept) and len(kept) > 200
    # What run() packs is what is left, each document up to twice, whole: its pieces' ids are those of its text.
    out = C.run(spark, folder).toPandas()
    from loomvec.llm import tokens as T

    code = T.encoder(*T.paths())
    for i, g in out[out.doc_id.notna()].groupby("doc_id"):
        ids = np.array([*code.encode(kept[int(i)]), 0], "<u4")
        copies = len(g) // g.piece.nunique()
        assert copies in (1, 2) and set(zip(g.start, g.length, g.ids_crc32, strict=True)) == {(0, len(ids), zlib.crc32(ids.tobytes()))}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept.items()}
    source = {r[0]: r[3] for r in rows}
    size, taken = defaultdict(int), defaultdict(int)
    for i, n in words.items():
        size[source[i]] += n
        taken[source[i]] += n * int((out.doc_id == i).sum() if i is not None else out.doc_id.isna().sum())
    total = 1.5 * sum(size.values())
    assert sum(taken.values()) == pytest.approx(total, rel=0.03) and all(taken[k] <= 2 * size[k] for k in size)
    assert out.groupby("sequence_id").length.sum().max() <= 2048


AWKWARD = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "word " * 60_000, "en", "a", 300_000), (2, "word " * 60_000, "en", "a", 300_000), (3, "short", "en", None, 5), (3, "another one here", "en", None, 16), (4, "password=hunter2222 user=bob", "en", "b", 28)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows_and_clashing_columns(spark, folder, empty):
    t = spark.createDataFrame([(*r, 1, 2, 3) for r in AWKWARD], SCHEMA + ", row int, found int, copies int")
    t = t.limit(0) if empty else t
    for name, stage in C.STAGES:
        out = stage(spark, t, folder)
        n = out.count()
        if name != "packing":
            assert out.columns == t.columns, name
        if empty:
            assert n == 0, name
        else:
            assert n == {"toxicity": 7, "near_duplicates": 5, "secrets": 7}.get(name, n) and n > 0, name
