"""Substring and near-duplicate operators against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomvec.llm import components as K
from loomvec.llm import simhash as H
from loomvec.llm import suffix_dedup as S


def brute_spans(rows, width=S.LONG):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                mask[k : k + width] = True
        edges = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
        out.append((i, len(b), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdef "), 3000))
    docs = []
    for i in range(120):
        a, n = int(rng.integers(0, 2700)), int(rng.integers(150, 260))
        docs.append((i, "".join(rng.choice(list("xyz"), int(rng.integers(0, 40)))) + base[a : a + n] + "".join(rng.choice(list("uvw"), int(rng.integers(0, 40))))))
    docs += [(200, "a" * 1000), (201, "ab" * 400), (202, None), (203, ""), (204, "q" * 199), (205, "q" * 199), (206, "r" * 200), (206, "r" * 200), (None, base[:400])]
    return docs + [(207, "é" * 150), (208, "\0" * 150 + base[:250]), (209, base[:250] + "\0" * 30), (210, base[:250] + "\0" * 10)]


@pytest.mark.parametrize("parts", [1, 5])
def test_substrings_against_brute_force(spark, parts):
    t = spark.createDataFrame([(*d, "x") for d in awkward()], "doc_id long, text string, row string").repartition(parts)
    got = sorted((tuple(r) for r in S.dedup(t).collect()), key=str)
    assert got == brute_spans(awkward())


def test_kept_texts_follow_from_the_spans(spark):
    t = spark.createDataFrame(awkward(), "doc_id long, text string")
    want = {(i, h) for i, _, _, _, h in brute_spans(awkward())}
    assert {(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in S.kept_texts(t).collect()} == want


def test_family_of_small_levels_finds_what_one_level_finds(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 2000).astype(np.uint8).tobytes()
    rows = []
    for i in range(300):
        a = int(rng.integers(S.BEFORE, 1500))
        f, b = int(rng.integers(0, S.BEFORE + 1)), int(rng.integers(S.KGRAM, S.LONG + 1))
        front = bytearray(base[a - f : a])
        if front and i % 3 == 0:
            front[int(rng.integers(len(front)))] = 65
        rows.append((0, i, a, True, bytes(front)[::-1], base[a : a + b]))

    def run(level):
        monkeypatch.setattr(S, "LEVEL", level)
        batches = [S._bytes_batch([list(c) for c in zip(*rows[lo : lo + 37], strict=True)]) for lo in range(0, len(rows), 37)]
        return sorted(tuple(r.values()) for b in S.sort_shard(iter(batches)) for r in b.to_pylist())

    assert run(1 << 15) == run(37) and run(37)


def test_long_texts_come_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes().decode()
    text = text[:40_000] + text[10_000:10_700] + text[40_000:]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.StructArray.from_arrays([pa.array([7]), pa.array([text.encode()])], ["doc_id", "text"])], names=["row", "payload"])
    whole = {tuple(r.values()) for b in S.find_anchors(iter([batch])) for r in b.to_pylist()}
    monkeypatch.setattr(S, "PART", 4096)
    parts = {tuple(r.values()) for b in S.find_anchors(iter([batch])) for r in b.to_pylist()}
    anchors = lambda rows: {(g, d, r, p | 1) for g, d, r, p in rows if p >= 0}
    assert anchors(whole) <= anchors(parts)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(40):
        w = list(rng.choice(words, 150))
        docs.append(" ".join(w))
        for _ in range(i % 4):
            v = list(w)
            v[int(rng.integers(150))] = "CHANGED"
            docs.append("\t ".join(v))
    docs += [None, "", " \n", "one", "One two", "　", "same same same same", "same same same same"]
    rows = [(i, t) for i, t in enumerate(docs)]
    t = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.near_duplicates(t).collect()}
    fps = [fingerprint(t) for t in docs]
    roots = roots_of(fps)
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in enumerate(fps)}
    assert {r["doc_id"] for r in H.keep_one(t).collect()} == set(roots)


def test_large_group_of_near_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(600)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = K.components(H.cut(H.links(spark.createDataFrame([(f,) for f in signed], "fp long"))))
    root = {r["node"]: r["root"] for r in found.collect()}
    want, got = {}, {}
    for f, s, r in zip(fps, signed, roots_of(fps), strict=True):
        want.setdefault(r, set()).add(f)
        got.setdefault(root.get(s, s), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 40), 1)}


def test_ids_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(none).count() == 0 and H.near_duplicates(none).count() == 0 and H.keep_one(none).count() == 0
    t = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "x y z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in H.near_duplicates(t).collect())
    assert got == [("3", "3"), ("None", "3"), ("None", "3"), ("None", "None")]
    assert H.keep_one(t.withColumn("extra", F.lit(1))).columns == ["doc_id", "text", "extra"] and H.keep_one(t).count() == 2
