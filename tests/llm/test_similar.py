"""Near-duplicates of the pipeline's stage against brute force."""

import numpy as np

import corpus_pipeline
from loomvec.llm import similar as N
from loomvec.llm import simhash


def gram_set(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_kept(rows):
    sets = [gram_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * all_ and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {rows[r][0] for r in set(root)}


def near_copies():
    rng = np.random.default_rng(11)
    words, texts = [f"w{i}" for i in range(500)], []
    for i in range(60):
        w = list(rng.choice(words, int(rng.integers(60, 300))))
        texts.append(" ".join(w))
        for k in range(i % 4):
            v = list(w)
            for at in rng.choice(len(v), k * len(v) // 60 + 1, replace=False):
                v[int(at)] = f"changed{k}x{at}"
            texts.append(" ".join(v))
    # One large group, where neither each text is near the first nor all are near each other.
    w = list(rng.choice(words, 120))
    for i in range(60):
        v = list(w)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            v[int(at)] = f"other{i}"
        texts.append(" ".join(v))
    return [*enumerate([*texts, texts[0].upper(), None, "", " \n", "one two", "One  two", "one two three"])]


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = near_copies()
    t = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, t, "")
    assert got.columns == t.columns and {r["doc_id"] for r in got.collect()} == brute_kept(rows)


def test_ids_and_an_empty_table(spark):
    t = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (3, "a b c d e f"), (None, "x y z"), (5, None), (4, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in N.keep_one(t).collect()) == ["3", "4", "None"] and N.keep_one(t.limit(0)).count() == 0


def test_a_text_between_two_groups_links_them(spark):
    """A and B differ in one bit of their fingerprints, B and C are similar sets, A and C aren't: all three are one component."""
    rng, found = np.random.default_rng(8), False
    for _ in range(400):
        b = [f"w{x}" for x in rng.integers(0, 5000, 1000)]
        a, c = list(b), list(b)
        at = int(rng.integers(0, 900))
        a[at : at + 2] = ["alpha", "beta"]
        for k in rng.choice(np.arange(10, 990), 24, replace=False):
            c[int(k)] = f"new{k}"
        fp = [simhash.fingerprint_many(np.frombuffer(x, np.uint8), np.array([0, len(x)]), 5)[0] for x in (" ".join(t).encode() for t in (a, b))]
        sets = [gram_set(" ".join(t)) for t in (a, b, c)]
        jaccard = lambda x, y: len(x & y) / len(x | y)
        if bin(int(fp[0]) ^ int(fp[1])).count("1") <= 2 and jaccard(sets[1], sets[2]) >= 0.8 > jaccard(sets[0], sets[2]):
            found = True
            break
    assert found
    for order in ((a, b, c), (b, a, c), (c, b, a)):
        t = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(order)], "doc_id long, text string")
        assert [r["doc_id"] for r in N.keep_one(t).collect()] == [0]


def test_intersections():
    rng = np.random.default_rng(3)
    for left, right, most in ((1, 3, 20), (30, 40, 300), (5, 9, 20_000), (4, 5, 1)):
        sets = [np.unique(rng.integers(0, most * 2, rng.integers(0, most + 1))).astype(np.uint64) for _ in range(left + right)]
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[left:]] for x in sets[:left]]
        assert N.intersections(sets[:left], sets[left:]).tolist() == want


def test_blocks_of_a_band_meet_each_other(spark):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**64, 100, np.uint64))
    sets = [np.sort(np.append(rng.permutation(base)[:97], rng.integers(0, 2**64, 1, np.uint64))) for _ in range(40)]
    far = np.unique(rng.integers(0, 2**64, 100, np.uint64))
    rows = [(7, i, j, minor, k, k // 2, bytearray(sets[k].astype("<u8").tobytes())) for i in range(2) for j in range(2) for minor in (True, False) for k in range(40) if k % 2 == (i if minor else j)]
    rows += [(9, 0, 0, True, 100, 100, bytearray(far.astype("<u8").tobytes())), (9, 0, 0, False, 0, 0, bytearray(sets[0].astype("<u8").tobytes()))]
    t = spark.createDataFrame(rows, "band long, i long, j long, minor boolean, row long, root long, grams binary")
    found = {(r["node"], r["root"]) for r in N.components(N.block_links(t, 0.8)).collect()}
    assert found == {(k, 0) for k in range(40)}


def test_many_blocks(spark, monkeypatch):
    """Near copies that aren't near their lead, in small blocks."""
    monkeypatch.setattr(N, "BLOCK", 5)
    rng = np.random.default_rng(6)
    base, rows = [f"w{x}" for x in rng.integers(0, 3000, 200)], []
    for family in range(8):
        parent = list(base)
        for at in rng.choice(200, 7, replace=False):
            parent[int(at)] = f"f{family}x{at}"
        for k in range(6):
            child = list(parent)
            child[int(rng.integers(0, 200))] = f"c{family}x{k}"
            rows.append((len(rows), " ".join(child)))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in N.keep_one(t).collect()} == brute_kept(rows)
