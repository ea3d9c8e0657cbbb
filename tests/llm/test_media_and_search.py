"""FLAC round trips and exact search."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import flac as M
from loomvec.llm import topk as K


def payloads():
    rng = np.random.default_rng(0)
    return [np.zeros(192, np.uint8), np.full(192 * 300, 255, np.uint8), rng.integers(0, 256, 192 * 40).astype(np.uint8), np.cumsum(rng.integers(-2, 3, 192 * 140)).astype(np.uint8), M.padded(np.frombuffer("Wörter und Sätze, lesbar. ".encode() * 90, np.uint8))]


def test_round_trips_in_lockstep_and_frame_by_frame():
    media = M.encode_many(payloads())
    for p, m, x in zip(payloads(), media, M.decode_many(media), strict=True):
        assert ((x + 128).astype(np.uint8) == p).all() and M.read_head(m)[0]["samples"] == len(p)
        blocks = list(M.decode_blocks(m))
        assert (np.concatenate([b[2][0] for b in blocks]) + 128 == p).all()
        assert [b[0] for b in blocks] == list(range(0, len(p), 192)) and (M.decode(m)[1] == [b[1] for b in blocks]).all()
        for sample, at in M.read_head(m)[0].get("seek", []):
            assert blocks[sample // 192][1] == at + M.read_head(m)[1]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=700))
def test_any_bytes(raw):
    p = M.padded(np.frombuffer(raw, np.uint8))
    assert len(p) % 192 == 0 and len(p) > 0
    assert (M.decode_many(M.encode_many([p]))[0] + 128 == p).all()


def test_damage_is_found():
    m = bytearray(M.encode_many([payloads()[4]])[0])
    for at in (len(m) - 1, len(m) // 2, M.read_head(bytes(m))[1] + 4):
        bad = bytearray(m)
        bad[at] ^= 0x10
        with pytest.raises(M.FlacError):
            M.decode(bytes(bad))
    with pytest.raises(M.FlacError):
        M.decode(b"nope" + bytes(m[4:]))


class Writer:
    """Bits of a stream that encode() doesn't write: stereo, 16 bits, linear predictors, partitions, escapes."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [(v >> i) & 1 for i in range(n - 1, -1, -1)]

    def rice(self, r, k):
        u = r * 2 if r >= 0 else -r * 2 - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes()


def test_linear_predictors_partitions_and_stereo():
    rng = np.random.default_rng(1)
    n = 64
    left = np.cumsum(rng.integers(-300, 300, n)).astype(int)
    right = left + rng.integers(-5, 5, n)
    side = left - right
    w = Writer()
    w.put(0x3FFE, 14), w.put(0, 2), w.put(6, 4), w.put(0, 4), w.put(8, 4), w.put(4, 3), w.put(0, 1), w.put(0, 8), w.put(n - 1, 8)
    head = w.bytes()
    w.put(M.crc8(head), 8)
    # left: linear predictor of order 2, two partitions, the second escaped; side: fixed of order 1, wasted bits none
    w.put(0, 1), w.put(32 + 1, 6), w.put(0, 1)
    for x in left[:2]:
        w.put(int(x) & 0xFFFF, 16)
    w.put(5 - 1, 4), w.put(1, 5), w.put(3, 5), w.put(-1 & 31, 5)
    res = [int(left[i]) - ((3 * int(left[i - 1]) - int(left[i - 2])) >> 1) for i in range(2, n)]
    w.put(0, 2), w.put(1, 4), w.put(7, 4)
    for r in res[: n // 2 - 2]:
        w.rice(r, 7)
    w.put(15, 4), w.put(18, 5)
    for r in res[n // 2 - 2 :]:
        w.put(r & ((1 << 18) - 1), 18)
    w.put(0, 1), w.put(8 + 1, 6), w.put(0, 1), w.put(int(side[0]) & 0x1FFFF, 17), w.put(0, 2), w.put(0, 4), w.put(3, 4)
    for i in range(1, n):
        w.rice(int(side[i] - side[i - 1]), 3)
    frame = w.bytes()
    frame += M.crc16(frame).to_bytes(2, "big")
    info = (n).to_bytes(2, "big") * 2 + b"\0" * 6 + ((44100 << 44) | (1 << 41) | (15 << 36) | n).to_bytes(8, "big") + b"\0" * 16
    (offset, _, x), = M.decode_blocks(b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame)
    assert offset == 0 and (x[0] == left).all() and (x[1] == right).all()


def test_crc_of_many_ranges():
    data = np.random.default_rng(2).integers(0, 256, 500).astype(np.uint8)
    start, end = np.array([0, 3, 10, 499, 7]), np.array([500, 3, 11, 500, 250])
    assert M.crc16_of(data, start, end).tolist() == [M.crc16(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_digests_and_pcm_blocks(spark):
    texts = ["", None, "a" * 192, "b" * 193, "é" * 400, "same", "same", "long " * 60_000]
    t = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, media string").repartition(2)
    got = {r["doc_id"]: r for r in M.digests(t).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[5]["media_sha256"] == got[6]["media_sha256"] and got[5]["feature"] == got[6]["feature"]
    stored = {r["doc_id"]: r["media"] for r in M.encode_column(t).collect()}
    for i, x in enumerate(texts):  # a second implementation: the plain decoder, and the feature by hand
        raw = (x or "").encode()
        p = np.frombuffer(raw + b" " * (-len(raw) % 192 if raw else 192), np.uint8).astype(int) - 128
        if len(raw) < 2000:
            assert (np.concatenate([y[0] for _, _, y in M.decode_blocks(stored[i])]) == p).all()
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(p[:-1], p[1:], strict=True))
        assert got[i]["feature"] == f"n={len(p)};mean={sum(p) / len(p):.4f};rms={(sum(p * p) / len(p)) ** 0.5:.4f};peak={max(abs(p))};zc={crossings}"
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    blocks = M.pcm_blocks(M.encode_column(t.where("doc_id = 4")), samples=500).orderBy("block").collect()
    pcm = b"".join(b["pcm"] for b in blocks)
    assert (np.frombuffer(pcm, np.int8).astype(int) + 128).astype(np.uint8).tobytes().rstrip(b" ") == texts[4].encode()
    assert [b["sample_offset"] for b in blocks] == np.cumsum([0] + [b["n_samples"] for b in blocks])[:-1].tolist()
    assert M.digests(t.limit(0)).count() == 0


# Search


def brute(rows, k=10, every=100, scale=1024):
    good = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(set(out))


def test_exact_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 16))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    v[300:400] = v[299] + 0.01 * rng.standard_normal((100, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, [0.0] * 16), (1001, [0.0] * 16), (1002, None), (1003, []), (1004, [float("nan")] * 16), (1005, [None] * 16), (1100, [1.0] * 3), (None, [1.0] * 16), (1200, [float("inf")] * 16)]
    t = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    assert sorted(tuple(r) for r in K.top_k(t).collect()) == brute(rows)
    assert K.top_k(t.limit(0)).count() == 0


def test_many_shards_and_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in K.top_k(t, every=20, shard=64, group=3).collect()) == brute(rows, every=20)


def clusters(n=4000, d=16, k=20, noise=0.02):
    rng = np.random.default_rng(8)
    c = rng.standard_normal((k, d))
    return (c / np.sqrt((c * c).sum(1, keepdims=True)))[rng.integers(0, k, n)] + noise * rng.standard_normal((n, d))


def test_bounds_leave_most_pairs_of_clustered_vectors_out(spark):
    """Of all pairs of a query and a vector, a dual-tree search scores few where there are clusters, over several shards too."""
    v = clusters()
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = K.search_table(t, every=20, shard=500, group=40)
    assert found.agg({"scored": "sum"}).first()[0] < 0.25 * 200 * 4000
    assert sorted(tuple(r) for r in K.top_k(t, every=20, shard=500, group=40).collect()) == brute(rows, every=20)


@pytest.mark.parametrize("factor", [1e6, 1e15])
def test_scores_are_exact_whatever_their_size(spark, factor):
    """Beyond 2**53 in whole numbers of 64 bits, beyond 2**63 in Python's; what a long can't hold is its nearest long."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 8))
    v *= factor / np.sqrt((v * v).sum(1, keepdims=True))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(x * 1024)) for x in r] for r in v]
    want = []
    for q in range(0, 300, 100):
        s = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(300) if i != q)[:10]
        want += [(q, n + 1, i, min(2**63 - 1, -x)) for n, (x, i) in enumerate(s)]
    got = sorted(tuple(r) for r in K.top_k(t).collect())
    assert [x[3] for x in got] == [x[3] for x in want]
    if factor < 1e9:
        assert got == want


@pytest.mark.parametrize("n", [1, 5, 300])
def test_cover_tree_covers_and_keeps_centres_apart(n):
    x = clusters(n, 5, 6, 0.05)
    tree = K.CoverTree.over(x, leaf=4)

    def below(node):
        a, b = tree.kids_lo[node], tree.kids_hi[node]
        return [i for c in range(a, b) for i in below(c)] if b > a else tree.order[tree.lo[node] : tree.hi[node]].tolist()

    assert sorted(below(0)) == list(range(n))
    for node in range(len(tree.centre)):
        d = np.sqrt(((x[below(node)] - x[tree.centre[node]]) ** 2).sum(1))
        assert d.max() <= tree.radius[node] + 1e-9
        kids = tree.centre[tree.kids_lo[node] : tree.kids_hi[node]]
        gaps = [np.sqrt(((x[a] - x[b]) ** 2).sum()) for i, a in enumerate(kids) for b in kids[:i]]
        assert min(gaps, default=np.inf) > K.SHRINK * tree.radius[node] - 1e-9
    assert n < 300 or len(tree.centre) > 6


def test_blocks_of_stored_streams_seek_and_sum_up(spark):
    rng = np.random.default_rng(6)
    texts = ["", "é" * 700, "a b c " * 900, "".join(map(chr, rng.integers(32, 900, 2500))), None, "x" * 192]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    media = M.store(t)
    whole = {r["doc_id"]: r.asDict() for r in M.describe(M.stored_blocks(media)).collect()}
    parts = {r["doc_id"]: r.asDict() for r in M.describe(M.stored_blocks(media, samples=384)).collect()}
    streams = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for i, text in enumerate(texts):
        p = M.padded(np.frombuffer((text or "").encode(), np.uint8))
        x = p.astype(np.int64) - 128
        zc = int(((x >= 0)[1:] != (x >= 0)[:-1]).sum())
        want = f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};zc={zc}"
        assert parts[i]["feature"] == whole[i]["feature"] == want and parts[i]["payload_sha256"] == whole[i]["payload_sha256"] == hashlib.sha256(p.tobytes()).hexdigest()
        assert parts[i]["tail_crc32"] == zlib.crc32(p[-16:].tobytes()) and parts[i]["n_blocks"] == -(-len(p) // 384) and whole[i]["n_blocks"] == 1
        places = {offset: at for offset, at, _ in M.decode_blocks(streams[i])}
        for pair in parts[i]["seek"].split(","):
            sample, byte = map(int, pair.split(":"))
            assert places[sample] == byte and sample % 384 == 0
