"""Media columns: a FLAC codec over byte payloads, on NumPy.

The decoder verifies the CRC-8 of every frame header, the CRC-16 of every frame and the MD5 of the
samples, decodes Rice residuals and fixed and linear predictors, and gives PCM blocks with the
sample offset and the byte offset of each, so that a reader can seek. Streams of equal blocks (what
encode() writes) are decoded in lockstep, one step a sample for all frames of a batch; any other
stream goes through the plain decoder, frame by frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_spans, cut, narrow, pieces, read_table

BLOCK = 192
RATE = 8000
#: Frames that one NumPy step works on, whatever the length of a text.
CHUNK = 4096
#: A seek point every so many frames.
SEEK = 128
HEAD = b"\xff\xf8\x14\x02"  # fixed blocks, 192 samples, rate from STREAMINFO, mono, 8 bits


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: The CRC-16 after two more bytes, by the CRC before, xor both bytes.
_w = np.arange(65536, dtype=np.uint32)
_one = ((_w << 8) & 0xFFFF) ^ CRC16[_w >> 8]
CRC16_PAIR = (((_one << 8) & 0xFFFF) ^ CRC16[_one >> 8]).astype(np.uint16)
del _w, _one


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def crc16_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for many ranges. Zeros before the first byte don't change it, so ranges are aligned at their ends."""
    size = end - start
    crc = np.zeros(len(start), np.uint16)
    if not len(start):
        return crc
    padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)])
    by_size = np.argsort(-size, kind="stable")
    end_, size_, crc_ = end[by_size], size[by_size], crc.copy()
    for left in range(int(size_[0] + 1) // 2, 0, -1):
        n = int(np.searchsorted(-size_, -(2 * left - 1), side="right"))  # ranges that reach so far back
        at = end_[:n] - 2 * left
        first = padded[at + 1].astype(np.uint16)
        first[size_[:n] == 2 * left - 1] = 0
        crc_[:n] = CRC16_PAIR[crc_[:n] ^ ((first << 8) | padded[at + 2])]
    crc[by_size] = crc_
    return crc


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    while n >= 1 << (6 - len(out)):
        out.append(0x80 | (n & 0x3F))
        n >>= 6
    return bytes([((0xFF << (7 - len(out))) & 0xFF) | n, *out[::-1]])


def frame_heads(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Headers of the frames with these numbers as rows of one matrix, and their lengths."""
    unique, at = np.unique(numbers, return_inverse=True)
    heads = [h + bytes([crc8(h)]) for h in (HEAD + utf8_number(int(n)) for n in unique)]
    table = np.zeros((len(heads), 12), np.uint8)
    for i, h in enumerate(heads):
        table[i, : len(h)] = np.frombuffer(h, np.uint8)
    return table[at], np.array([len(h) for h in heads])[at]


def residuals(s: np.ndarray, order: int) -> np.ndarray:
    """Of the fixed predictors; the first `order` columns are warm-up samples."""
    r = s.copy()
    for _ in range(order):
        r[:, 1:] = r[:, 1:] - r[:, :-1]
    if order:
        r[:, :order] = s[:, :order]
    return r


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples (frames, 192) int32 in -128..127 -> (bytes of all frames one after another, bytes of each)."""
    n = len(samples)
    best, kind, param = np.full(n, BLOCK * 8), np.full(n, -1), np.zeros(n, np.int64)
    values = samples.copy()
    for order in (0, 1, 2):
        r = residuals(samples, order)
        u = (r << 1) ^ (r >> 31)
        tail = u[:, order:]
        for k in range(8):
            bits = (tail >> k).sum(axis=1) + (k + 1) * (BLOCK - order) + 8 * order + 10
            better = bits < best
            best[better], kind[better], param[better] = bits[better], order, k
        chosen = kind == order
        values[chosen] = u[chosen]
    constant = (samples == samples[:, :1]).all(axis=1)
    kind[constant], best[constant] = -2, 8

    heads, head_len = frame_heads(numbers)
    size = head_len + 1 + (best + 7) // 8 + 2
    ends = np.cumsum(size)
    begin = ends - size
    bits = np.zeros(int(ends[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        if not width:
            return
        v = value.astype(np.int64)
        for lo in range(0, width, 8):
            w = min(8, width - lo)
            byte = ((v >> (width - lo - w)) & ((1 << w) - 1)).astype(np.uint8)
            cols = np.unpackbits(byte[:, None], axis=1)[:, 8 - w :]
            bits[(at + lo)[:, None] + np.arange(w)] = cols

    for i in range(int(head_len.max())):
        some = head_len > i
        put((begin[some] + i) * 8, heads[some, i], 8)
    body = (begin + head_len) * 8
    put(body, np.where(kind == -2, 0, np.where(kind == -1, 2, (8 + kind) << 1)), 8)
    body = body + 8
    put(body[constant], samples[constant, 0] & 0xFF, 8)
    plain = kind == -1
    if plain.any():
        put((body[plain][:, None] + np.arange(BLOCK) * 8).ravel(), samples[plain].ravel() & 0xFF, 8)
    for order in (0, 1, 2):
        for k in np.unique(param[kind == order]):
            some = (kind == order) & (param == k)
            k = int(k)
            at = body[some]
            for j in range(order):
                put(at + 8 * j, samples[some, j] & 0xFF, 8)
            at = at + 8 * order
            put(at, np.full(len(at), k), 10)  # method 0, partition order 0, the parameter
            u = values[some][:, order:]
            high = u >> k
            after = np.cumsum(high + 1 + k, axis=1)
            stop = (at + 10)[:, None] + after - (k + 1)  # where the unary part ends with a one
            put(stop.ravel(), (1 << k) | (u & ((1 << k) - 1)).ravel(), k + 1)
    data = np.packbits(bits)
    crc = crc16_of(data, begin, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    return data, size


def stream_head(n: int, md5: bytes, frame_size: np.ndarray) -> bytes:
    """The marker, STREAMINFO and, for streams of more than SEEK frames, a seek table."""
    info = BLOCK.to_bytes(2, "big") * 2 + int(frame_size.min()).to_bytes(3, "big") + int(frame_size.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + md5
    at = np.concatenate([[0], np.cumsum(frame_size)[:-1]])[::SEEK]
    points = b"".join((i * SEEK * BLOCK).to_bytes(8, "big") + int(a).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i, a in enumerate(at)) if len(frame_size) > SEEK else b""
    out = b"fLaC" + bytes([0 if points else 0x80]) + len(info).to_bytes(3, "big") + info
    return out + (bytes([0x83]) + len(points).to_bytes(3, "big") + points if points else b"")


def encode_many(payloads: list[np.ndarray]) -> list[bytes]:
    """FLAC streams of byte payloads whose lengths are positive multiples of 192; a sample is a byte less 128."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(counts) - counts
    everything = np.concatenate(payloads).reshape(-1, BLOCK)
    numbers = np.arange(len(everything)) - np.repeat(first, counts)
    parts, sizes = [], []
    for lo in range(0, len(everything), CHUNK):
        data, size = encode_frames(everything[lo : lo + CHUNK].astype(np.int32) - 128, numbers[lo : lo + CHUNK])
        parts.append(data)
        sizes.append(size)
    data, size = np.concatenate(parts), np.concatenate(sizes)
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for p, f, c in zip(payloads, first, counts, strict=True):
        head = stream_head(len(p), hashlib.md5(p ^ 0x80).digest(), size[f : f + c])
        out.append(head + data[at[f] : at[f + c]].tobytes())
    return out


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def read_head(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO as a dict, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info = 4, None
    while True:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("metadata cut short")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "fixed": body[:2] == body[2:4], "rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "bits": ((packed >> 36) & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if last:
            return info, at


def find_frames(data: np.ndarray, n: int) -> np.ndarray | None:
    """Starts of n frames in a stream of 192-sample blocks, by their headers; None if they aren't clear."""
    if len(data) < 4:
        return None
    hit = np.flatnonzero((data[:-3] == 0xFF) & (data[1:-2] == 0xF8) & (data[2:-1] == 0x14) & (data[3:] == 0x02))
    if len(hit) != n:
        return None
    heads, size = frame_heads(np.arange(n))
    room = np.concatenate([data, np.zeros(12, np.uint8)])
    found = room[hit[:, None] + np.arange(12)]
    return hit if ((found == heads) | (np.arange(12) >= size[:, None])).all() else None


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, head_len: np.ndarray) -> np.ndarray | None:
    """Samples (frames, 192) of mono 8-bit frames that encode_frames() can write; None if some frame is of another kind."""
    if (crc16_of(data, start, end - 2) != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise FlacError("frame checksum")
    lo, hi = int(start[0]), int(end[-1])
    data, start = np.concatenate([data[lo:hi], np.zeros(8, np.uint8)]), start - lo
    kind = data[start + head_len]
    body = start + head_len + 1
    out = np.zeros((len(start), BLOCK), np.int32)
    if not np.isin(kind, (0, 2, 16, 18, 20)).all():
        return None
    constant, plain = kind == 0, kind == 2
    out[constant] = data[body[constant]].astype(np.int8)[:, None]
    if plain.any():
        out[plain] = data[body[plain][:, None] + np.arange(BLOCK)].astype(np.int8)
    coded = kind >= 16
    if not coded.any():
        return out
    bits = np.unpackbits(data)
    ones = np.concatenate([np.flatnonzero(bits).astype(np.int32), np.full(1, len(bits), np.int32)])
    rank = np.concatenate([np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32)])
    wide = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]
    for order in (0, 1, 2):
        some = np.flatnonzero(kind == (8 + order) << 1)
        if not len(some):
            continue
        pos = body[some] * 8 + 8 * order
        lead = (wide[pos >> 3] >> (24 - (pos & 7) - 10)) & 1023
        if (lead > 14).any():
            return None
        k, pos = lead, pos + 10
        r = np.zeros((len(some), BLOCK), np.int32)
        for j in range(order):
            r[:, j] = data[body[some] + j].astype(np.int8)
        mask = (1 << k) - 1
        for j in range(order, BLOCK):
            stop = ones[rank[pos]]
            low = (wide[(stop + 1) >> 3] >> (24 - ((stop + 1) & 7) - k)) & mask
            u = ((stop - pos) << k) | low
            r[:, j] = (u >> 1) ^ -(u & 1)
            pos = stop + 1 + k
        for level in range(order, 0, -1):
            # r[:, level-1:] holds differences of this level from column `level`; sum them up on the warm-up's difference.
            warm = r[:, :order].copy()
            diff = warm
            for _ in range(level - 1):
                diff = diff[:, 1:] - diff[:, :-1]
            r[:, order:] = diff[:, -1:] + np.cumsum(r[:, order:], axis=1)
            r[:, :order] = warm
        out[some] = r
    return out


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("stream cut short")
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.pos - n)
        self.pos += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(b: _Bits, block: int, order: int) -> list[int]:
    method, parts = b.take(2), 1 << b.take(4)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, out = 4 + method, []
    for i in range(parts):
        n = block // parts - (order if i == 0 else 0)
        k = b.take(width)
        if k == (1 << width) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = (b.unary() << k) | b.take(k)
                out.append((u >> 1) ^ -(u & 1))
    return out


def _subframe(b: _Bits, block: int, bits: int) -> list[int]:
    if b.take(1):
        raise FlacError("padding before a subframe")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * block
    elif kind == 1:
        out = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        shift, weights = 0, ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order] if kind < 32 else ()
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        for r in _residual(b, block, order):
            out.append(r + (sum(w * x for w, x in zip(weights, out[: -order - 1 : -1] if order else (), strict=True)) >> shift))
    else:
        raise FlacError("reserved subframe type")
    return [x << wasted for x in out] if wasted else out


def decode_blocks(stream: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(sample offset, byte offset of the frame, samples as (channels, n)) of each frame of any stream, in order; checksums verified."""
    info, at = read_head(stream)
    offset = 0
    while at < len(stream):
        if stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
            raise FlacError("no frame sync")
        b = _Bits(stream, at + 2)
        size_code, rate_code, channel, depth = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        lead = b.take(8)
        more = 0
        while lead & (0x80 >> more):
            more += 1
        for _ in range(max(0, more - 1)):
            b.take(8)
        if size_code in (6, 7):
            block = b.take(8 if size_code == 6 else 16) + 1
        else:
            block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code in (2, 3, 4, 5) else 256 << max(0, size_code - 8)
        if rate_code in (12, 13, 14):
            b.take(8 if rate_code == 12 else 16)
        if crc8(stream[at : b.pos >> 3]) != b.take(8):
            raise FlacError("header checksum")
        bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
        channels = channel + 1 if channel < 8 else 2
        rows = [_subframe(b, block, bits + (channel in (8, 10) and c == 1 or channel == 9 and c == 0)) for c in range(channels)]
        x = np.array(rows, np.int64)
        if channel == 8:
            x[1] = x[0] - x[1]
        elif channel == 9:
            x[0] = x[0] + x[1]
        elif channel == 10:
            mid = (x[0] << 1) | (x[1] & 1)
            x[0], x[1] = (mid + x[1]) >> 1, (mid - x[1]) >> 1
        stop = (b.pos + 7) >> 3
        if crc16(stream[at:stop]) != int.from_bytes(stream[stop : stop + 2], "big"):
            raise FlacError("frame checksum")
        yield offset, at, x
        offset, at = offset + block, stop + 2
    if info["samples"] and offset != info["samples"]:
        raise FlacError("samples missing")


def decode(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(samples of a mono stream, byte offset of each frame), checksums and MD5 verified."""
    info, at = read_head(stream)
    out = starts = None
    if (info["block"], info["fixed"], info["channels"], info["bits"]) == (BLOCK, True, 1, 8) and info["samples"] % BLOCK == 0:
        data = np.frombuffer(stream, np.uint8)[at:]
        n = info["samples"] // BLOCK
        starts = find_frames(data, n)
        if starts is not None:
            ends = np.concatenate([starts[1:], [len(data)]])
            head_len = frame_heads(np.arange(n))[1]
            got = [decode_frames(data, starts[i : i + CHUNK], ends[i : i + CHUNK], head_len[i : i + CHUNK]) for i in range(0, n, CHUNK)]
            out = None if any(g is None for g in got) else np.concatenate(got).ravel()
            starts = starts + at
    if out is None:
        blocks = list(decode_blocks(stream))
        out = np.concatenate([x[0] for _, _, x in blocks]) if blocks else np.zeros(0, np.int64)
        starts = np.array([b for _, b, _ in blocks])
    if info["bits"] == 8 and info["channels"] == 1 and info["md5"] != hashlib.md5(out.astype(np.int8)).digest():
        raise FlacError("MD5 of the samples")
    return out, starts


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of many streams."""
    return [x for x, _ in decode_with_offsets(streams)]


def decode_with_offsets(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(samples, byte offset of each frame) of many streams; the frames of all streams that encode_many() can write are decoded together."""
    infos = [read_head(s) for s in streams]
    easy, data, starts, ends, heads, counts = [], [], [], [], [], []
    base, places = 0, {}
    for i, (s, (info, at)) in enumerate(zip(streams, infos, strict=True)):
        if (info["block"], info["fixed"], info["channels"], info["bits"]) == (BLOCK, True, 1, 8) and info["samples"] and info["samples"] % BLOCK == 0:
            d = np.frombuffer(s, np.uint8)[at:]
            f = find_frames(d, info["samples"] // BLOCK)
            if f is not None:
                easy.append(i)
                data.append(d)
                places[i] = f + at
                starts.append(f + base)
                ends.append(np.append(f[1:], len(d)) + base)
                heads.append(frame_heads(np.arange(len(f)))[1])
                counts.append(len(f))
                base += len(d)
    out: list = [None] * len(streams)
    if easy:
        all_data, s, e, h = (np.concatenate(x) for x in (data, starts, ends, heads))
        got = [decode_frames(all_data, s[i : i + CHUNK], e[i : i + CHUNK], h[i : i + CHUNK]) for i in range(0, len(s), CHUNK)]
        if not any(g is None for g in got):
            frames = np.concatenate(got)
            at = np.concatenate([[0], np.cumsum(counts)])
            for j, i in enumerate(easy):
                out[i] = frames[at[j] : at[j + 1]].ravel()
                if infos[i][0]["md5"] != hashlib.md5(out[i].astype(np.int8)).digest():
                    raise FlacError("MD5 of the samples")
    return [decode(s) if x is None else (x, places[i]) for i, (s, x) in enumerate(zip(streams, out, strict=True))]


def padded(raw: np.ndarray) -> np.ndarray:
    """raw with spaces appended up to a positive multiple of 192."""
    n = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return np.concatenate([raw, np.full(n - len(raw), 32, np.uint8)])


#: Samples of a PCM block of stored streams: a whole number of frames.
SAMPLES = BLOCK * 256
_PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, block int, sample_offset long, byte_offset long, n_samples long, last boolean, pcm binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, seek string"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded with spaces to a multiple of 192, as a FLAC stream; n_bytes is the unpadded length.

    Null and empty texts are 192 spaces. Long texts are coded in parts of CHUNK frames. Repeated rows
    are stored each, an empty table gives an empty table, other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_spans(batch.column(1))
            for lo, hi in pieces(at, CHUNK * BLOCK):
                media = encode_many([padded(raw[at[i] : at[i + 1]]) for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(at[lo : hi + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return narrow(docs, doc_id=F.col(doc_id).cast("long"), text=text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_blocks(media: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_bytes, media) as stored -> PCM blocks of up to `samples` samples (whole frames), stream by stream and block by block.

    sample_offset and byte_offset are where a block begins in the samples and, by its first frame, in the
    stream: to seek, a reader takes the block before a sample and decodes from its byte. Every frame's
    checksum and the stream's are verified. pcm: signed 8-bit samples. last marks a stream's last block.
    """
    names = [c.split()[0] for c in _PCM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [m.as_py() for m in batch.column(2)]
            ends = np.cumsum([0] + [len(m) for m in streams])
            for lo, hi in pieces(ends, CHUNK * BLOCK):
                rows, at = [], []
                for i, (m, (x, frames)) in enumerate(zip(streams[lo:hi], decode_with_offsets(streams[lo:hi]), strict=True), lo):
                    sha = hashlib.sha256(m).hexdigest()
                    for k, first in enumerate(range(0, len(x), samples)):
                        part = x[first : first + samples]
                        rows.append((len(m), sha, k, first, int(frames[first // BLOCK]), len(part), first + len(part) == len(x), part.astype(np.int8).tobytes()))
                        at.append(i)
                at = pa.array(at, pa.int32())
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _PCM)


class Summary:
    """What a stream's samples say, block after block."""

    def __init__(self) -> None:
        self.sha, self.tail, self.seek = hashlib.sha256(), b"", []
        self.n = self.total = self.square = self.peak = self.crossings = 0
        self.sign: bool | None = None

    def add(self, x: np.ndarray, sample_offset: int, byte_offset: int) -> None:
        raw = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(raw)
        self.tail = (self.tail + raw)[-16:]
        self.seek.append(f"{sample_offset}:{byte_offset}")
        sign = x >= 0
        self.crossings += int((sign[1:] != sign[:-1]).sum()) + (self.sign is not None and bool(sign[0]) != self.sign)
        self.sign = bool(sign[-1])
        self.n, self.total, self.square = self.n + len(x), self.total + int(x.sum()), self.square + int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))

    def feature(self) -> str:
        return f"n={self.n};mean={self.total / self.n:.4f};rms={np.sqrt(self.square / self.n):.4f};peak={self.peak};zc={self.crossings}"


def describe(blocks: DataFrame) -> DataFrame:
    """PCM blocks of stored_blocks(), in their order -> DIGEST, a row a stream: sums go on from block to block, and a stream may go on in the next batch. seek lists sample and byte offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Summary()
        for batch in batches:
            rows, at = [], []
            sample, byte, last = (batch.column(c).to_pylist() for c in ("sample_offset", "byte_offset", "last"))
            for i, pcm in enumerate(batch.column("pcm")):
                now.add(np.frombuffer(pcm.as_buffer(), np.int8).astype(np.int64), sample[i], byte[i])
                if last[i]:
                    rows.append((now.n, now.sha.hexdigest(), zlib.crc32(now.tail), now.feature(), len(now.seek), ",".join(now.seek)))
                    at.append(i)
                    now = Summary()
            at = pa.array(at, pa.int32())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            size, sha, tail, told, n, seek = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True))
            held = [batch.column(c).take(at) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")]
            yield pa.RecordBatch.from_arrays([held[0], held[1], size, sha, tail, held[2], held[3], told, n, seek], names=[c.split()[0] for c in DIGEST.split(", ")])

    return blocks.mapInArrow(run, DIGEST)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its text stored as a FLAC stream in a table of the shared folder, read back from there, and described. Edge cases are those of store()."""
    return describe(stored_blocks(cut(store(docs, doc_id, text))))


def pcm_blocks(streams: DataFrame, key: str = "doc_id", media: str = "media", samples: int = 4096) -> DataFrame:
    """(key, media) -> one row per PCM block of about `samples` samples: block, sample_offset, byte_offset of its first frame, n_samples, pcm.

    pcm holds little-endian signed samples, interleaved for several channels. A null stream gives no
    block; a broken one raises FlacError.
    """
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                width = np.int8 if read_head(m)[0]["bits"] <= 8 else np.int16 if read_head(m)[0]["bits"] <= 16 else np.int32
                rows, held, n, first = [], [], 0, None
                for offset, at, x in decode_blocks(m):
                    first = (offset, at) if first is None else first
                    held.append(x.T)
                    n += x.shape[1]
                    if n >= samples:
                        rows.append((*first, n, np.concatenate(held).astype(width).tobytes()))
                        held, n, first = [], 0, None
                if held:
                    rows.append((*first, n, np.concatenate(held).astype(width).tobytes()))
                if rows:
                    a, b, c, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=[key, "block", "sample_offset", "byte_offset", "n_samples", "pcm"])

    return narrow(streams, **{key: key, media: media}).mapInArrow(run, f"`{key}` {kind}, block int, sample_offset long, byte_offset long, n_samples long, pcm binary")


def encode_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media) of store()."""
    return store(docs, doc_id, text).select("doc_id", "media")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
