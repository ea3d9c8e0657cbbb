"""Personal data in texts, disguises included, with spans in the source text.

Three transducers normalise a text one after the other: letters and digits that only look like ASCII
(and characters without width), spelled "at" and "dot" (bracketed or bare), and digits spelled as words
in four languages. Each is a finite-state pattern whose matches have an output; what it rewrote is kept
as a short list of edits, so a span of its output is mapped back to the characters that it came from.

Identifiers are detected in the source text (base spans, always reported) and in the normalised text.
What the second finds is reported too if a rewritten place is in it and no base span of its kind
overlaps it. All detectors run in time linear in the text, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import narrow, private, read_table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
Edit = tuple[int, int, str]

# Characters that look like an ASCII one and that Unicode doesn't fold to it, and the words of disguises.
LOOKALIKES = dict(zip("аесорхуіјѕԁԛԝһАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρ‐‑‒–—−∙․", "aecopxyijsdqwhABEKMHOPCTXYIJSABEZHIKMNOPTYXovaip------..", strict=True))
NO_WIDTH = "­​‌‍⁠﻿"
AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
DIGIT_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "fuenf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
TIMES = {"double": 2, "triple": 3}
#: After a bare "at", "x at y dot z" is an address only if z is one of these; top domains that are small words of English aren't here.
BARE_TOPS = frozenset("com org net edu gov mil info biz io dev app ai co uk de fr es nl ch eu ca au jp cn ru br pl se fi dk pt mx ar cl".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> list[Span]:
    """From each @ to both sides: what stands before it is one run, whose every start would lead to the same @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    """Whole sequences of dotted numbers, four numbers at a time."""
    out = []
    for m in _DOTTED.finditer(text) if "." in text else ():
        if m.end() - m.start() < 7:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            # An int() of thousands of digits is an error: leading zeros go first.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def cards(text: str) -> list[Span]:
    found = [(m.span(), _NO_DIGIT.sub("", m.group())) for m in _CARD.finditer(text) if m.end() - m.start() >= 14]
    return [span for span, digits in found if 14 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """The spans of each kind: leftmost, not overlapping; a match that fails its condition isn't tried again."""
    digits = _NUMBER.search(text)
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits and "+" in text else []}


class Rewritten:
    """The output of a transducer over a text, and where its parts came from."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, at, size = [], 0, 0
        self.first, self.last, self.edits = [], [], edits
        for start, end, out in edits:
            parts += [text[at:start], out]
            size += start - at
            self.first.append(size)
            size += len(out)
            self.last.append(size)
            at = end
        self.text = "".join([*parts, text[at:]])

    def source(self, span: Span) -> tuple[Span, bool]:
        """The characters of the input that a span of the output came from, and whether any of them was rewritten."""
        start, end = span
        i, j = bisect_right(self.first, start) - 1, bisect_right(self.first, end - 1) - 1
        touched = j > i
        if i >= 0 and start < self.last[i]:
            start, touched = self.edits[i][0], True
        else:
            start += self.edits[i][1] - self.last[i] if i >= 0 else 0
        if j >= 0 and end <= self.last[j]:
            end = self.edits[j][1]
        else:
            end += self.edits[j][1] - self.last[j] if j >= 0 else 0
        return (start, end), touched


def _looks() -> dict[str, str]:
    """By rule: what Unicode folds to one ASCII character, and digits of all scripts."""
    out = {}
    for c in map(chr, [*range(0x2000, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x660, 0xE60), 0xA0]):
        folded, digit = unicodedata.normalize("NFKC", c), unicodedata.digit(c, None)
        if digit is not None:
            out[c] = str(digit)
        elif len(folded) == 1 and " " <= folded <= "~":
            out[c] = folded
    return out | LOOKALIKES | dict.fromkeys(NO_WIDTH, "")


_LOOKS = _looks()
#: A range that holds them all is searched much faster than the set.
_LOOK = re.compile("[\xa0\xad\u0370-\U0010ffff]")


def plain_letters(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), _LOOKS[m.group()]) for m in _LOOK.finditer(text) if m.group() in _LOOKS]


_ANY_AT, _ANY_DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_MARK = re.compile(rf"[\[({{<] ?(?:(?P<at>{_ANY_AT}|@)|(?P<dot>{_ANY_DOT}|\.)) ?[\])}}>] {{0,2}}|(?<=[A-Za-z0-9._%+-]) {{1,2}}(?:(?P<bare>{_ANY_AT})|(?P<sign>@)|(?P<word>{_ANY_DOT})) {{1,2}}(?=[A-Za-z0-9])", re.IGNORECASE | re.ASCII)
#: After a bare "at": a label and a disguised dot, else it is a word like any other.
_THEN_DOT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?: {{0,2}}[\[({{<] ?(?:{_ANY_DOT}|\.) ?[\])}}>] {{0,2}}| {{1,2}}(?:{_ANY_DOT}) {{1,2}})[A-Za-z0-9]", re.IGNORECASE | re.ASCII)
_SIGNS = (*DOT_WORDS, "[", "(", "{", "<", " @ ", " @  ")


def at_and_dot(text: str) -> list[Edit]:
    low = text.lower()
    if not any(s in low for s in _SIGNS):
        return []
    out = []
    for m in _MARK.finditer(text):
        if m["bare"] and not _THEN_DOT.match(text, m.end()):
            continue
        start = m.start()
        while text[start] != " " and start and text[start - 1] == " " and m.start() - start < 2:
            start -= 1
        start = max(start, out[-1][1]) if out else start
        out.append((start, m.end(), "." if m["dot"] or m["word"] else "@"))
    return out


_DIGITS = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
#: Texts with none of these are passed over: the words of a text are looked up as bytes. The French article doesn't count by itself.
_TELLING = frozenset(w.encode() for w in _DIGITS if w != "un")
_AS_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ANY_DIGIT = "|".join(sorted(_DIGITS, key=len, reverse=True))
_ONE = rf"(?:(?:{'|'.join(TIMES)}) )?(?:{_ANY_DIGIT})(?![^\W_])"
_RUN = re.compile(rf"(?<![^\W_])(?:(?P<plus>plus) (?=[0-9(]|{_ONE})|(?P<run>{_ONE}(?:[ ,-]{{1,2}}{_ONE})*))", re.IGNORECASE)
_IN_RUN = re.compile(rf"(?:({'|'.join(TIMES)}) )?({_ANY_DIGIT})(?![^\W_])", re.IGNORECASE)


def spelled_digits(text: str) -> list[Edit]:
    out = []
    if _TELLING.isdisjoint(text.lower().encode("utf-8", "surrogatepass").translate(_AS_WORDS).split()):
        return out
    for m in _RUN.finditer(text):
        # A letter that only folds to one of a word's isn't in the table; such a word stays as it is.
        digits = [_DIGITS.get(w.lower(), "") * TIMES.get(n.lower(), 1) for n, w in _IN_RUN.findall(m["run"] or "")]
        if m["plus"] or all(digits):
            out.append((m.start(), m.end(), "+" if m["plus"] else "".join(digits)))
    return out


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (plain_letters, at_and_dot, spelled_digits)
_TOP_LABEL = re.compile(r"\.([A-Za-z]{2,24})$")
_BARE_AT = re.compile(rf" (?:{_ANY_AT}) ", re.IGNORECASE | re.ASCII)


def is_address(value: str, source: str) -> bool:
    """Whether what a disguised address stands for ends in a top domain, a well-known one if its @ was a bare word."""
    top = _TOP_LABEL.search(value)
    return bool(top) and (not _BARE_AT.search(source) or top[1].lower() in BARE_TOPS)


def disguised(text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of what only the normalised text shows."""
    steps, now = [], text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    if not steps:
        return []
    out = []
    for kind, spans in detect(now).items():
        ends, starts = [e for _, e in base[kind]], [s for s, _ in base[kind]]
        for span in spans:
            value, any_touched = now[span[0] : span[1]], False
            for step in reversed(steps):
                span, touched = step.source(span)
                any_touched |= touched
            i = bisect_right(ends, span[0])  # the first base span that ends behind the start
            if any_touched and not (i < len(ends) and starts[i] < span[1]) and (kind != "email" or is_address(value, text[span[0] : span[1]])):
                out.append((kind, *span, value))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])


def spans_of(text: str) -> list[dict]:
    """All spans of a text by start and then by kind as in KINDS."""
    base = detect(text)
    found = [(s, KINDS.index(k), e, True, text[s:e]) for k, spans in base.items() for s, e in spans]
    found += [(s, KINDS.index(k), e, False, v) for k, s, e, v in disguised(text, base)]
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b, "value": v} for s, k, e, b, v in sorted(found)]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, row, spans) for each row of docs; spans is array<struct<kind, start, end, base, value>>.

    Positions are code points of the source, end exclusive; value is the identifier as it was read,
    normalised if it was disguised. row names a column that tells rows apart (the default is made here).
    Null and empty texts have no spans, texts of any length are scanned whole and in linear time,
    repeated rows are scanned each, a null doc_id stays null, an empty table gives an empty table, and
    other columns are ignored. There are no ties: two spans of one start differ in kind.
    """
    t = narrow(docs, doc_id=doc_id, row=F.col(row) if row else F.monotonically_increasing_id(), text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "row", "spans"])

    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, row long, spans array<struct<kind:string,start:int,end:int,base:boolean,value:string>>")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of overlapping spans the first one's.

    Columns and rows stay as they are; null and empty texts and texts without spans are unchanged.
    """
    names = docs.columns
    out = private(names, "masked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = b.schema.get_field_index(text), []
            for x in b.column(at):
                source, parts, end = x.as_py(), [], 0
                for s in spans_of(source or ""):
                    if s["start"] >= end:
                        parts += [source[end : s["start"]], f"[{s['kind'].upper()}]"]
                    end = max(end, s["end"])
                texts.append("".join([*parts, source[end:]]) if parts else source)
            yield b.append_column(out, pa.array(texts, pa.string()))

    masked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))
    return masked.select(*[F.col(out).alias(text) if c == text else F.col(f"`{c}`") for c in names])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scan(read_table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["base"]))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return t.select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
