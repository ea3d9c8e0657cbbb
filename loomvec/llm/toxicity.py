"""Toxicity by a weighted finite-state grammar.

Five weighted transducers read a clause as a tape of word classes: insults and threats turn words into
heads, negation and reported speech mark the heads in their reach and weaken them, targets tell aimed
clauses from others. compose() makes one machine of the five, weights multiplied along a path; the
best path of a clause gives each head its marks and its factor. A threat is a head only with a target
behind it. A document's score adds up the heads that its clauses matched, each with the factor of its
clause, so a word alone counts less than a clause that turns it on somebody, and hardly at all where
it is denied or quoted.

Besides its own words, the insult transducer has arcs that are learned from labelled rows: words and
word beginnings that tell toxic rows from clean ones. Their weights are learned from the clauses that
the composed machine matches in those rows, by how many matches a text has. Words that no label
supports need an aimed clause or several clauses, and count less the longer the text around them is.

Learning reads a bounded sample of labelled rows (MOST_TOXIC and MOST_CLEAN, by a hash of the id, one
row an id); scoring reads every text. Rows with crc32(doc_id) mod 4 = 2 are held out: their labels
aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, narrow, read_table

#: The bounds of the sample that arcs are learned from.
MOST_TOXIC, MOST_CLEAN = 4096, 8192
#: Candidate arcs, learned arcs, the least number of toxic rows and the least likelihood ratio of an arc.
CANDIDATES, ARCS, LEAST_ROWS, LEAST_RATIO = 3000, 200, 3, 15.0
#: Lengths of word beginnings.
SHORTEST, LONGEST = 3, 10
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile filth vermin dumbass bastard idiota imbécil estúpido estúpida basura idiote imbécile crétin ordure salaud dummkopf abschaum arschloch trottel".split()
THREATS = "kill hurt destroy smash murder beat stab shoot burn matar töten tuer schlagen".split()
TARGETS = "you your yours yourself u he she they them him her these those people everyone du dich dir ihr euch sie tu te toi vous ils elles tú ti vosotros ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't cannot can't nobody nicht kein keine nie pas jamais ne nunca ni tampoco".split()
REPORTS = "said says say wrote writes called calls quoted quote reported claims claimed told according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
#: How far negation reaches, and within how many words a threat's target follows it.
REACH, OBJECT = 3, 3
#: Factors of a head that is denied, quoted, learned or of the grammar's own in a clause without a target; of a threat verb that isn't a threat.
DENIED, QUOTED, UNAIMED, UNAIMED_OWN, NO_THREAT = 0.1, 0.15, 0.8, 0.3, 0.01
#: From this factor on a head counts as a place. One clause with the grammar's own words in so many carries their whole weight.
PLACE, DENSITY = 0.5, 60

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Weights (log odds) of an insult or threat of the grammar's own, by how often it stands in a text.
OWN = (3.5, 4.5, 5.5)


@dataclass(frozen=True)
class Model:
    """Learned arcs: pattern -> weights for one, two, three and more places; bias without any arc, prior with some."""

    arcs: dict[str, tuple[float, float, float]]
    bias: float
    prior: float


@dataclass
class Transducer:
    """Arcs state -> symbol -> [(output, weight, next state)], and final states; a path's weight is the product of its arcs'."""

    arcs: dict[int, dict[str, list[tuple[str, float, int]]]] = field(default_factory=dict)
    final: set[int] = field(default_factory=lambda: {0})

    def add(self, state: int, symbol: str, output: str, weight: float, after: int) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((output, weight, after))

    def best(self, tape: list[str]) -> list[tuple[str, float]]:
        """The outputs and weights along the best path that ends in a final state; nothing if there is none."""
        here: dict[int, float] = {0: 1.0}
        back: list[dict[int, tuple[int, str, float]]] = []
        for symbol in tape:
            there: dict[int, float] = {}
            step: dict[int, tuple[int, str, float]] = {}
            for state, w in here.items():
                for output, x, after in self.arcs.get(state, {}).get(symbol, ()):
                    if w * x > there.get(after, -1.0):
                        there[after], step[after] = w * x, (state, output, x)
            back.append(step)
            here = there
        ends = [s for s in here if s in self.final]
        if not ends:
            return []
        state, out = max(ends, key=lambda s: (here[s], -s)), []
        for step in reversed(back):
            state, output, x = step[state]
            out.append((output, x))
        return out[::-1]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what a reads and gives what b makes of a's output; states are those pairs that the start reaches."""
    names, todo, out = {(0, 0): 0}, [(0, 0)], Transducer(final=set())
    while todo:
        p, q = todo.pop()
        here = names[p, q]
        if p in a.final and q in b.final:
            out.final.add(here)
        for symbol, arcs in a.arcs.get(p, {}).items():
            for middle, w, p2 in arcs:
                for output, x, q2 in b.arcs.get(q, {}).get(middle, ()):
                    if (p2, q2) not in names:
                        names[p2, q2] = len(names)
                        todo.append((p2, q2))
                    out.add(here, symbol, output, w * x, names[p2, q2])
    return out


#: The tape: other words, negations, reports, targets; learned insults, the grammar's own, threat verbs.
PLAIN, LEARNED, OWN_WORD, THREAT = "onry", "a", "i", "t"
#: Heads and their marks as the transducers give them: A and I for insults, T for threats, then d and q.
_HEADS = [h + d + q for h in "AIT" for d in ("", "d") for q in ("", "q")]


def insults() -> Transducer:
    t = Transducer()
    for s in PLAIN + THREAT:
        t.add(0, s, s, 1.0, 0)
    t.add(0, LEARNED, "A", 1.0, 0)
    t.add(0, OWN_WORD, "I", 1.0, 0)
    return t


def threats() -> Transducer:
    """A threat verb is a head if a target follows within OBJECT words; states 1 to OBJECT wait for it."""
    t = Transducer()
    for state in range(OBJECT + 1):
        for s in [*PLAIN, "A", "I"]:
            if state == 0 or s == "y":
                t.add(state, s, s, 1.0, 0)
            elif state > 1:
                t.add(state, s, s, 1.0, state - 1)
        if state != 1:  # in state 1 the target has to come now
            t.add(state, THREAT, "T", 1.0, state - 1 if state else OBJECT)
            t.add(state, THREAT, "o", NO_THREAT, max(0, state - 1))
    return t


def negation(factor: float = DENIED) -> Transducer:
    """Heads up to REACH words behind a negation are denied; the state is how far the last one still reaches."""
    t = Transducer(final=set(range(REACH + 1)))
    for state in range(REACH + 1):
        for s in "ory":
            t.add(state, s, s, 1.0, max(0, state - 1))
        t.add(state, "n", "n", 1.0, REACH)
        for h in "AIT":
            t.add(state, h, h + "d" if state else h, factor if state else 1.0, max(0, state - 1))
    return t


def reported(factor: float = QUOTED) -> Transducer:
    """Heads behind a word of reporting are quoted, to the end of the clause."""
    t = Transducer(final={0, 1})
    for state in (0, 1):
        for s in "ony":
            t.add(state, s, s, 1.0, state)
        t.add(state, "r", "r", 1.0, 1)
        for h in _HEADS:
            if not h.endswith("q"):
                t.add(state, h, h + "q" if state else h, factor if state else 1.0, state)
    return t


def targets(learned: float = UNAIMED, own: float = UNAIMED_OWN) -> Transducer:
    """Aimed clauses hold a target anywhere: state 1 waits for it, 2 has it, 3 goes without, at a lower weight of insults."""
    t = Transducer(final={0, 2, 3})
    for state in range(4):
        for s in [*PLAIN, *_HEADS]:
            if state in (0, 1, 2):
                t.add(state, s, s, 1.0, 2 if state == 2 or s == "y" else 1)
            if state in (0, 3):
                t.add(state, s, s, {"A": learned, "I": own}.get(s[0], 1.0), 3)
    return t


def grammar(without: tuple[str, ...] = ()) -> Transducer:
    """The composition of the five. `without` names transducers that pass everything through unweakened, to see what they do."""
    parts = [insults(), threats(), negation(1.0 if "negation" in without else DENIED), reported(1.0 if "reported" in without else QUOTED), targets(*((1.0, 1.0) if "targets" in without else ()))]
    out = parts[0]
    for p in parts[1:]:
        out = compose(out, p)
    return out


class Grammar:
    """The composed machine over a lexicon. A pattern that ends with $ is a whole word, else a word's beginning."""

    def __init__(self, model: Model, without: tuple[str, ...] = ()) -> None:
        self.model, self.machine = model, grammar(without)
        self.weights = {f"{w}$": OWN for w in INSULTS + THREATS} | model.arcs
        self.classes = dict.fromkeys(TARGETS, "y") | dict.fromkeys(REPORTS, "r") | dict.fromkeys(NEGATIONS, "n")
        self.threats = frozenset(f"{w}$" for w in THREATS)
        self.lexicon = ahocorasick.Automaton()
        for p in self.weights:
            word = p.removesuffix("$")
            known = self.lexicon.get(word, ())
            self.lexicon.add_word(word, (*known, p))
        self.lexicon.make_automaton()

    def hits(self, low: str) -> list[tuple[int, str]]:
        """(start, pattern) of the heads in a lower-cased text; of several at one word, the longest."""
        out: dict[int, str] = {}
        for end, patterns in self.lexicon.iter(low):
            for p in patterns:
                whole = p.endswith("$")
                start = end + 1 - len(p) + whole
                if start and (low[start - 1].isalpha() or low[start - 1] == "'"):
                    continue
                if whole and end + 1 < len(low) and low[end + 1].isalpha():
                    continue
                if start not in out or len(p) >= len(out[start]):
                    out[start] = p
        return sorted(out.items())

    def symbol(self, pattern: str) -> str:
        return LEARNED if pattern in self.model.arcs else THREAT if pattern in self.threats else OWN_WORD

    def clause(self, words: list[str], heads: dict[int, str]) -> list[tuple[str, str, float]]:
        """(pattern, marked head, factor) of the heads of one clause along the machine's best path."""
        tape = [self.symbol(heads[i]) if i in heads else self.classes.get(w, "o") for i, w in enumerate(words)]
        return [(heads[i], mark, x) for i, (mark, x) in enumerate(self.machine.best(tape)) if i in heads and mark[0] in "AIT"]

    def matches(self, text: str) -> tuple[list[tuple[str, str, float]], int]:
        """The matched heads of all clauses of a text, and its number of clauses."""
        low = text.lower()
        hits = self.hits(low)
        if not hits:
            return [], 0
        out: list[tuple[str, str, float]] = []
        ends = [m.start() for m in _CLAUSE.finditer(low)] + [len(low)]
        edge, at, begin = 0, 0, 0
        while at < len(hits):
            while ends[edge] <= hits[at][0]:
                begin = ends[edge]
                edge += 1
            here = []
            while at < len(hits) and hits[at][0] < ends[edge]:
                here.append(hits[at])
                at += 1
            spans = [(m.start() + begin, m.group()) for m in _WORD.finditer(low[begin : ends[edge]])]
            starts = {s: i for i, (s, _) in enumerate(spans)}
            out += self.clause([w for _, w in spans], {starts[s]: p for s, p in here if s in starts})
        return out, len(ends)

    def strengths(self, text: str) -> dict[str, tuple[int, float]]:
        """pattern -> (places that count, factor). Plain heads add up to a factor of 1; denied and quoted ones count by the best of them."""
        found, clauses = self.matches(text)
        out: dict[str, list[float]] = {}
        for p, mark, x in found:
            r = out.setdefault(p, [0, 0.0, 0.0])
            r[0] += x >= PLACE
            if len(mark) == 1:
                r[1] += x
            else:
                r[2] = max(r[2], x)
        own = sum(r[1] for p, r in out.items() if p not in self.model.arcs)
        thin = min(1.0, DENSITY * max(own, 1.0) / max(1, clauses))
        return {p: (int(n), max(min(1.0, plain), weak) * (1.0 if p in self.model.arcs else thin)) for p, (n, plain, weak) in out.items()}

    def score(self, text: str | None) -> float:
        found = self.strengths(text or "")
        total = self.model.prior + sum(self.weights[p][min(2, max(0, n - 1))] * x for p, (n, x) in found.items())
        logit = max(total, self.model.bias) if found else self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out.add(w[:k])
    return out


def ratio(a: int, c: int, n1: int, n0: int) -> float:
    """Likelihood ratio (G) of a being more frequent among n1 than c among n0; 0 if it isn't."""
    if not n1 or not n0 or a * n0 <= c * n1:
        return 0.0

    def like(k: int, n: int, q: float) -> float:
        return (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)

    q = (a + c) / (n1 + n0)
    return 2 * (like(a, n1, a / n1) + like(c, n0, c / n0) - like(a, n1, q) - like(c, n0, q))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """The arcs, from labelled rows that aren't held out. Without any labelled row the grammar has its own words only."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1_all, n0_all = totals.get(1, 0), totals.get(0, 0)
    prior = math.log((n1_all + 0.5) / (n0_all + 0.5)) if n1_all + n0_all else -2.0
    if not n1_all or not n0_all:
        return Model({}, min(prior, -4.0), min(prior, -2.0))
    order = F.xxhash64("doc_id")
    # Two limits bound the sample, so it can be sent to every task. One row an id: repeated ids would outweigh the others.
    sample = known.where("y = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(most_clean))
    rows = narrow(docs, id=F.col("doc_id"), text=F.coalesce(F.col("text"), F.lit(""))).join(F.broadcast(sample), F.col("id") == F.col("doc_id"))
    rows = cut(rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            names = [*held[0].keys() | held[1].keys()]
            out = pd.DataFrame({"feature": names, "a": [held[1][f] for f in names], "c": [held[0][f] for f in names]})
            held[0].clear()
            held[1].clear()
            return out

        for f in frames:
            for t, y in zip(f["text"], f["y"], strict=True):
                held[y].update(features(t))
                if len(held[0]) + len(held[1]) > 200_000:
                    yield flush()
        if held[0] or held[1]:
            yield flush()

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    a, c = F.col("a"), F.col("c")
    counted = rows.repartition(spread(rows)).mapInPandas(count, "feature string, a long, c long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where((a >= LEAST_ROWS) & (a * F.lit(n0) > 4 * c * F.lit(n1)))
    gain = a * F.log((a + 0.0) * (n1 + n0) / ((a + c) * F.lit(float(max(1, n1)))))
    found = [r["feature"] for r in counted.orderBy(gain.desc(), "feature").limit(CANDIDATES).collect()]
    place = {f: i for i, f in enumerate(found)}

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, y in zip(f["text"], f["y"], strict=True):
                out.append((y, [place[p] for p in features(t) if p in place]))
            yield pd.DataFrame(out, columns=["y", "at"])

    seen = rows.mapInPandas(match, "y int, at array<int>").toPandas() if found else pd.DataFrame({"y": [], "at": []})
    chosen, left = choose(found, [int(y) for y in seen["y"]], [np.asarray(a, np.int64) for a in seen["at"]])
    bare = Model(dict.fromkeys(chosen, OWN), -4.0, prior)

    def clauses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Grammar(bare)
        for f in frames:
            out = []
            for t, y in zip(f["text"], f["y"], strict=True):
                n = {p: k for p, (k, _) in machine.strengths(t).items() if k}
                out.append((y, list(n), [min(3, k) for k in n.values()]))
            yield pd.DataFrame(out, columns=["y", "arcs", "n"])

    # What the weights are learned from: how often the composed machine matches each arc, by label. One row for each of these.
    pairs = rows.mapInPandas(clauses, "y int, arcs array<string>, n array<int>").select("y", F.explode(F.arrays_zip("arcs", "n")).alias("p"))
    table = {(r["arcs"], r["n"], r["y"]): r["m"] for r in pairs.groupBy("p.arcs", "p.n", "y").agg(F.count("*").alias("m")).collect()} if chosen else {}
    return weigh(chosen, table, left, prior, (n1, n0))


def spread(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def choose(found: list[str], ys: list[int], places: list[np.ndarray]) -> tuple[list[str], tuple[int, int]]:
    """Chooses arcs one by one: each time the pattern that best tells the rows apart that no arc matches yet. Also the toxic and clean rows without any.

    places: the numbers in found of the patterns that each row holds."""
    own = {f"{w}$" for w in INSULTS}
    y = np.array(ys, np.int8)
    row = np.repeat(np.arange(len(places)), [len(a) for a in places]).astype(np.int64)
    col = np.concatenate(places) if len(places) else np.zeros(0, np.int64)
    alive = np.ones(len(y), bool)
    chosen = [i for i, f in enumerate(found) if f in own]
    alive[row[np.isin(col, chosen)]] = False
    for _ in range(ARCS):
        n1, n0 = int((alive & (y == 1)).sum()), int((alive & (y == 0)).sum())
        here = alive[row]
        a = np.bincount(col[here & (y[row] == 1)], minlength=len(found))
        c = np.bincount(col[here & (y[row] == 0)], minlength=len(found))
        best = max(((ratio(int(a[i]), int(c[i]), n1, n0), len(found[i]), -i) for i in np.flatnonzero(a >= LEAST_ROWS)), default=(0.0, 0, 0))
        if best[0] < LEAST_RATIO:
            break
        i = -best[2]
        chosen.append(i)
        alive[row[col == i]] = False
    return [found[i] for i in chosen], (int((alive & (y == 1)).sum()), int((alive & (y == 0)).sum()))


def weigh(chosen: list[str], table: dict[tuple[str, int, int], int], left: tuple[int, int], prior: float, n: tuple[int, int]) -> Model:
    """Weights (log odds) of the arcs for one, two, three and more matched places; table: (arc, places, label) -> rows. left: rows without any arc."""
    own = {f"{w}$" for w in INSULTS}
    n1, n0 = n
    arcs = {}
    for p in chosen:
        weights, floor = [], 0.0
        for level in (1, 2, 3):
            a, c = table.get((p, level, 1), 0), table.get((p, level, 0), 0)
            w = math.log(((a + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1)))
            floor = max(floor, w) if a + c else floor
            weights.append(floor)
        if p in own:
            weights = [max(w, o) for w, o in zip(weights, OWN, strict=True)]
        arcs[p] = tuple(weights)
    bias = math.log((left[0] + 0.5) / (left[1] + 0.5)) if sum(n) else prior
    # The sample may hold more toxic rows than the table; the bias is carried over to the table's share.
    bias += prior - math.log((n1 + 0.5) / (n0 + 0.5))
    return Model(arcs, min(bias, -1.5), prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts get the score of a text without any arc.

    Repeated rows are scored each and alike, texts of any length are scored whole, a score of exactly
    THRESHOLD is predicted 1, an empty table gives an empty table, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for b in batches:
            s = pa.array([grammar.score(t.as_py()) for t in b.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], names=["doc_id", "held_out", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    t = narrow(docs, doc_id=doc_id, held_out=held_out(F.col(doc_id)), text=text).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return t.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the grammar doesn't reject, with their columns as they are. Null and empty texts stay; repeated rows stay or go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for b in batches:
            yield b.filter(pa.array([grammar.score(t.as_py()) < THRESHOLD for t in b.column(b.schema.get_field_index(text))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, read_table(spark, sf_dir, "labels")))
