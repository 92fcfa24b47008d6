"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech) by a lexicon of seed words and of
words and word beginnings learned from labels.  Five small weighted transducers read the symbols of a clause: one
accepts insults, one threats, one weighs the clause by its target, one marks what a negation covers, one what is reported
speech; their composition is one table with weights of its last states, run once over each clause that holds a word of
the lexicon.  A text's score is a logistic curve over the sum of its clauses' weights, not of isolated words.

Defined results: a null text counts as empty; a text without a matched clause has the curve's lowest score;
without labels the seed words and a default curve are used; labels of null or of documents that aren't there
are ignored; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import FIT_ROWS, labelled_sample

#: Seed words by symbol.
SEEDS = {
    "insult": "idiot idiots moron morons loser losers scum trash garbage worthless pathetic disgusting stupid clown imbecile scumbag".split(),
    "threat": "kill murder strangle stab shoot hurt destroy".split(),
    "target": "you your yours he she they him them his her their people everyone".split(),
    "negation": "not never no isn't aren't wasn't weren't don't doesn't without".split(),
    "report": "said says claimed claims wrote reported quoted called".split(),
}
SEED_WEIGHT = 3.0
#: A learned entry is in this many toxic texts in different contexts, has at least this balanced precision, and the
#: lexicon this many entries at most; beginnings of words have these lengths.
LEAST_CONTEXTS, PRECISION, MAX_ENTRIES, BEGINNINGS = 5, 0.97, 20_000, (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


# --- transducers ---------------------------------------------------------------------------------


@dataclass
class Transducer:
    """(state, symbol) -> (state, symbol); pairs that aren't listed keep state and symbol.  final: what a clause that
    ends in a state multiplies the weights of its insults and of its threats by; accepts: states in which it is matched."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]]
    final: dict[str, tuple[float, float]] = field(default_factory=dict)
    accepts: tuple[str, ...] = ()
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        self.states = tuple(dict.fromkeys([self.start, *[s for s, _ in self.arcs], *[s for s, _ in self.arcs.values()]]))

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "insult-denied", "threat-denied", "insult-told", "threat-told")
#: A clause with a target counts this much more; a threat without one counts this much only.
TARGETED, UNTARGETED_THREAT = 1.3, 0.15


def insult() -> Transducer:
    """Accepts a clause once it has an insult."""
    return Transducer("clean", {("clean", "insult"): ("insulting", "insult")}, accepts=("insulting",))


def threat() -> Transducer:
    """Accepts a clause once it has a threat."""
    return Transducer("calm", {("calm", "threat"): ("threatening", "threat")}, accepts=("threatening",))


def target() -> Transducer:
    """Weighs a clause by whether it is aimed at someone, before or after the words that it is matched by."""
    return Transducer("alone", {("alone", "target"): ("aimed", "target")}, {"alone": (1.0, UNTARGETED_THREAT), "aimed": (TARGETED, 1.0)})


def negation(reach: int = 3) -> Transducer:
    """Insults and threats within reach words after a negation are denied."""
    arcs = {}
    for left in range(reach + 1):
        here = f"n{left}"
        for symbol in SYMBOLS:
            then = f"n{reach}" if symbol == "negation" else f"n{max(0, left - 1)}"
            arcs[here, symbol] = (then, f"{symbol}-denied" if left and symbol in ("insult", "threat") else symbol)
    return Transducer("n0", arcs)


def reported() -> Transducer:
    """After a verb of saying, what follows in the clause is told, not said."""
    arcs = {("said", s): ("said", f"{s}-told") for s in ("insult", "threat")}
    return Transducer("own", arcs | {("own", "report"): ("said", "report")})


@dataclass
class Composition:
    """Machines one after the other, each reading what the one before writes."""

    start: int
    table: dict[tuple[int, str], tuple[int, str]]
    final: dict[int, tuple[float, float]]  # of the states in which a machine accepts

    @classmethod
    def of(cls, *machines: Transducer) -> Composition:
        states = {s: i for i, s in enumerate(product(*(m.states for m in machines)))}
        table, final = {}, {}
        for joint, i in states.items():
            for symbol in SYMBOLS:
                out, then = symbol, []
                for machine, state in zip(machines, joint, strict=True):
                    state, out = machine.step(state, out)
                    then.append(state)
                table[i, symbol] = (states[tuple(then)], out)
            if any(state in machine.accepts for machine, state in zip(machines, joint, strict=True)):
                factors = [machine.final.get(state, (1.0, 1.0)) for machine, state in zip(machines, joint, strict=True)]
                final[i] = (float(np.prod([f for f, _ in factors])), float(np.prod([g for _, g in factors])))
        return cls(states[tuple(m.start for m in machines)], table, final)


#: How much of a word's weight counts, by the symbol that leaves the composition.
SHARE = {"insult": 1.0, "threat": 0.6, "insult-denied": 0.5, "threat-denied": 0.1, "insult-told": 0.6, "threat-told": 0.1}
#: Insults and threats are seen before they are marked as denied or told.
GRAMMAR = Composition.of(insult(), threat(), target(), negation(), reported())


def clause_weight(symbols: list[tuple[str, float]]) -> float:
    """Weight of one path through the composition; 0 where it ends without being accepted."""
    state, sums = GRAMMAR.start, {"insult": 0.0, "threat": 0.0}
    table = GRAMMAR.table
    for symbol, weight in symbols:
        state, out = table[state, symbol]
        if out in SHARE:
            sums[out[:6]] += weight * SHARE[out]
    insults, threats = GRAMMAR.final.get(state, (0.0, 0.0))
    return sums["insult"] * insults + sums["threat"] * threats


# --- lexicon and scores --------------------------------------------------------------------------


@dataclass
class Grammar:
    words: dict[str, tuple[str, float]]
    beginnings: dict[str, float]  # of insults
    slope: float = 1.0
    bias: float = -2.5

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found is None:
            weight = max((self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS), default=0.0)
            found = ("insult", weight) if weight else ("other", 0.0)
        return found


def seeds() -> dict[str, tuple[str, float]]:
    return {w: (symbol, SEED_WEIGHT if symbol in ("insult", "threat") else 0.0) for symbol, words in SEEDS.items() for w in words}


class Scanner:
    """Finds clauses that hold an insult or a threat, and weighs them."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.machine = ahocorasick.Automaton()
        for word, (symbol, _) in grammar.words.items():
            if symbol in ("insult", "threat"):
                self.machine.add_word(word, len(word))
        for word in grammar.beginnings:
            self.machine.add_word(word, len(word))
        self.some = len(self.machine) > 0
        if self.some:
            self.machine.make_automaton()

    def clauses(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Begin, end and weight of each matched clause of a text."""
        low = text.lower()
        if len(low) != len(text):  # keep positions where lower case has another length
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        if not self.some:
            return
        done = 0
        for end, size in self.machine.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            before = max(low.rfind(c, done, at) for c in ".!?;:\n")
            after = _CLAUSE_END.search(low, end)
            begin, stop = before + 1 if before >= 0 else done, after.start() if after else len(low)
            weight = clause_weight([self.grammar.symbol(w) for w in _WORD.findall(low, begin, stop)])
            done = stop  # whatever it weighs, a clause is read once
            if weight:
                yield begin, stop, weight

    def weight(self, text: str) -> float:
        return sum(w for _, _, w in self.clauses(text))


def entry_counts(texts: DataFrame) -> DataFrame:
    """entry (a word, or a beginning and '*'), contexts: toxic texts with it, those where it has the same neighbours once;
    clean: clean texts with it.  Of its places in a text one speaks for all, so neither copies nor repetition count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: set[tuple[str, int]] = set()
            clean: Counter = Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall((text.as_py() or "").lower())
                if label:
                    padded = ["", *words, ""]
                    first: dict[str, int] = {}
                    for i, w in enumerate(words):
                        near = hash_text(f"{padded[i]} {padded[i + 2]}")
                        for entry in (w, *(f"{w[:n]}*" for n in BEGINNINGS if len(w) >= n)):
                            first[entry] = min(near, first.get(entry, near))
                    toxic.update(first.items())
                else:
                    distinct = set(words)
                    clean.update(distinct)
                    clean.update({f"{w[:n]}*" for w in distinct for n in BEGINNINGS if len(w) >= n})
            names = ["entry", "near", "clean"]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in toxic], pa.string()), pa.array([h for _, h in toxic], pa.int64()), pa.nulls(len(toxic), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.nulls(len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], names=names)

    rows = texts.select("text", "label").mapInArrow(run, "entry string, near long, clean long")
    by_context = rows.groupBy("entry", "near").agg(F.sum("clean").alias("clean"))
    return by_context.groupBy("entry").agg(F.count("near").alias("contexts"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """The lexicon and curve from at most about fit_rows labelled training documents."""
    from ._common import materialize

    sample = F.broadcast(labelled_sample(labels, "toxic", fit_rows))
    texts = materialize(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    grammar = Grammar(seeds(), {})
    n_toxic, n_clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not n_toxic or not n_clean:
        return grammar
    counts = entry_counts(texts).where(F.col("contexts") >= LEAST_CONTEXTS)
    precision = F.col("contexts") / (F.col("contexts") + F.col("clean") * (n_toxic / n_clean))
    rows = counts.withColumn("precision", precision).where(F.col("precision") >= PRECISION).orderBy(F.desc("precision"), F.desc("contexts"), "entry").limit(MAX_ENTRIES).collect()
    for r in rows:
        weight = float(min(4.0, np.log((r["contexts"] + 0.5) / (r["clean"] * n_toxic / n_clean + 0.5))))
        if r["entry"].endswith("*"):
            grammar.beginnings[r["entry"][:-1]] = weight
        elif r["entry"] not in grammar.words:
            grammar.words[r["entry"]] = ("insult", weight)
    weighed = weigh(texts, grammar, ["label"]).groupBy("label", F.round("weight", 1).alias("weight")).agg(F.count(F.lit(1)).alias("n")).orderBy("label", "weight").toPandas()
    grammar.slope, grammar.bias = _curve(np.log1p(weighed["weight"].to_numpy(float)), weighed["label"].to_numpy(float), weighed["n"].to_numpy(float))
    return grammar


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a ridge-regularised logistic curve, by Newton's method."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, -2.0])
    ridge = np.diag([1.0, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (n * (p - y)) + ridge @ (w - [1.0, -2.0]))
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def weigh(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The keep columns (doc_id unless given; text among them if with_text) and the weight of each text."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    read = keep if with_text else [*keep, "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            weights = [scanner.weight(x.as_py() or "") for x in batch.column(read.index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(weights, pa.float64())], names=[*keep, "weight"])

    return docs.select(*read).mapInArrow(run, schema)


def curve(grammar: Grammar):
    return 1 / (1 + F.exp(-(F.log1p("weight") * grammar.slope + grammar.bias)))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every document."""
    grammar = fit(docs, labels, fit_rows)
    return weigh(docs, grammar).select("doc_id", curve(grammar).alias("score"))


def matched_clauses(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, begin, end, weight, clause: the spans that a score rests on."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows = [(d, a, b, w, text[a:b]) for d, text in zip(batch.column(0).to_pylist(), (x.as_py() or "" for x in batch.column(1)), strict=True) for a, b, w in scanner.clauses(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "begin", "end", "weight", "clause"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, end long, weight double, clause string")
