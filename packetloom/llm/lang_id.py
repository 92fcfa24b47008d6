"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word backs off: at each of its
positions the longest known character n-gram counts, from four characters down to one.

Word and n-gram counts cover every training document; the model that travels to the executors holds about
`n_words` words and `n_grams` n-grams, the most frequent ones of each language in equal shares (what a language doesn't need
goes to the others), so its size is bounded and a small language keeps its own words beside a large one.

Defined results: a null text or one without a letter is `und` with score 0; without any training
text everything is `und`; ties go to the first language in alphabetical order; repeated rows count and are
answered each; an empty table gives no rows; columns that aren't named in a call are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _numerals() -> re.Pattern:
    """Characters of words to the pattern above, but not letters: fractions, superscripts, Roman numerals and the like."""
    return re.compile("[" + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()) + "]")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    low = (text or "").lower()
    found = WORD.findall(low)
    if not low.isascii() and found and not "".join(found).isalpha():  # rare, and cheaper to tell from the words
        found = WORD.findall(_numerals().sub(" ", low))
    return found


N_WORDS, N_GRAMS, LONGEST = 60_000, 60_000, 4
#: Languages that a model may tell apart; words longer than this count by their n-grams only.
MAX_LANGS, WORD_CHARS = 1_000, 40
#: Entries that a task counts before it hands them on.
HELD = 400_000
#: Added to every count.
PRIOR = 0.5


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logp: np.ndarray  # words x langs
    grams: dict[str, int]
    gram_logp: np.ndarray  # grams x langs


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all words of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            langs = [lang for lang, c in held.items() for _ in range(len(c))]
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w for c in held.values() for w in c], pa.string()), pa.array([n for c in held.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text.as_py()))
                if sum(map(len, held.values())) > HELD:
                    yield rows()
        yield rows()

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, lang, n: character n-grams of the words with their ends marked, each word by its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([lang for lang, c in held.items() for _ in range(len(c))], pa.string()), pa.array([g for c in held.values() for g in c], pa.string()), pa.array([n for c in held.values() for n in c.values()], pa.int64())], names=["lang", "gram", "n"])
            held.clear()
            return out

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = held.setdefault(lang, Counter())
                marked = f"^{word}$"
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        counts[marked[i : i + size]] += n
                if len(counts) > HELD:
                    yield rows()
        yield rows()

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _level(sizes: list[int], limit: int) -> int:
    """Entries that each language may have, if together they have limit at most and what some don't need goes to the others."""
    left, sizes = limit, sorted(sizes)
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return max(1, left // (len(sizes) - i))
        left -= size
    return max(1, sizes[-1]) if sizes else 1


#: Ranges of a hash by which entries of one count are told apart.
RANGES = 1 << 16


def _most_frequent(counts: DataFrame, column: str, limit: int, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent entries of each language, of entries with one count those with the smallest hashes, limit of all
    languages together, and their counts by language.

    What is ordered are the counts that occur, then the hash ranges of the entries whose count is the last to be taken, then
    the entries of the one range that isn't taken whole."""
    by_count = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("entries"))
    sizes = [r["entries"] for r in by_count.groupBy("lang").agg(F.sum("entries").alias("entries")).collect()]  # a row for each language
    level = _level(sizes, limit)
    upto = lambda c, order: F.sum(c).over(Window.partitionBy("lang").orderBy(order))
    over = by_count.withColumn("upto", upto("entries", F.desc("n"))).where(F.col("upto") > level)
    edges = over.groupBy("lang").agg(F.max("n").alias("edge"), F.max_by(level - F.col("upto") + F.col("entries"), "n").alias("room"))  # a row for each language
    marked = counts.withColumn("place", F.pmod(F.xxhash64(column), F.lit(RANGES))).join(F.broadcast(edges), "lang", "left")
    ties = marked.where("n = edge")
    places = ties.groupBy("lang", "place", "room").agg(F.count(F.lit(1)).alias("entries")).withColumn("upto", upto("entries", "place")).where("upto > room")
    last = places.groupBy("lang").agg(F.min("place").alias("last"), F.min_by(F.col("room") - F.col("upto") + F.col("entries"), "place").alias("rest"))  # a row for each language
    ties = ties.join(F.broadcast(last), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(column), column))
    parts = [marked.where("edge is null or n > edge"), ties.where("place < last"), ties.where("place = last").withColumn("rank", rank).where("rank <= rest")]
    chosen = parts[0].select(column).union(parts[1].select(column)).union(parts[2].select(column)).distinct()
    met = counts.join(F.broadcast(chosen), column)  # limit entries at most
    top = met.groupBy(column).agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]).orderBy(column).toPandas()
    return {w: i for i, w in enumerate(top[column])}, top[[f"n{i}" for i in range(len(langs))]].to_numpy(np.float64).reshape(len(top), len(langs))


def fit(train: DataFrame, n_words: int = N_WORDS, n_grams: int = N_GRAMS) -> Model:
    from ._common import materialize

    words = materialize(word_counts(train), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).toPandas()
    langs = list(totals["lang"])
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Model([], {}, np.empty((0, 0)), {}, np.empty((0, 0)))
    known, n = _most_frequent(words.where(F.length("word") <= WORD_CHARS), "word", n_words, langs)
    grams, m = _most_frequent(materialize(gram_counts(words), "grams"), "gram", n_grams, langs)
    of_all = totals["n"].to_numpy(np.float64)

    def logp(counts, per):
        return np.log((counts + PRIOR) / (per + PRIOR * len(counts))).astype(np.float32)

    sizes = np.array([len(g) for g in grams], np.int64)
    per_size = np.stack([np.maximum(m[sizes == s].sum(axis=0), 1) if (sizes == s).any() else np.ones(len(langs)) for s in range(LONGEST + 1)])
    return Model(langs, known, logp(n, of_all), grams, logp(m, per_size[sizes] if len(grams) else per_size[:0]))


class _Scores(dict):
    """Row of each word in a table of scores.  An unseen word gets the next row; its n-grams are looked up at once, and
    the rows of a batch are summed together.  Unseen words are kept for a while."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.words)
        self.table = np.zeros((self.known + 1024, len(model.langs)), np.float32)
        self.table[: self.known] = model.word_logp
        self.rows, self.new, self.taken = self.known, [], []

    def __missing__(self, word: str) -> int:
        marked, grams, before = f"^{word}$", self.model.grams, len(self.new)
        for i in range(len(marked)):
            for size in range(LONGEST, 0, -1):  # at the end a slice is shorter, and is found as what it is
                row = grams.get(marked[i : i + size])
                if row is not None:
                    self.new.append(row)
                    break
        self.taken.append(len(self.new) - before)
        self[word] = at = self.rows
        self.rows += 1
        return at

    def settled(self) -> np.ndarray:
        """The table with the rows of all words so far."""
        if self.taken:
            taken = np.array(self.taken, np.int64)
            first, some = self.rows - len(taken), taken > 0
            if self.rows > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(self.rows, len(self.table)), self.table.shape[1]), np.float32)])
            self.table[first : self.rows] = 0
            if some.any():
                begins = (np.cumsum(taken) - taken)[some]
                self.table[first : self.rows][some] = np.add.reduceat(self.model.gram_logp[np.array(self.new)], begins, axis=0) / taken[some, None]
            self.new, self.taken = [], []
        return self.table

    def forget(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.rows = self.known


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score: the share of the language in the posterior under a uniform prior."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model)
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ids, counts = [], []
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    counts.append(len(words))
                    if model.langs:
                        ids.extend(map(scores.__getitem__, words))
                counts = np.array(counts, np.int64)
                some = counts > 0 if model.langs else np.zeros(len(counts), bool)
                names, best = np.full(len(counts), "und", object), np.zeros(len(counts))
                if some.any():
                    begins = np.append(0, np.cumsum(counts))[:-1][some]
                    sums = np.add.reduceat(scores.settled()[np.array(ids)].astype(np.float64), begins, axis=0)
                    sums -= sums.max(axis=1, keepdims=True)
                    share = np.exp(sums)
                    share /= share.sum(axis=1, keepdims=True)
                    names[some] = np.array(model.langs, object)[share.argmax(axis=1)]
                    best[some] = share.max(axis=1)
                if scores.rows - scores.known > 200_000:
                    scores.forget()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best)], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, lang_pred string, score double")
