"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Defined results: a null text counts as empty; an empty text has all statistics 0 and is scored like any
other; without labels every score is 0.5; labels of null or of documents that aren't there are ignored; of
repeated labels of one document each counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from ._common import id_crc, materialize

#: Labelled documents that a fit reads at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
STATISTICS = (
    "log_chars", "log_words", "word_chars", "letters", "digits", "spaces", "upper", "symbols", "distinct_words", "top_word", "repeated_next",
    "lines", "line_words", "repeated_lines", "piped", "ends_in_stop", "word_pairs", "compressed", "title_words", "symbol_words", "long_words", "short_lines", "marks",
)
_LETTERS, _UPPER, _SYMBOLS, _MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[#$%&*|!@^~<>{}\[\]=+\\/_]"), re.compile(r"[.,;:?]")


def statistics(text: str) -> list[float]:
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    m = len(words)
    letters = sum(map(len, _LETTERS.findall(text)))
    symbols = len(_SYMBOLS.findall(text))
    data = text.encode()
    return [
        np.log1p(n), np.log1p(m), sum(map(len, words)) / m, letters / n, sum(map(text.count, "0123456789")) / n, (text.count(" ") + text.count("\n")) / n, len(_UPPER.findall(text)) / n, symbols / n,
        len(counts) / m, max(counts.values()) / m, sum(map(str.__eq__, words, words[1:])) / m,
        np.log1p(len(lines)), m / len(lines), 1 - len(set(lines)) / len(lines), text.count("|") / m, sum(x.rstrip()[-1] in ".?" for x in lines) / len(lines),
        len(set(zip(words, words[1:], strict=False))) / m, len(zlib.compress(data, 1)) / len(data),
        sum(map(str.istitle, words)) / m, symbols / m, sum(len(w) > 18 for w in words) / m, sum(len(x) < 40 for x in lines) / len(lines), len(_MARKS.findall(text)) / m,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, statistics array<double> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x.as_py() or "") for x in batch.column(1)], np.float64).ravel()
            offsets = np.arange(0, len(values) + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "statistics"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, statistics array<double>")


def labelled_sample(labels: DataFrame, column: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, label: at most about fit_rows training labels (crc32 of doc_id not a multiple of 5)."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc() % 5 != 0)).select("doc_id", F.col(column).cast("double").alias("label"))
    n = rows.count()
    if n > fit_rows:
        share = int(fit_rows / n * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    return rows


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> gbt.Forest:
    rows = stats.join(F.broadcast(labelled_sample(labels, "quality", fit_rows)), "doc_id").orderBy("doc_id").toPandas()
    x = np.array(rows["statistics"].tolist(), np.float64).reshape(len(rows), len(STATISTICS))
    return gbt.fit(x, rows["label"].to_numpy(np.float64))


def score(stats: DataFrame, forest: gbt.Forest) -> DataFrame:
    """doc_id, score."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every document; texts are read once."""
    stats = materialize(document_statistics(docs), "quality-statistics")
    return score(stats, fit(stats, labels, fit_rows))
