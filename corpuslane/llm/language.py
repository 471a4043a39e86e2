"""Languages of documents and of their segments by multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of labelled rows whose labels may be wrong: after a first fit on the labels it
is fitted again on what it says of the sample's sentences. Its log-probabilities are a matrix of fixed size
(2 x 2**BITS x languages), which is sent to the executors; there the n-grams of whole batches are scored in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
ORDERS = (3, 4)
#: An end of a sentence, or of a piece of text that is none: a blank line, or a line end before an item or a heading.
END = re.compile(r"[.!?…]+[”“\"»'’)\]*_]*(?=\s|$)|\n[ \t>|]*(?=\n)|\n(?=[ \t>]*(?:[-*•#+]|\d+[.)]|\d{4}-\d\d|\w+ ?:))")
_FOLD = np.array([ord(low) if len(low := chr(k).lower()) == 1 and chr(k).isalpha() else 32 for k in range(0x10000)], np.uint32)
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Characters that are scored at once.
PIECE = 1_000_000


def _code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text as numbers; everything else is a blank."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _FOLD[np.where(points < 0x10000, points, 32)]


def _slots(points: np.ndarray, order: int) -> np.ndarray:
    """The table place of the n-gram that begins at each position (the last ones are padded with blanks)."""
    padded = np.concatenate((points, np.full(order - 1, 32, np.uint32)))
    h = np.zeros(len(points), np.uint32)
    for k in range(order):
        h = (h ^ padded[k : k + len(points)]) * _P[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def pieces(text: str) -> tuple[list[int], list[bool]]:
    """Ends of the pieces of a text, and for each whether it is closed like a sentence."""
    ends, closed = [], []
    for m in END.finditer(text):
        ends.append(m.end())
        closed.append(text[m.start()] != "\n")
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
        closed.append(False)
    return ends, closed


class Model:
    """Log-probabilities of n-grams by language."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.table = np.zeros((len(ORDERS), 1 << BITS, len(languages)), np.float32)

    def fit(self, texts: list[np.ndarray], labels: list[int]) -> Model:
        for n, order in enumerate(ORDERS):
            counts = np.zeros((1 << BITS, len(self.languages)))
            for k in range(len(self.languages)):
                own = [t for t, y in zip(texts, labels) if y == k]
                if own:
                    counts[:, k] = np.bincount(_slots(np.concatenate(own), order), minlength=1 << BITS)
            share = counts / np.maximum(counts.sum(axis=0), 1) + 1e-7  # an unseen n-gram weighs the same in all languages
            self.table[n] = np.log(share / share.sum(axis=0))
        return self

    def scores(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of log-probabilities over [0, ends[0]), [ends[0], ends[1]), ... by language."""
        out = np.zeros((len(ends), len(self.languages)))
        if not len(points):
            return out
        starts = np.concatenate(([0], ends[:-1]))
        for low in range(0, len(points), PIECE):
            high = min(low + PIECE, len(points))
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            cuts = np.maximum(starts[first:last], low) - low
            filled = np.flatnonzero(np.diff(np.append(cuts, high - low)) > 0)
            if len(filled):
                for n, order in enumerate(ORDERS):
                    rows = self.table[n][_slots(points[low:high], order)]
                    out[first + filled] += np.add.reduceat(rows, cuts[filled], axis=0)
        return out


def label(lang: Column, codes: dict[str, str]) -> Column:
    """The language that a label names: codes in any case, with blanks or a region, or English names; otherwise null."""
    key = F.regexp_extract(F.lower(F.trim(lang)), r"^\s*([a-z]+)(?:[-_ ].*)?$", 1)
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[key]


def names_of(languages: DataFrame) -> dict[str, str]:
    """Every name of each language, lower-cased, from a table (lang, alpha3, name_en)."""
    return {n.strip().lower(): r.lang for r in languages.select("lang", "alpha3", "name_en").collect() for n in r if n}


def fit(documents: DataFrame, languages: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 300, longest: int = 20_000, rounds: int = 2) -> Model:
    """A model fitted on at most rows_per_language labelled rows of each language, of at most `longest` characters each.

    The rows are those whose text has the lowest hash, so that the sample depends on nothing else. A language of
    which no row is labelled cannot be recognised.
    """
    codes = names_of(languages)
    known = documents.select(F.col(text).alias("text"), label(F.col(lang), codes).alias("y")).where("y is not null and length(text) between 20 and " + str(longest))
    order = Window.partitionBy("y").orderBy(F.xxhash64("text"))
    sample = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows_per_language).select("text", "y").collect()
    names = sorted({r.y for r in sample})
    model = Model(names)
    if not names:
        return model
    model.fit([_code_points(r.text) for r in sample], [names.index(r.y) for r in sample])
    for _ in range(rounds):
        texts, labels = [], []
        for r in sample:
            points, ends = _code_points(r.text), np.array(pieces(r.text)[0])
            best = model.scores(points, ends).argmax(axis=1)
            texts += np.split(points, ends[:-1])
            labels += best.tolist()
        model = Model(names).fit(texts, labels)
    return model


def sentences(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least_words: int = 7, least_letters: float = 0.5) -> DataFrame:
    """(doc_id, segment, start, end, lang, confidence, sentences, closed): runs of pieces of one language, in order.

    `sentences` counts the pieces of a segment that are sentences: closed by a mark, or of least_words words or more;
    `closed` tells whether the document has any such piece (if not, all its pieces count). Pieces without two letters,
    or of letters by less than least_letters (numbers, rules, log lines), belong to the segment they follow. Null and blank texts give no rows; equal documents count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and not t.isspace()]
            split = [pieces(t) for _, t in rows]
            points = [_code_points(t) for _, t in rows]
            sizes = np.array([len(p) for p in points], np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
            ends = np.concatenate([np.array(e) + s for (e, _), s in zip(split, starts)]) if rows else np.zeros(0, np.int64)
            score = model.scores(flat, ends)
            best = score.argmax(axis=1) if len(model.languages) else np.zeros(len(ends), int)
            letters = np.concatenate(([0], np.cumsum(flat != 32)))
            firsts = np.concatenate(([0], np.cumsum((flat != 32) & (np.concatenate(([32], flat[:-1])) == 32))))
            begins = np.concatenate(([0], ends[:-1]))
            n_letters = (letters[ends] - letters[begins]).tolist() if len(ends) else []
            n_words = (firsts[ends] - firsts[begins]).tolist() if len(ends) else []
            at = 0
            for (key, t), (e, c) in zip(rows, split):
                segments: list[list] = []  # start, end, language, score, sentences, pieces
                for k in range(len(e)):
                    length = e[k] - (e[k - 1] if k else 0)
                    if n_letters[at + k] < max(2, least_letters * length) or not model.languages:
                        if segments:
                            segments[-1][1] = e[k]
                        continue
                    y = int(best[at + k])
                    real = (c[k] and n_words[at + k] > 1) or n_words[at + k] >= least_words
                    if not segments or segments[-1][2] != y:
                        segments.append([segments[-1][1] if segments else 0, e[k], y, score[at + k].copy(), 0, 0])
                    else:
                        segments[-1][1] = e[k]
                        segments[-1][3] += score[at + k]
                    segments[-1][4] += bool(real)
                    segments[-1][5] += 1
                at += len(e)
                closed = any(s[4] for s in segments)
                for n, (low, high, y, s, real, all_) in enumerate(segments):
                    s = (s - s.max()) / len(ORDERS)
                    out.append((key, n, low, high, model.languages[y], float(np.exp(s[y]) / np.exp(s).sum()), real if closed else all_, closed))
            c = list(zip(*out)) or [()] * 8
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], ["doc_id", "segment", "start", "end", "lang", "confidence", "sentences", "closed"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, segment int, start bigint, end bigint, lang string, confidence double, sentences int, closed boolean")


def languages_of(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, sentences, confidence): languages with two sentences of a document or more, or all of them."""
    by = segments.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("sentences"), (F.sum(F.col("confidence") * (F.col("end") - F.col("start"))) / F.sum(F.col("end") - F.col("start"))).alias("confidence"))
    total = F.sum("sentences").over(Window.partitionBy("doc_id"))
    return by.withColumn("total", total).where("sentences >= 2 or sentences = total and sentences > 0").select("doc_id", "lang", "sentences", "confidence")


def mislabelled(documents: DataFrame, languages: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, sentences, confidence): the languages of each document whose label does not name just them.

    Null, unknown or other labels name no language. Blank documents have no rows. doc_id is taken to be unique.
    """
    codes = names_of(languages)
    found = languages_of(sentences(documents, fit(documents, languages, text, lang), doc_id, text))
    labels = documents.select(F.col(doc_id).alias("doc_id"), label(F.col(lang), codes).alias("named"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    joined = found.withColumn("n", n).join(labels, "doc_id")
    return joined.where("n > 1 or named is null or named <> lang").select("doc_id", "lang", "sentences", "confidence")
