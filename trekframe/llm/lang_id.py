"""Language identification by multinomial naive Bayes over hashed character n-grams.

Character n-grams of one to three code points (lower case, everything but
letters as a space, at least one letter) are hashed into ``DIM`` features.
Learning sums feature counts by language over all learning rows: every task
adds up its own, Spark the tasks'. The log-probability matrix, languages x DIM,
is broadcast in blocks of ``MOST_LANGS`` languages: one pass over the texts in
all but odd cases, and one more for each further block, which carries the best
language so far in the row. Scoring takes batches of texts: the
n-grams of all of them make one sparse batch whose log probabilities are summed
by document in numpy. Whole texts are scored, long ones in slices.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
if nothing can be learned, all are; equal scores go to the language that sorts
first; a null id counts as empty text in the hold-out rule; repeated rows get
equal results; an empty table gives an empty result; extra columns are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import map_arrow, written

DIM = 1 << 15
MOST_LANGS = 256
#: Code points that are scored at once.
SLICE = 1 << 19

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(32))


def features(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashed features) of the n-grams that start at each place, for n = 1, 2, 3."""
    letter = codes != 32
    mixed, any_letter, out = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool), []
    for n in range(1, 4):
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        mixed = mixed[:size] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        any_letter = any_letter[:size] | letter[n - 1 :]
        mixed ^= mixed >> np.uint32(15)
        at = np.flatnonzero(any_letter)
        out.append((at, ((mixed[at] * np.uint32(0x85EBCA77)) >> np.uint32(32 - 15)).astype(np.int32)))
    return out


def _groups(texts: list[str | None]):
    """(numbers, codes, starts) of groups of texts, two spaces apart, of about SLICE code points; slices of longer texts overlap by the two."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text or "")
        for a in range(0, max(len(codes), 1), SLICE):
            part = codes[a : a + SLICE + 2]
            own = min(SLICE, len(codes) - a)  # n-grams that start beyond belong to the next slice
            numbers.append(i)
            parts.append((part, own))
            size += len(part) + 2
            if size >= SLICE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if numbers:
        yield numbers, parts


def _sparse(numbers: list[int], parts: list[tuple[np.ndarray, int]]):
    """(document number of each n-gram, its feature) over a group."""
    gap = np.full(2, 32, np.uint32)
    codes = np.concatenate([x for part, _ in parts for x in (part, gap)])
    lengths = np.array([len(part) + 2 for part, _ in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ends = starts + np.array([own for _, own in parts])
    found = []
    for at, feature in features(codes):
        which = np.searchsorted(starts, at, side="right") - 1
        ok = at < ends[which]
        found.append((which[ok], feature[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learned_counts(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, feature, n over all rows given; the number of a language's rows stands at feature DIM."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for numbers, parts in _groups(texts):
                which, feature = _sparse(numbers, parts)
                order = np.array([langs[i] for i in numbers], dtype=object)
                for lang in set(order):
                    mine = np.flatnonzero(order == lang)
                    total = sums.setdefault(lang, np.zeros(DIM + 1, np.int64))
                    total[:DIM] += np.bincount(feature[np.isin(which, mine)], minlength=DIM)
            for lang in langs:
                sums.setdefault(lang, np.zeros(DIM + 1, np.int64))[DIM] += 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "feature", "n"])

    known = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = map_arrow(known, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    return written(sums, "language-counts")


def log_matrix(counts: DataFrame, langs: list[str], rows: int) -> np.ndarray:
    """Log probabilities of the features in each language (with the prior, of rows learning rows, as last column)."""
    table = counts.where(F.col("lang").isin(langs)).toArrow()
    found = np.zeros((len(langs), DIM + 1))
    place = {lang: i for i, lang in enumerate(langs)}
    found[[place[x] for x in table.column("lang").to_pylist()], table.column("feature").to_numpy()] = table.column("n").to_numpy()
    matrix = np.empty_like(found)
    matrix[:, :DIM] = np.log((found[:, :DIM] + 0.5) / (found[:, :DIM].sum(axis=1, keepdims=True) + 0.5 * DIM))
    matrix[:, DIM] = np.log(np.maximum(found[:, DIM], 1) / max(1, rows))
    return matrix


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = MOST_LANGS):
    """(languages in order, their matrix) from all rows given, a block of languages at a time."""
    counts = learned_counts(rows, text_col, lang_col)
    sizes = {r.lang: r.n for r in counts.where(F.col("feature") == DIM).select("lang", "n").collect()}  # a name a language
    langs = sorted(sizes)
    for at in range(0, max(1, len(langs)), block):
        some = langs[at : at + block]
        yield some, log_matrix(counts, some, sum(sizes.values())) if some else np.zeros((0, DIM + 1))


def score_logs(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and its log probability with each language."""
    sums = np.tile(matrix[:, DIM], (len(texts), 1))
    grams = np.zeros(len(texts), np.int64)
    for numbers, parts in _groups(texts):
        which, feature = _sparse(numbers, parts)
        numbers = np.array(numbers)
        np.add.at(grams, numbers, np.bincount(which, minlength=len(numbers)))
        for k in range(len(langs)):
            np.add.at(sums[:, k], numbers, np.bincount(which, weights=matrix[k][feature], minlength=len(numbers)))
    return grams, sums


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray, before: list[tuple[str, float, float]] | None = None) -> list[tuple[str, float, float]]:
    """(most probable language, its log probability, sum of all languages' probabilities over its own) of each text; before has the same from other languages, which sort first."""
    grams, sums = score_logs(texts, langs, matrix)
    out = []
    for i, (n, row) in enumerate(zip(grams, sums)):
        name, top, total = before[i] if before else ("und", -np.inf, 0.0)
        if n and len(langs):
            best = int(np.argmax(row))
            if row[best] > top:
                name, top, total = langs[best], float(row[best]), total * float(np.exp(top - row[best]))
            total += float(np.exp(row - top).sum())
        out.append((name, top, total))
    return out


def predict(docs: DataFrame, blocks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by blocks of (languages, matrix)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = iter(blocks)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        rows = _scored(rows, block, first, following is None)
        if following is not None:
            rows = written(rows, "languages-so-far")
        block, first = following, False
    return rows


def _scored(rows: DataFrame, block: tuple[list[str], np.ndarray], first: bool, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)  # MOST_LANGS x DIM at most

    def run(batches):
        langs, logs = shared.value
        for batch in batches:
            before = None if first else list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))))
            found = score_texts(batch.column(2).to_pylist(), langs, logs, before)
            names = pa.array([x[0] for x in found], pa.string())
            if last:
                scores = pa.array([0.0 if x[0] == "und" and not x[2] else 1.0 / x[2] for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, scores], names=["doc_id", "held_out", "lang_pred", "score"])
            else:
                more = [pa.array([x[i] for x in found], pa.float64()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, *more], names=["doc_id", "held_out", "text", "name", "top", "total"])

    return map_arrow(rows, run, "doc_id long, held_out boolean, " + ("lang_pred string, score double" if last else "text string, name string, top double, total double"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = MOST_LANGS) -> DataFrame:
    """Learns from the rows that aren't held out, and predicts all."""
    return predict(docs, learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col, block), id_col, text_col)
