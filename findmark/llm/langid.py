"""Language by rank-order profiles.

A profile is a language's most frequent n-grams of letters, in order of frequency.  A document's own most frequent n-grams
are compared with each profile by the out-of-place distance: how far an n-gram's rank is from its rank in the profile, and
the profile's length for one that it lacks.  Profiles are learned from a bounded sample of labelled documents, taken by a
hash of the id; the documents that are scored are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import lean

#: N-grams in a profile; sampled documents for each language and in all.
PROFILE, SAMPLE_EACH, SAMPLE_ALL = 300, 400, 20_000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (one to three letters or word ends, as codes) in ascending order, and their counts."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[cp]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(letter, cp, 32)
    cp = np.concatenate([[32], cp[letter | np.append(True, letter[:-1])], [32]])
    cp = cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))]
    space = cp == 32
    two = (cp[:-1] << 21) | cp[1:]
    three = (two[:-1] << 21) | cp[2:]
    grams = np.concatenate([cp[~space], two, three[~space[1:-1]]])
    grams.sort()
    begin = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[begin], np.diff(np.append(begin, len(grams)))


def ranked(text: str | None, most: int = PROFILE) -> np.ndarray:
    """The ``most`` frequent n-grams, most frequent first, ties by code."""
    grams, n = counted(text)
    return grams[np.argsort(-n, kind="stable")[:most]]


@dataclass
class Profiles:
    """Languages in ascending order, the n-grams of all profiles in ascending order, and for each n-gram, from ``begin`` on,
    the languages whose profile has it with its ranks there: as much as the profiles hold, however many languages there are."""

    langs: list[str]
    grams: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    length: int = PROFILE

    def distances(self, top: np.ndarray) -> np.ndarray:
        """The out-of-place distance of ranked n-grams to each language."""
        if not len(self.grams):
            return np.full(len(self.langs), self.length * len(top))
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == top)
        at = at[place]
        n = self.begin[at + 1] - self.begin[at]
        rows = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = self.length - np.minimum(np.abs(self.rank[rows] - np.repeat(place, n)), self.length)
        return self.length * len(top) - np.bincount(self.lang[rows], near, len(self.langs)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and one less its distance over the largest possible one."""
        top = ranked(text, self.length)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        far = self.distances(top)
        best = int(np.argmin(far))
        if far[best] >= self.length * len(top):  # nothing in common with any profile
            return UNKNOWN, 0.0
        return self.langs[best], 1.0 - float(far[best]) / (self.length * len(top))


def held_out(mod: int = 3, rest: int = 1) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest


def learn(docs: DataFrame, length: int = PROFILE, each: int = SAMPLE_EACH, most: int = SAMPLE_ALL) -> Profiles:
    """Profiles from ``docs(doc_id, text, lang)``: at most ``each`` documents of a language and ``most`` in all.

    The documents with the smallest hashes of their ids are taken.  A language's number of ids says below which hash enough of
    them lie, so few rows are ranked, however many a language has; of more than ``most`` languages the most frequent are learned.
    Rows with a null id or language are not learned from, rows that share an id count each; an empty table gives no profile.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and lang is not null").select("doc_id", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("rows"), "lang").limit(most)
    spread = (F.xxhash64("doc_id") / F.lit(float(1 << 64)) + F.lit(0.5)) * F.col("n")  # about the rank by hash
    known = known.join(F.broadcast(sizes), "lang").where(spread < 2 * each + 100).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).orderBy("r", "lang").limit(most).select(F.col("doc_id").cast("long").alias("doc_id")).collect()
    if not ids:
        return Profiles([], *(np.zeros(0, np.int64) for _ in range(4)), length)
    sample = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams, n = counted(text)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = docs.where("lang is not null").join(sample, "doc_id").select("lang", "text").mapInArrow(lean(count), "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = totals.withColumn("r", F.row_number().over(best)).where(F.col("r") <= length).select("lang", "gram", "r").collect()
    langs = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.gram for r in rows}), np.int64)
    at, number = {g: i for i, g in enumerate(codes.tolist())}, {x: i for i, x in enumerate(langs)}
    held = sorted((at[r.gram], number[r.lang], r.r - 1) for r in rows)
    gram, lang, rank = (np.array([h[i] for h in held], np.int64) for i in range(3))
    return Profiles(langs, codes, np.searchsorted(gram, np.arange(len(codes) + 1)), lang, rank, length)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    Null texts, texts without a letter and texts as far as can be from every profile are ``und`` with score 0.  Rows that share
    an id, or have none, each give a row; a text of any length is counted whole; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least_score: float = 0.0) -> DataFrame:
    """Rows of ``docs``, all columns, whose text is in a known language with at least ``least_score``.

    Rows with null text go, rows with a null id or language are judged like any other.
    """
    names = docs.columns
    at = names.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lean(run), schema)
