"""Near copies by SimHash fingerprints: a grid over per-segment bit counts, then exact verification.

A fingerprint's embedding is the number of set bits in each of its 32 two-bit segments.  The Manhattan distance of two
embeddings is at most the number of differing bits, so fingerprints that link (at most four differing bits) are at most two
apart in one half of the embedding.  Two grid points at most two apart have a point that is at most one from both: so each
distinct fingerprint is dealt to the cells of its two half embeddings and of their direct neighbours, about 50 rows, and
every link meets in a cell.

A cell with few fingerprints compares them all; in a larger one a search from fingerprint to fingerprint emits a spanning
forest of the links, so no cell emits more links than it has rows.  A cell of more than ``MOST_IN_CELL`` is not searched but
dealt again by the half that it is not dealt by yet: there a link's distance is at most four, so in one quarter it is at
most two, and the same argument holds; what is still large is dealt once more by the other quarter.  So the work is spread
over tasks and stays exact.  Cells have distinct fingerprints only: copies count once, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmark.llm.shared import components, lean, stored

SEED, WORDS, MOST_BITS = 42, 4, 4
#: Cells up to this size compare all their fingerprints at once; larger than that they are dealt again.
SMALL_CELL, MOST_IN_CELL = 8, 65_536
#: A fingerprint with more than one row in so many is sent to every task; there are fewer such fingerprints than this.
HOT = 1000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of ``text``: A-Z lower-cased, words between ASCII white space, shingles with repeats.

    Fewer words than a shingle: the whole sequence is one; no word, or null: zero.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    h = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])


def _points(bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of ``width`` bits: the grid points at most one from each piece's segment counts, and whose they are."""
    p = bits - ((bits >> 1) & 0x55555555)
    points, own = [p], [np.arange(len(p))]
    for i in range(0, width, 2):
        n = (p >> i) & 3
        for m, step in ((n < 2, 1 << i), (n > 0, -(1 << i))):
            points.append(p[m] + step)
            own.append(np.flatnonzero(m))
    return np.concatenate(points), np.concatenate(own)


_CELLS = "cell long, piece int, fp long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            f = fps[at : at + 4096]
            for half in (0, 1):
                points, own = _points(((f.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64), 32)
                yield pa.record_batch([pa.array(points | (half << 32)), pa.array(np.full(len(points), half, np.int32)), pa.array(f[own])], ["cell", "piece", "fp"])


def _dealt_again(cell: int, piece: int, f: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``(cells, piece, fingerprints)``: a large cell by both parts of the bits that come next.

    Pieces: a half (0, 1); 2 + 2 * half + quarter, for a quarter of the other half; and 6 for an eighth of the other quarter.
    """
    if piece < 2:
        first, width, names = 32 * (1 - piece), 16, (2 + 2 * piece, 3 + 2 * piece)
    else:
        half, quarter = divmod(piece - 2, 2)
        first, width, names = 32 * (1 - half) + 16 * (1 - quarter), 8, (6, 6)
    for k, name in enumerate(names):
        points, own = _points(((f >> np.uint64(first + width * k)) & np.uint64((1 << width) - 1)).astype(np.int64), width)
        mixed = (np.uint64(cell * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + points.astype(np.uint64) * np.uint64(2) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        yield (mixed ^ (mixed >> np.uint64(31))).view(np.int64), name, f[own]


def _forest(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join what links of ``f`` join: a search that takes each fingerprint out of the rest once."""
    out, rest = [], f
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            v = todo.pop()
            near = np.bitwise_count(rest ^ v) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out += [(v, u) for u in found]
                todo += list(found)
    return out


def _linker(most: int, large: int):
    """Rows sorted by cell to links ``(a, b)``; large cells to rows with their next cell, its piece and a fingerprint ``a``."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, piece, fp = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def links(cell: np.ndarray, piece: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            if len(cell):
                begin = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1])))
                size = np.diff(np.append(begin, len(cell)))
                for i in np.flatnonzero(size > SMALL_CELL):
                    own, kind = fp[begin[i] : begin[i] + size[i]], int(piece[begin[i]])
                    if size[i] > large and kind < 6:
                        for at in range(0, len(own), 4096):
                            for next_cell, name, f in _dealt_again(int(cell[begin[i]]), kind, own[at : at + 4096]):
                                yield pa.record_batch([pa.array(next_cell), pa.array(np.full(len(f), name, np.int32)), pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64())], ["cell", "piece", "a", "b"])
                        continue
                    for u, v in _forest(own, most):
                        a.append(u)
                        b.append(v)
                some = np.repeat((size > 1) & (size <= SMALL_CELL), size)
                c, q, f = cell[some], piece[some], fp[some]
                for s in range(1, SMALL_CELL):
                    if len(c) > s:
                        near = np.flatnonzero((c[s:] == c[:-s]) & (q[s:] == q[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= most))
                        a += f[near].tolist()
                        b += f[near + s].tolist()
            a, b = np.array(a, np.uint64), np.array(b, np.uint64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32()), pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["cell", "piece", "a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            piece = np.concatenate([piece, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            if len(cell) >= 200_000 and cell[-1] != cell[0]:
                cut = int(np.searchsorted(cell, cell[-1]))
                yield from links(cell[:cut], piece[:cut], fp[:cut])
                cell, piece, fp = cell[cut:], piece[cut:], fp[cut:]
        yield from links(cell, piece, fp)

    return link


def fingerprint_links(distinct: DataFrame, most_bits: int = MOST_BITS, large: int = MOST_IN_CELL) -> DataFrame:
    """``(a, b)``: links of ``distinct(fp)`` that join the same fingerprints as all links of at most ``most_bits`` bits; a
    link may be there more than once."""
    if not 0 <= most_bits <= 4:
        raise ValueError("the grid covers links of up to four bits")
    found: list[DataFrame] = []
    cells = distinct.select("fp").mapInArrow(lean(_cells), _CELLS)
    while True:  # three times at most: halves, quarters, eighths
        dealt = cells.repartition("cell").sortWithinPartitions("cell", "piece")
        found.append(stored(dealt.mapInArrow(lean(_linker(most_bits, large)), "cell long, piece int, a long, b long"), "fingerprint-links"))
        cells = found[-1].where("cell is not null").select("cell", "piece", F.col("a").alias("fp"))
        if cells.isEmpty():
            return reduce(DataFrame.unionAll, [x.where("cell is null").select("a", "b") for x in found])


def near_copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and link like any other; rows without ``doc_id`` are left out; rows that
    share an id each give a row; a text of any length is taken whole, by blocks of shingles; an empty table gives no row.
    ``component_id`` is the smallest id that links reach.
    """
    fps = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(lean(_fingerprints), "doc_id long, fp long"), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    links = fingerprint_links(classes, most_bits).distinct()
    side = lambda c: classes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    by_id = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    roots = components(by_id)
    of = stored(classes.join(roots, F.col("first") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "first").alias("component_id")), "classes")
    # the rows of one text that very many documents have stay where they are; those of all others are dealt by fingerprint
    often = F.col("n") * HOT > F.lit(fps.count())
    hot, rest = of.where(often), of.where(~often)
    found = fps.join(F.broadcast(hot), "fp").unionByName(fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component; of rows that share that id all stay.

    Rows without ``doc_id`` stay, too: they are compared with nothing, as in the other stages.  All columns return.
    """
    gone = near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
