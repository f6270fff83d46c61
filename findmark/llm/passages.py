"""Passages that repeat across documents, by collinear chains of shared k-mers.

Every document gives seeds: hashes of five consecutive words, chosen so that each ``WINDOW`` neighbouring k-mers have one
among them.  An occurrence of a seed is matched with the seed's first one, in the document of the smallest id: rows grow
with the text, however many documents share a passage.  The matches of two documents are chained: a Fenwick tree over
positions in the other document gives each match the best chain before it, less a cost for the gap.  A chain has two seeds
or more.

A seed's first document may have it by chance or in a short quote.  Seeds that are in no chain that is a passage for sure
are therefore matched again, now with the occurrence in the next smaller document, by themselves and by longer keys, which a
short quote does not have: two such seeds at most 24 words apart, two at most 45 words apart, and all seeds of a verbatim
stretch of 39 words and more.  So a document that quotes a passage hides its later holders from each other only where it
lies between them, and then only the words it quotes.  Rows stay as many as occurrences.

The words at the ends of all chains, and between their seeds where the chain is not verbatim, are then aligned with gaps.
Parts that are alike enough are merged to passages of the document; those of fifty words and more are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import dropped, lean, stored

#: Words in a k-mer; k-mers of which one is a seed; words and likeness of a passage; words of a part that may be merged.
K, WINDOW, LEAST_WORDS, LIKENESS, LEAST_PART = 5, 4, 50, 0.8, 20
#: Words between matches of a chain at most, words beyond a chain's ends that are aligned, cost of a word of gap.
MOST_GAP, BEYOND, GAP_COST = 40, 48, 0.05
#: Words that an alignment beyond an end may be off its diagonal.
BAND = 8
#: Words between the two seeds of the longer keys, and between the first and last seed of a verbatim one.
NEAR, FAR, VERBATIM = (8, 24), (25, 45), 34
#: Words that a task takes together to number their seeds.
BUFFER = 500_000
#: Bytes of text whose seeds make a bucket.
BUCKET = 64 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts one after another, and the number of words of each; null has none."""
    from xxhash import xxh64_intdigest

    low = pc.ascii_trim_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    parts = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(low), 0), None, low))
    coded = pc.dictionary_encode(parts.flatten())
    own = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)], pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def seeds(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, text, place)`` of the seeds of texts with ``n`` words each, whose hashes are in ``words``."""
    first = np.cumsum(n) - n
    many = np.maximum(n - K + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = first[text] + place
    k = words[at]
    for j in range(1, K):
        k = k * np.uint64(0x9E3779B97F4A7C15) + words[at + j]
    k = _mixed(k)
    least, where = k.copy(), np.arange(len(k))
    for j in range(1, min(WINDOW, len(k))):
        lower = np.flatnonzero((text[j:] == text[:-j]) & (k[j:] < least[:-j]))
        least[lower], where[lower] = k[lower + j], lower + j
    chosen = np.unique(where[place <= np.maximum(many[text] - WINDOW, 0)])
    return k[chosen], text[chosen], place[chosen]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in any column."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(np.ones(min(len(columns[0]), 1), bool), new))


def _firsts(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences sorted by key: where each key begins, its first occurrence, and whether two documents have it."""
    begin = _starts(key)
    size = np.diff(np.append(begin, len(key)))
    least = np.minimum.reduceat(doc, begin)
    own = np.where(doc == np.repeat(least, size), place, np.iinfo(np.int64).max)
    lowest = np.minimum.reduceat(own, begin)
    hit = np.flatnonzero(own == np.repeat(lowest, size))
    first = hit[np.searchsorted(hit, begin)]
    return begin, first, np.maximum.reduceat(doc, begin) != least


def _planes(a: np.ndarray) -> bytes:
    """The bytes of ``a`` by significance, so that those that hardly differ lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _whole(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


_DEALT = "bucket int, matched boolean, keys binary, docs binary, places binary, others binary, other_places binary"


def _before(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For occurrences sorted by key, document and place: the key's first one in the next smaller document, or -1."""
    run = _starts(key, doc)
    size = np.diff(np.append(run, len(key)))
    back = np.append(-1, run[:-1])
    back[np.append(True, key[run[1:]] != key[run[:-1]])[: len(run)]] = -1
    return np.repeat(back[: len(run)], size)


def _dealt(key: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int, near: bool = False) -> pa.RecordBatch:
    """Occurrences of keys, dealt to buckets by key.

    Of a key with several occurrences here only the first goes to the key's bucket; the others are dealt evenly, so a key
    of very many documents has a bounded number of rows in its bucket.  With ``near`` these others have the occurrence in the
    next smaller document that is here beside them.
    """
    rows: list[tuple] = []
    if len(key):
        order = np.lexsort((place, doc, key)) if near else np.argsort(key, kind="stable")
        key, doc, place = key[order], doc[order], place[order]
        _, first, shared = _firsts(key, doc, place)
        back = _before(key, doc, place) if near else None
        rest = np.ones(len(key), bool)
        rest[first] = False
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        name = (bucket.astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        marked = place[first] | (shared.astype(np.int64) << 31)
        spread = (_mixed(key[rest] ^ doc[rest].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b, matched, k, d, p in ((bucket[first], False, name[first].astype(np.uint32), doc[first], marked), (spread, True, name[rest], doc[rest], place[rest])):
            by = np.argsort(b, kind="stable")
            b, k, d, p = b[by], k[by], d[by], p[by].astype(np.uint32)
            begin = _starts(b)
            for x, y in zip(begin.tolist(), np.append(begin[1:], len(b)).tolist()):
                rows.append((int(b[x]), matched, _planes(k[x:y]), _planes(d[x:y]), _planes(p[x:y]), None, None))
                if matched and near:
                    own = back[rest][by[x:y]]
                    own = own[own >= 0], own >= 0  # others are of the same document as the first
                    rows[-1] = (int(b[x]), matched, *(_planes(c[x:y][own[1]]) for c in (k, d, p)), _planes(doc[own[0]]), _planes(place[own[0]].astype(np.uint32)))
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], [c.split()[0] for c in _DEALT.split(", ")])


def _seed_dealer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                words, n = word_hashes(some.column(1))
                h, text, place = seeds(words, n)
                held.append((h, some.column(0).to_numpy()[text], place))
                size += len(words)
                if size >= BUFFER:
                    yield _dealt(*map(np.concatenate, zip(*held)), buckets)
                    held, size = [], 0
        if held:
            yield _dealt(*map(np.concatenate, zip(*held)), buckets)

    return run


def long_keys(h: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, seed)`` for seeds sorted by text and place: keys of two seeds and of verbatim stretches, and where they begin.

    Of the seeds in reach the one of the smallest hash is the second, so documents that share the words choose alike.
    """
    n, top = len(h), np.uint64(0xFFFFFFFFFFFFFFFF)
    best = {NEAR: np.full(n, top), FAR: np.full(n, top)}
    run, open_, done = h.copy(), np.ones(n, bool), np.zeros(n, bool)
    for t in range(1, FAR[1] + 1):
        if t >= n:
            break
        gap = np.where(text[t:] == text[:-t], place[t:] - place[:-t], FAR[1] + 1)
        if not (gap <= FAR[1]).any():
            break
        for (a, b), low in best.items():
            m = np.flatnonzero((gap >= a) & (gap <= b) & (h[t:] < low[:-t]))
            low[m] = h[m + t]
        step = place[t:] - place[t - 1 : n - 1]
        m = np.flatnonzero(open_[: n - t] & (gap <= FAR[1]) & (step <= WINDOW))
        still = np.zeros(n, bool)
        still[m] = True
        run[m] = run[m] * np.uint64(0x9E3779B97F4A7C15) + h[m + t] + step[m].astype(np.uint64)
        ended = m[gap[m] >= VERBATIM]
        done[ended], still[ended] = True, False
        open_ = still
    keys, at = [_mixed(run[done])], [np.flatnonzero(done)]
    for salt, low in enumerate(best.values(), 1):
        own = np.flatnonzero(low != top)
        keys.append(_mixed(h[own] * np.uint64(0x9E3779B97F4A7C15) + low[own] + np.uint64(salt)))
        at.append(own)
    return np.concatenate(keys), np.concatenate(at)


def _key_dealer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            h, place = _mixed(b.column(1).flatten().to_numpy().view(np.uint64) & np.uint64(0xFFFFFFFF)), b.column(2).flatten().to_numpy().astype(np.int64)
            keys, at = long_keys(h, row, place)
            keys, at = np.append(keys, _mixed(h + np.uint64(3))), np.append(at, np.arange(len(h)))
            held.append((keys, b.column(0).to_numpy()[row[at]], place[at]))
            size += len(keys)
            if size >= BUFFER:
                yield _dealt(*map(np.concatenate, zip(*held)), buckets, True)
                held, size = [], 0
        if held:
            yield _dealt(*map(np.concatenate, zip(*held)), buckets, True)

    return run


_HELD = "h long, doc_id long, p int, other_id long, o int, first boolean"


def _holder(near: bool):
    """Rows sorted by bucket to occurrences of the keys that two documents have, each with the key's first occurrence, or with
    ``near`` the one in the next smaller document; occurrences without such a one are left out.

    Occurrences that were dealt evenly have no match yet unless they came with one.
    """
    names = [c.split()[0] for c in _HELD.split(", ")]

    def batch_of(h, doc, place, other, o, first) -> pa.RecordBatch:
        kinds = (None, None, pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        return pa.record_batch([pa.array(c, t) for c, t in zip((h, doc, place, other, o, first), kinds)], names)

    def matched(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        key, doc, place = (np.concatenate(x) for x in zip(*parts))
        place, shared = (place & 0x7FFFFFFF).astype(np.int64), place >> 31 != 0
        order = np.lexsort((place, doc, key)) if near else np.argsort(key, kind="stable")
        key, doc, place, shared = key[order], doc[order], place[order], shared[order]
        if near:
            back = _before(key, doc, place)
            keep = back >= 0
            back = back[keep]
            return batch_of((np.int64(bucket) << 32) | key[keep].astype(np.int64), doc[keep], place[keep], doc[back], place[back], np.zeros(len(back), bool))
        begin, first, several = _firsts(key, doc, place)
        size = np.diff(np.append(begin, len(key)))
        keep = np.repeat(several | np.logical_or.reduceat(shared, begin), size)
        is_first = np.zeros(len(key), bool)
        is_first[first] = True
        first = np.repeat(first, size)[keep]
        return batch_of((np.int64(bucket) << 32) | key[keep].astype(np.int64), doc[keep], place[keep], doc[first], place[first], is_first[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = -1, []
        for b in batches:
            for bucket, loose, keys, docs, places, others, other_places in zip(*(c.to_pylist() for c in b.columns)):
                if loose:
                    h, doc, place = _whole(keys, "<i8"), _whole(docs, "<i8"), _whole(places, "<u4").astype(np.int32)
                    other = (None, None) if others is None else (_whole(others, "<i8"), _whole(other_places, "<u4").astype(np.int32))
                    yield batch_of(h, doc, place, *(pa.nulls(len(h), pa.int64()) if x is None else x for x in other), np.zeros(len(h), bool))
                    continue
                if bucket != own and parts:
                    yield matched(own, parts)
                    parts = []
                own = bucket
                parts.append((_whole(keys, "<u4"), _whole(docs, "<i8"), _whole(places, "<u4")))
        if parts:
            yield matched(own, parts)

    return run


_held = _holder(False)


def _by_bucket(dealt: DataFrame, near: bool = False) -> DataFrame:
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_holder(near)), _HELD)


def _matches(dealt: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``h, doc_id, p, other_id, o``: every occurrence of a shared key with the key's first one in another document; and
    the table that has to stay until these rows are read."""
    held = stored(_by_bucket(dealt), name)
    loose = held.where("other_id is null").select("h", "doc_id", "p").join(held.where("first").select("h", "other_id", "o"), "h")
    return held.where("other_id is not null").select("h", "doc_id", "p", "other_id", "o").unionByName(loose).where("doc_id <> other_id"), held


def chain(d: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """Indexes of matches ``(d, o)``, sorted by ``d`` then ``o``, as disjoint chains that ascend in both."""
    n = len(d)
    if n == 1 or ((o - d == o[0] - d[0]).all() and (np.diff(d) > 0).all()):
        return [np.arange(n)]
    rank = np.unique(o, return_inverse=True)[1].tolist()
    size = max(rank) + 1
    best, who = [-1.0] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    dl, ol = d.tolist(), o.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and dl[j] == dl[i]:  # matches at one place do not follow each other
            r, top, by = rank[j], 0.0, -1
            while r > 0:  # the places below this one
                if best[r] > top:
                    top, by = best[r], who[r]
                r -= r & -r
            gain = top - GAP_COST * (dl[j] + ol[j])
            score[j], before[j] = (K + gain, by) if by >= 0 and gain > 0 else (float(K), -1)
            j += 1
        for m in range(i, j):
            value, r = score[m] + GAP_COST * (dl[m] + ol[m]), rank[m] + 1
            while r <= size:
                if value > best[r]:
                    best[r], who[r] = value, m
                r += r & -r
        i = j
    used, out = [False] * n, []
    for e in sorted(range(n), key=lambda m: -score[m]):
        path = []
        while e >= 0 and not used[e]:
            used[e] = True
            path.append(e)
            e = before[e]
        if path:
            out.append(np.array(path[::-1]))
    return out


_CHAINS = "doc_id long, other_id long, solid boolean, d array<int>, o array<int>, h array<long>"


def _lists(pieces: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(x) for x in pieces])).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pieces) if pieces else [], kind))


def _chainer(loose: bool, least: int = 2):
    """Matches sorted by document, other document and places to chains of at least ``least`` matches without large gaps;
    and with ``loose``, in a row without other document, the document's seeds that are in no chain that is a passage for sure."""

    def done(h: np.ndarray, doc: np.ndarray, p: np.ndarray, other: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        ids, others, solid, ds, os, hs = [], [], [], [], [], []
        begin = _starts(doc, other)
        size = np.diff(np.append(begin, len(doc)))
        sure: dict[int, list[tuple[int, int]]] = {}
        for a, n in zip(begin[size >= least].tolist(), size[size >= least].tolist()):
            d_all, o_all = p[a : a + n], o[a : a + n]
            for own in chain(d_all, o_all):
                x, y = d_all[own], o_all[own]
                dx, dy = np.diff(x), np.diff(y)
                cut = np.flatnonzero((dx > MOST_GAP + K) | (dy > MOST_GAP + K)) + 1
                for u, v in zip([0, *cut.tolist()], [*cut.tolist(), len(x)]):
                    if v - u < least:
                        continue
                    step_d, step_o = dx[u : v - 1], dy[u : v - 1]
                    level = step_d == step_o
                    covered = K + int(np.minimum(step_d, K)[level].sum())
                    length = int(max(x[v - 1] - x[u], y[v - 1] - y[u])) + K
                    ids.append(int(doc[a]))
                    others.append(int(other[a]))
                    solid.append(covered == length)
                    ds.append(x[u:v])
                    os.append(y[u:v])
                    hs.append(np.zeros(0, np.int64))
                    if length >= LEAST_WORDS and covered >= LIKENESS * length:
                        sure.setdefault(int(doc[a]), []).append((int(x[u]), int(x[v - 1])))
        begin = _starts(doc) if loose else np.zeros(0, np.int64)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(doc)).tolist()):
            open_ = np.ones(b - a, bool)
            for low, high in sure.get(int(doc[a]), ()):
                open_ &= (p[a:b] < low) | (p[a:b] > high)
            if open_.sum() > 1:
                places, at = np.unique(p[a:b][open_], return_index=True)
                ids.append(int(doc[a]))
                others.append(None)
                solid.append(False)
                ds.append(places)
                os.append(np.zeros(0, np.int32))
                hs.append(h[a:b][open_][at])
        columns = [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(solid, pa.bool_()), _lists(ds, pa.int32()), _lists(os, pa.int32()), _lists(hs, pa.int64())]
        return pa.record_batch(columns, [c.split()[0] for c in _CHAINS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, last = 0, None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            # a batch that goes on with the last document's rows is kept with them; nothing is copied until a document ends
            ends = columns[1]
            if size > 50_000 and len(ends) and (ends[0] != last or ends[-1] != last):
                cut = int(np.argmax(ends != last)) if ends[0] == last else 0
                held.append([c[:cut] for c in columns])
                yield done(*(np.concatenate(x) for x in zip(*held)))
                held, columns, size = [], [c[cut:] for c in columns], 0
            held.append(columns)
            size += len(columns[0])
            last = columns[1][-1] if len(columns[1]) else last
        if size:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    return run


def _chained(matches: DataFrame, name: str, loose: bool) -> DataFrame:
    # the number of parts is given: chains cost time, not bytes, by which small parts would be put together
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = matches.select("h", "doc_id", "p", "other_id", "o").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "other_id", "p", "o")
    return stored(rows.mapInArrow(lean(_chainer(loose)), _CHAINS), name)


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in the best alignment of two short stretches."""
    row = [0] * (len(b) + 1)
    bl = b.tolist()
    for x in a.tolist():
        last = 0
        for j, y in enumerate(bl, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def outward(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of stretches that begin together and each number ``i`` of words of the first, up to ``BEYOND``: words of
    the second in the best alignment of their beginnings, and how many are equal.

    An equal word counts 1; a changed, missing or additional one takes 1 away.  All pairs go row by row over a band of
    ``BAND`` words to either side; scores hold the equal words in their low bits.  Rows beyond the first stretch have -1.
    """
    unit, n, width = 1 << 20, len(a), 2 * BAND + 1
    x, y = np.full((n, BEYOND), -1, np.int64), np.full((n, BEYOND + 2 * BAND), -2, np.int64)
    over = np.array([len(q) for q in b], np.int64)
    size = np.array([len(q) for q in a], np.int64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : min(len(p), BEYOND)] = p[:BEYOND]
        y[i, BAND : BAND + min(len(q), BEYOND)] = q[:BEYOND]
    step = unit * np.arange(width, dtype=np.int64)
    shift = np.arange(width) - BAND
    row = np.tile(np.where(shift >= 0, unit * BAND - step, -(1 << 40)), (n, 1))
    row = np.where(shift > over[:, None], -(1 << 40), row)
    upto, same = np.full((n, BEYOND + 1), -1, np.int64), np.full((n, BEYOND + 1), -1, np.int64)
    upto[:, 0] = same[:, 0] = 0
    for i in range(BEYOND):
        diagonal = row + np.where(x[:, i, None] == y[:, i : i + width], unit + 1, -unit)
        diagonal[:, :-1] = np.maximum(diagonal[:, :-1], row[:, 1:] - unit)
        row = np.maximum.accumulate(np.where((i + 1 + shift < 0) | (i + 1 + shift > over[:, None]), -(1 << 40), diagonal) + step, axis=1) - step
        row = np.where(i + 1 + shift > over[:, None], -(1 << 40), row)
        at = row.argmax(1)
        top = row[np.arange(n), at]
        own = (size > i) & (top > -(1 << 39))
        upto[own, i + 1] = i + 1 + at[own] - BAND
        same[own, i + 1] = top[own] & (unit - 1)
    return upto, same


def ends(core: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How far parts go beyond both ends: ``(words, other words, equal words)`` by side, for cores ``(words, other words,
    equal words)``.

    Each side ends where equal words less twice the others are the most.  A part that stays under ``LEAST_WORDS`` by that,
    but reaches it with sides that are alike by 0.6 and by ``LIKENESS`` in all, goes as far as it is longest.
    """
    rows = np.arange(len(core))
    words = np.broadcast_to(np.arange(BEYOND + 1), sides[0][0].shape)
    longer = [np.maximum(words, j) for j, _ in sides]
    pick = [np.where(m >= 0, m - 2 * (n - m), -(10**6)).argmax(1) for n, (_, m) in zip(longer, sides)]
    got = lambda i, side: (sides[side][0][rows, i], sides[side][1][rows, i])
    total = core[:, 0] + pick[0] + pick[1]
    short = np.flatnonzero(total < LEAST_WORDS)
    if len(short):
        value, room = [], []
        for n, (_, m) in zip(longer, sides):
            n, m = n[short], m[short]
            risen = np.diff(np.maximum.accumulate(m, axis=1), prepend=-1, axis=1) > 0  # ends with an equal word
            fit = risen & (m >= 0.6 * n)
            fit[:, 0] = True
            value.append(np.where(fit, m - LIKENESS * n, -1e6))
            room.append(words[short])
        slack = core[short, 2] - LIKENESS * np.maximum(core[short, 0], core[short, 1])
        length = np.where(value[0][:, :, None] + value[1][:, None, :] + slack[:, None, None] >= -1e-9, room[0][:, :, None] + room[1][:, None, :], -1)
        flat = length.reshape(len(short), -1)
        best = flat.argmax(1)
        good = (flat[np.arange(len(short)), best] + core[short, 0]) >= LEAST_WORDS
        pick[0][short[good]], pick[1][short[good]] = best[good] // (BEYOND + 1), best[good] % (BEYOND + 1)
    return np.stack([np.stack([pick[s], *got(pick[s], s)], 1) for s in (0, 1)], 1)


def align(d: np.ndarray, o: np.ndarray, dp: list[int], op: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Parts ``(d_start, d_end, o_start, o_end, matched)`` along a chain of matches ``dp, op`` in words ``d`` and ``o``.

    A chain that is alike enough as a whole is one part; else it is split where more words differ than are equal.
    """
    parts, end_d, end_o = [], dp[0], op[0]
    start_d, start_o, matched, total = dp[0], op[0], 0, 0
    for x, y in zip(dp, op):
        gap_d, gap_o = x - end_d, y - end_o
        if gap_d < 0 or gap_o < 0:
            if gap_d != gap_o:  # overlaps the match before it on another diagonal
                continue
            matched += K + gap_d
            total += K + gap_d
        else:
            same = int((d[end_d:x] == o[end_o:y]).sum()) if gap_d == gap_o else _between(d[end_d:x], o[end_o:y])
            gap = max(gap_d, gap_o)
            total += same + K
            if gap > 8 and 2 * same < gap:
                parts.append((start_d, end_d, start_o, end_o, matched))
                start_d, start_o, matched, same = x, y, 0, 0
            matched += same + K
        end_d, end_o = x + K, y + K
    if total >= LIKENESS * max(end_d - dp[0], end_o - op[0]):
        return [(dp[0], end_d, op[0], end_o, total)]
    parts.append((start_d, end_d, start_o, end_o, matched))
    return parts


#: What names a chain: its documents and the places of its first and last seeds.
_OWN = ["doc_id", "other_id", "d0", "d1", "o0", "o1"]
_PARTS = "doc_id long, other_id long, start long, end long, other_start long, other_end long, matched long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chain's words, sorted so that its two sides follow each other, to parts that are alike enough."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    read = lambda raw: np.frombuffer(raw, "<u4")

    def done(pairs: list[tuple[dict, dict]]) -> pa.RecordBatch:
        inner = []
        for p, q in pairs:
            d0, o0 = p["d"][0], p["o"][0]
            if p["solid"]:
                n = p["d"][-1] + K - d0
                inner.append([(0, n, 0, n, n)])
            else:
                inner.append(align(read(p["body"]), read(q["body"]), [x - d0 for x in p["d"]], [y - o0 for y in p["o"]]))
        tails = outward([read(p["tail"]) for p, _ in pairs], [read(q["tail"]) for _, q in pairs])
        heads = outward([read(p["head"])[::-1] for p, _ in pairs], [read(q["head"])[::-1] for _, q in pairs])
        # a part inside a chain that was split has its chain's end on one side only
        core, side, of = [], [[], []], []
        for i, parts in enumerate(inner):
            for k, part in enumerate(parts):
                core.append((part[1] - part[0], part[3] - part[2], part[4]))
                side[0].append(i if k == 0 else -1)
                side[1].append(i if k == len(parts) - 1 else -1)
                of.append((i, part))
        core = np.array(core, np.int64)
        closed = lambda found, who: tuple(np.where((np.array(who) >= 0)[:, None] | (np.arange(BEYOND + 1) == 0), c[who], -1) for c in found)
        more = ends(core, [closed(heads, side[0]), closed(tails, side[1])])
        out = []
        for (i, (a, b, c, e, m)), ((xa, ya, ma), (xb, yb, mb)) in zip(of, more.tolist()):
            p = pairs[i][0]
            d0, o0 = p["d"][0], p["o"][0]
            start, end, other_start, other_end, m = d0 + a - xa, d0 + b + xb, o0 + c - ya, o0 + e + yb, m + ma + mb
            if end - start >= LEAST_PART and m >= LIKENESS * max(end - start, other_end - other_start) - 1e-9:
                out.append((p["doc_id"], p["other_id"], start, end, other_start, other_end, m))
        return pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names)

    own, asked, pairs = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[c] for c in _OWN)
            if key != own:
                own, asked = key, []
            if r["side"] == 0:
                asked.append(r)
            else:  # chains of the same bounds ask for the same words of the other document
                pairs += [(x, r) for x in asked]
                asked = []
            if len(pairs) >= 1000:
                yield done(pairs)
                pairs = []
    if pairs:
        yield done(pairs)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            some = b.slice(at, 1024)
            words, n = word_hashes(some.column(1))
            ends = np.append(0, 4 * np.cumsum(n)).astype(np.int32)
            yield pa.record_batch([some.column(0), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(words.astype("<u4").tobytes())])], ["at", "words"])


def _aligned(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """Parts that are alike enough along ``chains``, with words (hashes of 32 bits) from ``docs``."""
    key = ["doc_id", "other_id", *(F.element_at(c, i).alias(f"{c}{j}") for c in "do" for i, j in ((1, 0), (-1, 1)))]
    none = F.lit(None).cast("array<int>")
    one = lambda at, side, c, d, o: chains.select(*key, F.lit(side).alias("side"), "solid", F.col(at).alias("at"), F.element_at(c, 1).alias("a"), (F.element_at(c, -1) + K).alias("b"), d.alias("d"), o.alias("o"))
    asked = one("doc_id", 0, "d", F.col("d"), F.col("o")).unionByName(one("other_id", 1, "o", none, none))
    words = docs.mapInArrow(lean(_word_rows), "at long, words binary").where("length(words) > 0")
    part = lambda a, b: F.substring("words", 4 * a + 1, 4 * (b - a))
    low = F.greatest(F.lit(0), F.col("a") - BEYOND)
    given = asked.join(words, "at").select(
        *_OWN, "side", "solid", "d", "o",
        part(low, F.col("a")).alias("head"), F.when(~F.col("solid"), part(F.col("a"), F.col("b"))).alias("body"), part(F.col("b"), F.col("b") + BEYOND).alias("tail"),
    )
    return stored(given.repartition(*_OWN).sortWithinPartitions(*_OWN, "side").mapInArrow(lean(_parts), _PARTS), "parts")


def _merged(parts: DataFrame) -> DataFrame:
    """``parts`` with the bounds of the merged passage that each belongs to, where that has ``LEAST_WORDS``."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "other_id", "other_start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    islands = parts.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    whole = Window.partitionBy("doc_id", "island")
    out = islands.withColumn("passage_start", F.min("start").over(whole)).withColumn("passage_end", F.max("end").over(whole))
    return out.where(F.col("passage_end") - F.col("passage_start") >= LEAST_WORDS).drop("new", "island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Parts of ``docs(doc_id, text)`` that stand in a document of a smaller id.

    ``doc_id, other_id, start, end, other_start, other_end, matched, passage_start, passage_end``: places are words of the
    whole text, ends excluded; the last two bound the merged passage, of ``LEAST_WORDS`` and more, that the part belongs
    to.  ``docs`` is read twice, and once for its size.

    Documents without words, with null text or without a repeated passage give no row, and an empty table gives none; rows
    without ``doc_id`` are left out; rows that share an id count as one document, whose rows are not compared with each
    other.  A text of any length is one row and is taken whole.  Of equal occurrences the one of the smallest id, then the
    smallest place, is the first.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # a bucket holds the seeds of about so much text, and is taken by one task at a time
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    matches, held = _matches(own.mapInArrow(lean(_seed_dealer(buckets)), _DEALT), "seeds")
    chains = _chained(matches, "chains", True)
    dropped(held)
    loose = chains.where("other_id is null").select("doc_id", "h", "d")
    again = _chained(_by_bucket(loose.mapInArrow(lean(_key_dealer(buckets)), _DEALT), True), "chains", False)
    both = chains.where("other_id is not null").unionByName(again)
    parts = _aligned(both, own)
    dropped(chains, again)
    return _merged(parts.distinct())


def cut_passages(text: str | None, passages: list[tuple[int, int]]) -> str | None:
    """``text`` without the words from each start to before each end, and the white space between them."""
    if text is None or not passages:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(passages):
        a, b = max(0, a), min(b, len(spans))
        if a < b and spans[b - 1][1] > at:
            out.append(text[at : max(at, spans[a][0])])
            at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without the passages that stand in a document of a smaller id, where they stay.

    All columns return; ``chars``, where it is one, is the new length.  Documents that were all repeats go; rows with null
    text or null id stay as they are.
    """
    names = docs.columns
    own_id, own_cuts = "_id", "_cuts"
    while {own_id, own_cuts} & {n.lower() for n in names}:
        own_id, own_cuts = f"_{own_id}", f"_{own_cuts}"
    found = repeated_passages(docs).select("doc_id", "passage_start", "passage_end").distinct()
    cuts = found.groupBy(F.col("doc_id").alias(own_id)).agg(F.array_sort(F.collect_list(F.struct("passage_start", "passage_end"))).alias(own_cuts))
    # by a shuffle at any size: the cuts grow with the documents
    joined = docs.join(cuts.hint("merge"), docs["doc_id"] == cuts[own_id], "left").drop(own_id)
    at, schema = names.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            new = [cut_passages(t, [(c["passage_start"], c["passage_end"]) for c in x or ()]) for t, x in zip(texts, cuts)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(new, columns[at].type)
            if chars in names:
                k = names.index(chars)
                columns[k] = pa.array([n if not x else len(t) for n, t, x in zip(columns[k].to_pylist(), new, cuts)], columns[k].type)
            keep = pa.array([not x or bool(t.strip()) for t, x in zip(new, cuts)], pa.bool_())
            yield pa.record_batch(columns, names).filter(keep)

    return joined.mapInArrow(lean(run), schema)
