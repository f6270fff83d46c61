"""Packing by minimum bin slack.

A document's ids are cut into full windows and one remainder.  Full windows stand alone; remainders wait in a bounded
buffer of one task.  The largest waiting remainder opens a sequence, and a subset-sum programme over a bitset of reachable
sums picks, from the counts of the waiting lengths, the multiset that comes closest to the capacity; layers of the bitset
are walked back to get the counts, and the multiset is used as often as the counts allow.  Nothing is shuffled: every task
packs its own documents.  What is left at a task's end is cut at the capacity, so a task leaves one sequence that is not
full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmark.llm.shared import lean
from findmark.llm.tokens import encoder

#: Remainders that wait before a round of packing.
WAITING = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, ``{length: times}`` within ``counts``, with the largest sum that is at most ``room``.

    Longer lengths are preferred on equal sums.  No length fits: an empty multiset.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((k for k in counts if 0 < k <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            grown = (reach | (reach << (length * times))) & mask
            if grown != reach:
                layers.append((length, times, reach))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(layers):
        if not before >> target & 1:
            used[length] += times
            target -= length * times
    return dict(used)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets that use all of ``counts``, and how often each is used."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        first = max(counts)
        rest = counts | {first: counts[first] - 1}
        used = best_fill(rest, capacity - first)
        used[first] = used.get(first, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: see ``SCHEMA``.

    Null text is the empty text, which has the end id alone; rows without ``doc_id`` are left out; rows that share an id
    are packed one by one.  A text of any length is encoded whole and cut into windows; other columns are not read; an empty
    table gives no row.  ``sequence_id`` has the task's number in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, next_id = encoder(tokenizer_path, end_id), TaskContext.get().partitionId() << 32
        waiting: dict[int, deque] = defaultdict(deque)
        rows: list[tuple] = []
        n_waiting = 0

        def add(piece: tuple, sequence: int, offset: int) -> None:
            doc_id, start, ids, total = piece
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        def fill(last: bool) -> None:
            """Packs what waits; before the end, sequences with slack wait on, unless no other came about."""
            nonlocal next_id, n_waiting
            planned = plan({k: len(v) for k, v in waiting.items()}, capacity)
            full = [p for p in planned if sum(k * n for k, n in p[0].items()) == capacity]
            tail: list[tuple] = []
            for used, times in full if last or full else planned:
                for _ in range(times):
                    offset = 0
                    for k in sorted(used, reverse=True):
                        for _ in range(used[k]):
                            add(waiting[k].popleft(), next_id, offset)
                            offset += k
                            n_waiting -= 1
                    next_id += 1
            if last:
                for used, times in planned:
                    if (used, times) not in full:
                        tail += [waiting[k].popleft() for _ in range(times) for k in sorted(used, reverse=True) for _ in range(used[k])]
                offset = 0
                for doc_id, start, ids, total in tail:
                    at = 0
                    while at < len(ids):
                        part = ids[at : at + capacity - offset]
                        add((doc_id, start + at, part, total), next_id, offset)
                        at, offset = at + len(part), offset + len(part)
                        if offset == capacity:
                            next_id, offset = next_id + 1, 0
            for k in [k for k, v in waiting.items() if not v]:
                del waiting[k]

        def batch_of() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], [c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for first, ids, ends in tokens.slices(batch.column(1)):
                begin = 0
                for doc_id, end in zip(batch.column(0)[first : first + len(ends)].to_pylist(), ends.tolist()):
                    own, total = ids[begin:end], end - begin
                    whole = total - total % capacity
                    for at in range(0, whole, capacity):
                        add((doc_id, at, own[at : at + capacity], total), next_id, 0)
                        next_id += 1
                    if whole < total:
                        waiting[total - whole].append((doc_id, whole, own[whole:].copy(), total))
                        n_waiting += 1
                        if n_waiting >= WAITING:
                            fill(False)
                    if len(rows) >= 20_000:
                        yield batch_of()
                    begin = end
        fill(True)
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null").mapInArrow(lean(run, keeps=True), SCHEMA)
