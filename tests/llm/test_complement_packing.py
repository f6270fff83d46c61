"""Packing by exact complements: sums, plans and places by brute force, and whole rows."""

import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from findmark.llm import complement_packing as C
from findmark.llm import entries
from findmark.llm.tokens import Encoder

PATH = entries.tokenizer_path(entries.WORD_BPE)
DOCS = "doc_id long, text string, length long, task string"  # the last two clash with names inside
LONG = "word " * 5_000


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_of_words_equals_whole_texts(ids):
    texts = [None, "", " ", "a  b", " a ", "a\n b", "don't I'LL 12 !?", "é\tè", "a　 b", "a\xa0b c", "\x1c a\x1d b", "<|endoftext|> a", "a<|endoftext|>b. C", "ab.\nCd,e (f)", "한글 中文 abc.", "é ́a", "İİ.ß", "word.'s it's 'S", "Σας. ΑΣ", "a\x85b\x0bc", "<|startoftext|>x", "#a |b", LONG]
    tokens = Encoder(PATH)
    assert tokens.words
    flat, ends = tokens.encode(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends):
        assert flat[begin:end].tolist() == ids(text).tolist(), text
        begin = end


def test_sums_of_one_two_and_three_lengths():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {rnd.randint(1, 25): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        index = C.Complements(counts, 40)
        for gap in range(1, 41):
            sums = {n for n in (1, 2, 3) for x in combinations_with_replacement(sorted(counts), n) if sum(x) == gap and all(m <= counts[k] for k, m in Counter(x).items())}
            found = index.find(gap)
            assert len(found) == min(sums, default=0) and (not found or sum(found) == gap)
            assert all(m <= counts[k] for k, m in Counter(found).items())


@pytest.mark.parametrize("kind", ["spread", "long", "short", "one", "few"])
def test_plan_uses_all_pieces_in_few_sequences(kind):
    rnd = random.Random(2)
    size = {"spread": lambda: min(2047, int(rnd.lognormvariate(6, 1.2)) + 1), "long": lambda: rnd.randint(1025, 2047), "short": lambda: rnd.randint(1, 60), "one": lambda: 683, "few": lambda: rnd.choice([1200, 900, 848, 700, 324])}[kind]
    counts = Counter(size() for _ in range(20_000))
    planned = C.plan(dict(counts), 2048)
    used = Counter()
    for multiset, times in planned:
        assert times > 0 and sum(k * n for k, n in multiset.items()) <= 2048
        for k, n in multiset.items():
            used[k] += n * times
    assert used == counts
    total, bins = sum(k * n for k, n in counts.items()), sum(t for _, t in planned)
    best = {"long": 20_000, "one": 10_000}.get(kind, -(-total // 2048))
    assert bins <= best * (1.05 if kind == "few" else 1) + 1
    where = C.Places(planned)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    sequence, offset = where.of(length, np.concatenate([np.arange(n) for n in counts.values()]))
    order = np.lexsort((offset, sequence))
    length, sequence, offset = length[order], sequence[order], offset[order]
    begin = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset[begin] == 0).all() and (offset[1:][~begin[1:]] == (offset + length)[:-1][~begin[1:]]).all() and begin.sum() == bins


def packed_rightly(rows, docs, ids):
    of = {}
    for i, text, *_ in docs:
        of.setdefault(i, []).append(ids(text))
    sequences, seen = {}, Counter()
    for r in rows:
        assert any(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in of[r.doc_id])
        assert r.start == r.piece * 2048 and r.length <= 2048
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in of.items() if i is not None}
    for pieces in sequences.values():
        end = 0
        for a, n in sorted(pieces):
            assert a == end
            end += n
        assert end <= 2048
    return len(sequences)


def test_rows_packed_over_several_tasks(spark, ids):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["a", "bc", "def"]) for _ in range(rnd.randint(0, 900))), 0, "") for i in range(600)]
    docs += [(5000 + i, LONG, 0, "") for i in range(3)]
    rows = C.pack(spark.createDataFrame(docs, DOCS).repartition(7), PATH).collect()
    total = sum(len(ids(t)) for _, t, *_ in docs)
    assert packed_rightly(rows, docs, ids) <= -(-total // 2048) + 1


def test_odd_rows(spark, ids):
    docs = [(1, None, 0, ""), (2, "", 0, ""), (None, "no id", 0, ""), (4, LONG, 0, ""), (5, "same text", 0, ""), (5, "same text", 0, ""), (6, "word " * 2047, 0, ""), (7, "word " * 2048, 0, "")]
    df = spark.createDataFrame(docs, DOCS)
    packed_rightly(C.pack(df, PATH).collect(), docs, ids)
    assert C.pack(df.where("false"), PATH).count() == 0
