"""What Python workers keep from task to task, and how much text they get at once."""

import numpy as np
import pyarrow as pa
import pytest

from findmark.llm import entries, packing, shared, tokens

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batches(spark):
    before = spark.conf.get(BYTES)
    yield
    spark.conf.set(BYTES, before)


def test_a_worker_gives_its_encoder_up_for_other_work():
    own = tokens.encoder(entries.tokenizer_path())
    assert list(shared.lean(iter, keeps=True)([1])) == [1] and tokens.encoder(entries.tokenizer_path()) is own
    assert list(shared.lean(iter)([1])) == [1] and tokens.encoder(entries.tokenizer_path()) is not own
    shared.forget()


def test_workers_are_used_again_without_an_encoder(spark):
    docs = spark.range(0, 40, 1, 2).selectExpr("id as doc_id", "repeat('some words ', 50) as text")
    count = lambda batches: (pa.record_batch([pa.array([len(shared._kept) for _ in batches], pa.int64())], ["n"]) for _ in "x")
    assert packing.pack(docs, entries.tokenizer_path()).count() >= 40
    assert {r.n for r in docs.mapInArrow(shared.lean(count), "n long").collect()} == {0}


def test_slices_are_the_whole(monkeypatch):
    texts = pa.array(["a b", None, "", "long text " * 40, "é c, d", " \n ", "end"] * 5)
    own = tokens.Encoder(entries.tokenizer_path())
    ids, ends = own.encode(texts)
    monkeypatch.setattr(tokens, "SLICE", 64)
    got = list(own.slices(texts))
    sizes = np.concatenate([np.diff(e, prepend=0) for _, _, e in got])
    assert len(got) > 5 and [a for a, _, _ in got] == np.append(0, np.cumsum([len(e) for _, _, e in got]))[:-1].tolist()
    assert np.concatenate([i for _, i, _ in got]).tolist() == ids.tolist() and np.cumsum(sizes).tolist() == ends.tolist()
    assert list(own.slices(texts[:0])) == [] and [len(x) for x in own.encode(texts[:0])] == [0, 0]


def test_stages_take_texts_in_small_batches(spark, batches):
    import corpus_pipeline

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 300) as text", "'en' as lang")
    corpus_pipeline.packed(spark, docs, "")
    size = lambda batches: (pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)
    n = [r.n for r in docs.mapInArrow(size, "n long").collect()]
    assert sum(n) == 3000 and max(n) < 1000


def test_pieces_do_not_depend_on_batches(spark, batches):
    docs = spark.range(0, 900, 1, 1).selectExpr("id as doc_id", "if(id % 9 = 0, null, repeat(concat('w', id, ' x'), cast(id * 7 % 800 as int))) as text")
    found = []
    for size in (64 << 20, 4096):
        spark.conf.set(BYTES, size)
        found.append(sorted(map(tuple, packing.pack(docs, entries.tokenizer_path()).collect())))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 900
