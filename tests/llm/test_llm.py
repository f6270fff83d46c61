"""The training-data operators on small rows: brute force, round trips, accuracy and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findmark.llm import chat_format, entries, langid, line_rules, mixing, packing, passages, quality_gam, rans_tokens, simhash, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row long, fp long"  # the last two clash with names inside
LONG = "word " * 30_000
ODD = [(1, None, None, None, 0, 0), (2, "", "en", "a", 0, 0), (3, " \n ", "en", "a", 0, 0), (None, "no id", "en", "a", 0, 0), (4, LONG, "en", "a", 0, 0), (5, "same text here now", "en", None, 0, 0), (5, "same text here now", "en", None, 0, 0), (6, "a\n\nb  c <|endoftext|> é", "fr", "b", 0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entries.tokenizer_path())
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_whole_texts(ids):
    import pyarrow as pa

    from findmark.llm.tokens import Encoder

    texts = [None, "", " ", "a  b", " a ", "a\n b", "a \nb", "a\n\n", "a\n\nb c", "x\x01y z", "don't I'll 12 !?", "é\tè", "a　 b", "a b c", "\x1c a", " Ġ q", "<|endoftext|> a", "ab.\nCd,e (f)", "한글 中文 abc.", LONG]
    flat, ends = Encoder(entries.tokenizer_path()).encode(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends):
        assert flat[begin:end].tolist() == ids(text).tolist(), text
        begin = end


def test_token_files(spark, odd, ids):
    rows = sorted(rans_tokens.token_digests(spark, rans_tokens.write_token_ids(odd, entries.tokenizer_path())).collect())
    start = 0
    for r, (_, text, *_) in zip(rows, sorted((x for x in ODD if x[0] is not None), key=lambda x: x[0]), strict=True):
        own = ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert rans_tokens.token_digests(spark, rans_tokens.write_token_ids(odd.where("false"), entries.tokenizer_path())).count() == 0


def test_rans_round_trip_sections_and_checksum():
    rnd = np.random.default_rng(1)
    for n, high in ((1, 2), (1023, 60_000), (300_000, 500), (140_000, 1)):
        own = rnd.integers(0, high, n).astype("<u2")
        raw = rans_tokens.pack_segment(np.array([7]), np.array([n]), own)
        assert (rans_tokens.unpack_segment(raw)[2] == own).all()
        table = rans_tokens.Table(*rans_tokens.frequencies(own))
        block = rans_tokens.encode_block(own[: rans_tokens.BLOCK], table)
        step = rans_tokens.SECTION * rans_tokens.LANES
        for s in range(-(-min(n, rans_tokens.BLOCK) // step)):
            assert (rans_tokens.decode_block(block, table, s) == own[: rans_tokens.BLOCK][s * step : (s + 1) * step]).all()
    many = np.append(np.arange(270_000, dtype="<u4"), rnd.integers(0, 300_000, 30_000).astype("<u4"))  # more ids than frequencies sum to
    assert (rans_tokens.unpack_segment(rans_tokens.pack_segment(np.array([7]), np.array([300_000]), many))[2] == many).all()
    with pytest.raises(ValueError):
        rans_tokens.unpack_segment(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_packing(spark, odd, ids):
    rows = packing.pack(odd, entries.tokenizer_path()).collect()
    texts = {i: t for i, t, *_ in ODD}
    sequences = {}
    for r in rows:
        own = ids(texts[r.doc_id])
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(ids(t)) for i, t, *_ in ODD if i is not None)
    for pieces in sequences.values():
        end = 0
        for a, n in sorted(pieces):
            assert a == end
            end += n
        assert end <= 1024


def test_best_fill_is_best():
    rnd = random.Random(2)
    for _ in range(200):
        counts, room = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}, rnd.randint(1, 40)
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * j for s in sums for j in range(n + 1)}
        used = packing.best_fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plan_leaves_little_room():
    rnd = random.Random(22)
    counts = {}
    for _ in range(20_000):
        k = min(1023, int(rnd.lognormvariate(5.5, 1)) + 1)
        counts[k] = counts.get(k, 0) + 1
    planned = packing.plan(counts, 1024)
    used = {}
    for multiset, times in planned:
        assert sum(k * n for k, n in multiset.items()) <= 1024
        for k, n in multiset.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    bins, tokens = sum(t for _, t in planned), sum(k * n for k, n in counts.items())
    assert bins <= 1.002 * tokens / 1024 + 2


def test_packing_of_many_remainders(spark):
    rnd = random.Random(23)
    rows = [(i, " ".join(rnd.choice(["a", "bc", "def"]) for _ in range(rnd.randint(1, 300)))) for i in range(packing.WAITING + 2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, entries.tokenizer_path()).collect()
    length = {}
    for r in pieces:
        length[r.sequence_id] = length.get(r.sequence_id, 0) + r.length
    total = sum(length.values())
    assert len({(r.doc_id, r.start) for r in pieces}) == len(pieces) and sum({r.doc_id: r.doc_tokens for r in pieces}.values()) == total
    assert max(length.values()) <= 1024 and len(length) <= 1.002 * total / 1024 + 2
    assert packing.pack(df.where("false"), entries.tokenizer_path()).count() == 0


def test_ids_of_four_bytes_and_other_tokenizers(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    from findmark.llm.tokens import Encoder

    rnd = np.random.default_rng(24)
    own = rnd.integers(0, 200_000, 50_000).astype("<u4")
    assert (rans_tokens.unpack_segment(rans_tokens.pack_segment(np.array([7]), np.array([50_000]), own))[2] == own).all()
    other = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"[UNK]": 70_000}, "[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "words.json"))
    ids, ends = Encoder(str(tmp_path / "words.json")).encode(pa.array(["w1 w69999", None, "w2.x"]))
    assert ids.dtype == "<u4" and ids.tolist() == [1, 69_999, 0, 0, 2, 70_000, 70_000, 0] and ends.tolist() == [3, 4, 8]


def test_simhash_links_like_brute_force(spark):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(150)]
    fps = {0, (1 << 64) - 1} | {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for s in seeds for _ in range(12)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df).distinct().collect()
    label = {}

    def root(x):
        while label.get(x, x) != x:
            x = label[x]
        return x

    def classes(pairs):
        label.clear()
        for a, b in pairs:
            label[root(a)] = root(b)
        return {frozenset(g) for g in (lambda d: [d[root(int(x))].append(int(x)) or d for x in fps] and d)(__import__("collections").defaultdict(list)).values()}

    brute = [(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1]
    got = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links]
    assert set(got) <= {tuple(sorted(p)) for p in brute} and classes(got) == classes(brute)


def test_components_of_long_chains(spark):
    from findmark.llm.shared import components

    rnd = random.Random(10)
    mixed = rnd.sample(range(1000, 100_000), 400)
    chains = [*zip(range(2, 100), range(3, 101)), (100, 1), *zip(mixed, mixed[1:])]
    got = {r.node: r.root for r in components(spark.createDataFrame(chains, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 101)} | {i: min(mixed) for i in mixed}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_odd_rows(spark, odd):
    rows = simhash.near_copies(odd).collect()
    assert len(rows) == 7 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.fingerprint for r in rows if r.doc_id == 2} == {"0" * 16}
    assert simhash.fingerprint("A b C d") == simhash.fingerprint("a  B\tc D") != 0
    assert simhash.near_copies(odd.where("false")).count() == 0
    assert {r.doc_id for r in simhash.keep_one(odd).collect()} == {None, 1, 4, 5, 6}
    assert simhash.keep_one(odd.where("false")).count() == 0


def test_near_copies_with_a_hot_text_like_brute_force(spark):
    rnd = random.Random(25)
    make = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    base = make(300)
    texts = [" ".join(base)] * 900 + [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(40)] + [" ".join(make(12)) for _ in range(1500)]
    rnd.shuffle(texts)
    fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    of = list(range(len(texts)))  # the smallest neighbour's label, until none moves
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 4) for f in fps]
    while (now := [min(of[j] for j in near[i]) for i in range(len(texts))]) != of:
        of = now
    rows = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(set(fps.tolist())) > simhash.HOT
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == [(i, f"{int(f):016x}", c) for i, (f, c) in enumerate(zip(fps, of))]


def test_fingerprint_like_a_plain_loop():
    from xxhash import xxh64_intdigest

    rnd = random.Random(16)
    for n in (0, 1, 3, 4, 5, 60):
        words = [rnd.choice(["One", "two", "\u00c9t\u00e9", "x"]) for _ in range(n)]
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        shingles = [" ".join(low[i : i + 4]) for i in range(len(low) - 3)] or ([" ".join(low)] if low else [])
        h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
        wanted = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(" \t".join(words)) == wanted


def test_large_cells_are_dealt_again(spark):
    rnd = np.random.default_rng(17)
    high = rnd.integers(0, 2**32, 3000).astype(np.uint64)
    near = high[:1500]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rnd.integers(0, 32, len(near)).astype(np.uint64))
    fps = np.unique(np.concatenate([high, near]) << np.uint64(32) | np.uint64(0x12345678))  # one cell has them all
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    brute = {(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1}

    def classes(pairs):
        top = {}

        def root(x):
            while top.get(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            top[b] = a
        return {int(x): root(int(x)) for x in fps}

    for large in (1000, 100):
        got = {(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.fingerprint_links(df, large=large).collect()}
        assert got <= brute and classes(got) == classes(brute)


def test_passages(spark, odd):
    rnd = random.Random(4)
    make = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    shared = make(80)
    changed = [w if i % 25 else "other" for i, w in enumerate(shared)]
    inserted = shared[:40] + ["one", "two"] + shared[40:]
    docs = [(10, make(60) + shared + make(60)), (11, make(30) + shared), (12, changed + make(100)), (13, make(20) + inserted + make(9)), (14, make(300)), (15, make(100) + shared[:30] + make(100))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    rows = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(rows) == {11, 12, 13} and {r.other_id for r in rows.values()} == {10}
    assert (rows[11].start, rows[11].end, rows[11].other_start, rows[11].matched) == (30, 110, 60, 80)
    assert rows[12].end >= 78 and 20 <= rows[13].start <= 22 and rows[13].end >= 100
    left = {r.doc_id: len(r.text.split()) for r in passages.remove_repeats(df, None).collect()}
    assert left[10] == 200 and left[11] == 30 and left[14] == 300 and left[15] == 230
    assert passages.repeated_passages(odd).count() == 0 and passages.remove_repeats(odd, None).count() == len(ODD)
    assert passages.repeated_passages(df.where("false")).count() == 0


def test_passages_behind_short_quotes_like_brute_force(spark):
    rnd = random.Random(11)
    make = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    docs, ids = [], iter(range(10**6))
    for size in (50, 56, 64, 80, 120):
        for quoted, between in ((7, 0), (12, 0), (19, 0), (19, 12), (15, 30)):
            passage = make(size)
            quotes = lambda: [(next(ids), make(15) + passage[i : i + quoted] + make(15)) for i in range(0, size - quoted + 1, 2)]
            docs += quotes() if between else []
            docs.append((next(ids), make(20) + passage + make(9)))
            docs += quotes()
            docs.append((next(ids), passage + make(between)))
    docs.append((next(ids), make(400)))
    earlier, alike = {}, set()
    for i, words in docs:  # every stretch of 50 words that an earlier document has
        own = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        if any(k in earlier for k in own):
            alike.add(i)
        earlier.update(dict.fromkeys(own, i))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert len(alike) == 25 and {r.doc_id for r in rows} == alike
    assert all(r.passage_end - r.passage_start >= 50 for r in rows)
    again = passages.repeated_passages(df.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_passages_like_brute_force(spark):
    rnd = random.Random(12)
    make = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    docs, alike = [], []
    for i in range(150):
        own, other = make(60), []
        for w in own:
            other += rnd.choice([make(1), make(1), make(1), [], [w, *make(1)]]) if rnd.random() < 0.15 else [w]
        row = [0] * (len(other) + 1)
        for x in own:
            last, row = row, [0]
            for j, y in enumerate(other):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        if row[-1] >= passages.LIKENESS * max(len(own), len(other)) and len(other) >= passages.LEAST_WORDS:
            alike.append(2 * i + 1)
        docs += [(2 * i, " ".join(make(70) + own + make(70))), (2 * i + 1, " ".join(make(70) + other + make(70)))]
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(alike) > 120 and len(found & set(alike)) >= 0.9 * len(alike)


def test_seeds_like_a_plain_loop():
    rnd = np.random.default_rng(14)
    n = np.array([0, 3, 5, 6, 8, 40, 1, 300])
    words = rnd.integers(0, 50, n.sum()).astype(np.uint64)
    h, text, place = passages.seeds(words, n)
    wanted, at = [], 0
    for i, size in enumerate(n.tolist()):
        own = words[at : at + size]
        k = []
        for p in range(size - passages.K + 1):
            value = own[p : p + 1].copy()
            for j in range(1, passages.K):
                value = value * np.uint64(0x9E3779B97F4A7C15) + own[p + j]
            k.append(int(passages._mixed(value)[0]))
        windows = range(max(1, len(k) - passages.WINDOW + 1)) if k else []
        wanted += [(k[p], i, p) for p in sorted({min(range(w, min(w + passages.WINDOW, len(k))), key=lambda p: k[p]) for w in windows})]
        at += size
    assert [*zip(h.tolist(), text.tolist(), place.tolist())] == wanted


def test_occurrences_are_matched_with_the_first():
    rnd = np.random.default_rng(15)
    key, doc, place = passages._mixed(rnd.integers(1, 41, 600).astype(np.uint64)), rnd.integers(0, 9, 600), rnd.integers(0, 100, 600)
    batches = [passages._dealt(key[i : i + 200], doc[i : i + 200], place[i : i + 200], 7) for i in (0, 200, 400)]
    import pyarrow as pa

    dealt = pa.Table.from_batches(batches).sort_by("bucket").to_batches()
    rows = [r for b in passages._held(iter(dealt)) for r in b.to_pylist()]
    firsts = {r["h"]: (r["other_id"], r["o"]) for r in rows if r["first"]}
    got = sorted((r["h"] & 0xFFFFFFFF, r["doc_id"], r["p"], *firsts[r["h"]]) for r in rows if r["h"] in firsts)
    wanted = []
    for k in set(key.tolist()):
        own = sorted((int(d), int(p)) for d, p in zip(doc[key == k], place[key == k]))
        if own[0][0] != own[-1][0]:
            wanted += [(k & 0xFFFFFFFF, d, p, *own[0]) for d, p in own]
    assert got == sorted(wanted)


def test_occurrences_are_matched_with_those_before():
    """Over one buffer each one has the first place in the next smaller document; over several each has one of a smaller one."""
    import pyarrow as pa

    rnd = np.random.default_rng(16)
    key, doc, place = passages._mixed(rnd.integers(1, 41, 600).astype(np.uint64)), rnd.integers(0, 30, 600), rnd.integers(0, 100, 600)
    held = {}
    for k, d, p in zip(key.tolist(), doc.tolist(), place.tolist()):
        held.setdefault(k & 0xFFFFFFFF, {}).setdefault(d, []).append(p)
    for step in (600, 100):
        batches = [passages._dealt(key[i : i + step], doc[i : i + step], place[i : i + step], 7, True) for i in range(0, 600, step)]
        rows = [r for b in passages._holder(True)(iter(pa.Table.from_batches(batches).sort_by("bucket").to_batches())) for r in b.to_pylist()]
        got = {(r["h"] & 0xFFFFFFFF, r["doc_id"], r["p"]): (r["other_id"], r["o"]) for r in rows}
        for k, by_doc in held.items():
            for d, own in by_doc.items():
                less = [x for x in by_doc if x < d]
                for p in own:
                    if step == 600:
                        assert got.get((k, d, p)) == ((max(less), min(by_doc[max(less)])) if less else None)
                    elif (k, d, p) in got:
                        assert got[k, d, p][0] in less and got[k, d, p][1] in by_doc[got[k, d, p][0]]
                if step == 100 and less:  # the document is bound to a smaller one by each key
                    assert any((k, d, p) in got for p in own)


def test_fuzzy_passages_behind_quotes(spark):
    """Passages of which 10 to 20 per cent of the words change, whose words earlier documents quote piece by piece."""
    rnd = random.Random(17)
    make = lambda n: [f"w{rnd.randint(0, 20_000)}" for _ in range(n)]
    docs, cells = [], {}
    for size, share in ((50, 0.1), (60, 0.15), (60, 0.2), (80, 0.2)):
        for quote in (0, 12, 18, 30, 45):
            for _ in range(20):
                own = make(size)
                docs += [make(60) + own[a : a + quote] + make(60) for a in range(0, size, quote or size) if quote]
                other = list(own)
                for i in rnd.sample(range(1, size - 1), round(share * size)):
                    other[i] = make(1)[0]
                docs += [make(80) + own + make(80), make(80) + other + make(80)]
                cells.setdefault((size, share, quote), []).append(len(docs) - 1)
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(6)).collect()
    found = {r.doc_id for r in rows if r.passage_start < 105}
    assert {r.doc_id for r in rows} <= {i - k for own in cells.values() for i in own for k in (0, 1)}  # quotes together may make the first one, too
    by_kind = {}
    for (size, share, quote), own in cells.items():
        by_kind.setdefault((size, share, quote > 0), []).extend(i in found for i in own)
    assert {k: sum(v) / len(v) for k, v in by_kind.items() if sum(v) < 0.9 * len(v)} == {}


def test_outward_is_best():
    rnd = np.random.default_rng(13)
    a, b = [rnd.integers(0, 3, rnd.integers(0, 12)) for _ in range(200)], [rnd.integers(0, 3, rnd.integers(0, 9)) for _ in range(200)]
    upto, same = passages.outward(a, b)
    for x, y, j_of, m_of in zip(a, b, upto, same):
        s = np.full((len(x) + 1, len(y) + 1), -99)
        for p in range(len(x) + 1):
            for q in range(len(y) + 1):
                s[p, q] = max([0 if not p + q else -99, *([s[p - 1, q] - 1] if p else []), *([s[p, q - 1] - 1] if q else []), *([s[p - 1, q - 1] + (1 if x[p - 1] == y[q - 1] else -1)] if p and q else [])])
        for p in range(len(x) + 1):
            within = [q for q in range(len(y) + 1) if abs(p - q) <= passages.BAND]
            if within:
                assert m_of[p] <= min(p, j_of[p]) and j_of[p] in within and s[p, j_of[p]] == max(s[p, q] for q in within)
        assert (m_of[len(x) + 1 :] == -1).all()


def test_chain_is_best():
    rnd = random.Random(5)
    for _ in range(100):
        points = sorted({(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(9)})
        d, o = (np.array(x) for x in zip(*points))
        best = {}
        for i, (x, y) in enumerate(points):
            best[i] = max([passages.K, *(passages.K + best[j] - passages.GAP_COST * (x - points[j][0] + y - points[j][1]) for j in range(i) if points[j][0] < x and points[j][1] < y)])
        first = passages.chain(d, o)[0]
        score = passages.K * len(first) - passages.GAP_COST * ((d[first[-1]] - d[first[0]]) + (o[first[-1]] - o[first[0]]))
        assert score == pytest.approx(max(best.values()))
        assert sorted(np.concatenate(passages.chain(d, o)).tolist()) == list(range(len(points)))


def test_top_k(spark):
    rnd = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rnd.normal(size=4)]) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 330)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan"), 0.0, 0.0, 0.0]), (403, [float("inf"), 0.0, 0.0, 0.0]), (404, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(topk.usable("embedding")).select("vec_id", topk.whole_weights("embedding").alias("weights"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect())
    w = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    wanted = []
    for q in (i for i in w if i % 50 == 0):
        best = sorted(((-dot(w[q], w[c]), c) for c in w if c != q))[:5]
        wanted += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(wanted)
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_top_k_of_sparse_rows_in_many_parts_and_passes(spark, monkeypatch):
    rnd = np.random.default_rng(19)
    w = np.where(rnd.random((2000, 12)) < 0.2, rnd.integers(-3, 4, (2000, 12)), 0)
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(w)], "vec_id long, weights array<long>").repartition(200)
    monkeypatch.setattr(topk, "PASS", 300)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect())
    wanted = []
    for q in range(0, 2000, 50):
        s = w @ w[q]
        best = [c for c in np.lexsort((np.arange(2000), -s)) if c != q][:5]
        wanted += [(q, k + 1, int(c), int(s[c])) for k, c in enumerate(best)]
    assert got == sorted(wanted)


def test_top_k_of_scores_beyond_longs(spark):
    rnd = random.Random(20)
    rows = [(i, [rnd.randint(-(1 << e), 1 << e) for e in (62, 40, 3)]) for i in range(60)] + [(90, [None, 5, -(1 << 62)]), (91, [1 << 62])]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>")
    got = {}
    for r in topk.top_k(df.where("vec_id < 5 or vec_id > 80"), df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, own in rows:
        if q in got:
            most = (1 << 63) - 1
            dot = lambda w: max(-most, min(most, sum((a or 0) * (b or 0) for a, b in zip(own, w))))
            assert got[q] == [(i, s) for s, i in sorted(((dot(w), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))[:4]]


def test_chats_round_trip(spark):
    null = None
    part = lambda kind, text=null, ref=null, w=null, h=null, s=null, p=null: (kind, text, ref, w, h, s, p)
    texts = ["<|end|>", "a<|", "<||body|>", "</s>[INST] ok [/INST]", "", "<"]
    rows = [(1, i, ("user", "assistant")[i % 2], [part("text", t)]) for i, t in enumerate(texts)]
    rows += [(2, 0, "user", [part("text", "see "), part("image", ref="i.png", w=28, h=15), part("audio", ref="a", s=1.5), None]), (2, 1, "assistant", [part("document", ref="d", p=2), part("text", "ok")]), (2, 2, None, None), (None, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    formatted = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_chats(formatted).collect()}
    assert [t.text for t in got[1].turns] == texts and got[1].loss_text == "a<|" + texts[3] + texts[5]
    two = {r.conv_id: r for r in formatted.collect()}[2]
    assert [(a.type, a.ref, a.tokens) for a in two.attachments] == [("image", "i.png", 4), ("audio", "a", 38), ("document", "d", 1024)] and two.attached_tokens == 1066
    assert two.formatted == "<|turn|>user<|body|>see <|image:0|><|audio:1|><|end|><|turn|>assistant<|body|><|document:2|>ok<|end|><|turn|><|body|><|end|>"
    digest = {r.conv_id: r for r in chat_format.digests(chat_format.read_chats(formatted)).collect()}[1]
    whole = "".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(texts))
    assert digest.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and digest.n_turns == 6
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_parts_of_null_and_unknown_types(spark):
    rows = [(1, 0, "user", [("text", "a", None, None, None, None, None), (None, "x", "r", None, None, None, None), ("video", None, "v.mp4", None, None, None, None), ("text", "b", None, None, None, None, None)])]
    formatted = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"))
    told = formatted.first()
    assert told.formatted == "<|turn|>user<|body|>a<|unknown:0|><|unknown:1|>b<|end|>" and told.attached_tokens == 0
    assert [tuple(p) for p in chat_format.read_chats(formatted).first().turns[0].parts] == [("text", "a", None, None), (None, None, "r", 0), ("video", None, "v.mp4", 0), ("text", "b", None, None)]


def test_parts_of_chats_round_trip(spark):
    rnd = random.Random(18)
    bits = ["<", "|", "<|", "||", "<||", "|>", "turn|>", "<|turn|>", "<|body|>", "<|end|>", "<|text|>", "text|>", "<|image:0|>", "image:1|>", "a", "\n", ""]

    def part():
        kind = rnd.choice(["text"] * 7 + ["image", "audio", "document", None])
        return kind and (kind, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 4))) if kind == "text" else None, None if kind == "text" else rnd.choice(bits), 28, 15, 2.0, 3)

    rows = [(c, t, rnd.choice(["user", "assistant", "<|", "a<"]), [part() for _ in range(rnd.randint(0, 5))]) for c in range(200) for t in range(rnd.randint(1, 4))]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    own = lambda ps: [(p[0], p[1] if p[0] == "text" else None, p[2]) for p in ps if p and (p[0] != "text" or p[1])]
    wanted, loss = {}, {}
    for c, _, role, ps in rows:
        wanted.setdefault(c, []).append((role, own(ps)))
        loss[c] = loss.get(c, "") + "".join(p[1] for p in own(ps) if role == "assistant" and p[0] == "text")
    for r in chat_format.read_chats(chat_format.format_chats(df)).collect():
        assert [(t.role, [(p.type, p.text, p.ref) for p in t.parts]) for t in r.turns] == wanted[r.conv_id] and r.loss_text == loss[r.conv_id]


def test_line_rules(spark, odd):
    text = "a b c a b c\nx\nx\n# x"
    assert line_rules.measure(text) == (10, 10, 1, 1, 6) and line_rules.measure(None) == (0, 0, 0, 0, 0)
    own = " ".join(f"u{i}" for i in range(60))
    docs = [(i, ("the shared line " * 5).strip() + "\n" + " ".join(f"d{i}x{j}" for j in range(60 if i % 2 else 10)), "h") for i in range(60)]
    docs = [(i, t + "\n" + " ".join(f"e{i}x{j}" for j in range(50)) if i % 2 else (("the shared line " * 20).strip() + "\n" + " ".join(f"d{i}x{j}" for j in range(10)))) for i, t, _ in docs] + [(99, own)]
    df = spark.createDataFrame([(*d, "h") for d in docs], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in line_rules.apply_rules(df).collect()}
    assert rows[1].kept and rows[1].removed_words == 15 and rows[99].kept and not rows[2].kept
    assert line_rules.apply_rules(odd).count() == len(ODD) and line_rules.apply_rules(odd.where("false")).count() == 0


def test_boilerplate_lines_go(spark, odd):
    own = lambda i: " ".join(f"d{i}x{j}" for j in range(60))
    df = spark.createDataFrame([(i, f"The  shared LINE\n{own(i)}\n\nthe shared line", "h", 0) for i in range(30)] + [(30, own(30), "h", 7), (31, "the shared line\n" + own(31), None, 8), (32, None, "h", 9)], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in line_rules.remove_lines(df).collect()}
    assert all(got[i].text == f"{own(i)}\n" and got[i].n_chars == len(got[i].text) for i in range(30))
    assert got[30].n_chars == 7 and got[31].text == "the shared line\n" + own(31) and got[32].text is None
    words = lambda t: len((t or "").split())
    before = {r.doc_id: words(r.text) for r in df.collect()}
    assert {r.doc_id: r.removed_words for r in line_rules.apply_rules(df).collect()} == {i: before[i] - words(r.text) for i, r in got.items()}
    assert line_rules.remove_lines(odd).columns == odd.columns and line_rules.remove_lines(odd).count() == len(ODD)


def test_mixing_hits_targets(spark, odd):
    rnd = random.Random(7)
    rows = [(i, "word " * rnd.randint(1, 30), rnd.choice(["en", "en", "en", "fr"]), rnd.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.weighted(df, {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.5, "fr": 0.5}})
    for column, shares in (("source", {"a": 0.5, "b": 0.3, "c": 0.2}), ("lang", {"en": 0.5, "fr": 0.5})):
        got = {r[0]: r[1] for r in out.groupBy(f"row.{column}").agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
        total = sum(got.values())
        assert all(got[k] / total == pytest.approx(v, abs=1e-4) for k, v in shares.items())
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.sample(odd.where("false")).count() == 0
    assert out.select("off_target").distinct().first()[0] < 1e-6
    # a source that one language alone has cannot have more than that language
    rows = [(i, "word " * 10, "ab"[i % 2], "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="missed"):
        out = mixing.weighted(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"a": 0.5, "b": 0.5}})
    assert out.first().off_target == pytest.approx(0.4)


def test_a_tiny_cell_does_not_set_the_size_of_the_mixture(spark):
    rnd = random.Random(9)
    rows = [(i, "word " * 20, rnd.choice(["en", "en", "en", "fr"]), rnd.choice("aaab")) for i in range(4000)]
    for extra in ([], [(9001, "ten words " * 5, None, None)]):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string")
        out = mixing.weighted(df, budget=mixing.BUDGET)
        kept, total = out.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
        assert kept / total == pytest.approx(mixing.BUDGET, abs=1e-4)
        assert out.where("probability < 0 or probability > 1 + 1e-9").count() == 0
        assert mixing.sample(df).count() / df.count() == pytest.approx(mixing.BUDGET, abs=0.05)
        assert all(r.probability == pytest.approx(1) for r in out.where("row.source is null").collect())
        shares = {r[0]: r[1] / kept for r in out.groupBy("row.source").agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
        own = {r[0]: r[1] / total for r in out.groupBy("row.source").agg(F.sum("tokens")).collect()}
        assert shares["a"] / shares["b"] == pytest.approx((own["a"] / own["b"]) ** mixing.TEMPER, rel=1e-2)


def test_budget_is_filled_alike_by_order_and_by_rounds(spark):
    """The factor from sums in order, from rounds over the rows, and by halving."""
    rnd = random.Random(19)
    for budget in (0.1, 0.5, 0.999, 1.0):
        own = [rnd.random() for _ in range(40)] + [0.2, 0.2]
        wish = [rnd.choice([0.0, rnd.random(), rnd.random() ** 4]) for _ in range(40)] + [0.1, 0.1]
        own = [x / sum(own) for x in own]
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(x, w * mid) for x, w in zip(own, wish)) < budget else (low, mid)
        df = spark.createDataFrame(list(zip(range(42), own, wish)), "i int, own double, wish double")
        for few in (True, False):
            got = [r.x for r in mixing._filled(df.coalesce(1), "own", "wish", budget, few, "x").orderBy("i").collect()]
            assert got == pytest.approx([min(x, w * high) for x, w in zip(own, wish)], abs=1e-9)


def test_many_cells_are_raked_like_few(spark, monkeypatch):
    rnd = random.Random(22)
    rows = [(i, "word " * rnd.randint(1, 9), rnd.choice(["en", "fr", None]), rnd.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = []
    for most in (mixing.MOST_BROADCAST, 0):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        got.append(sorted((r[0], r[1]) for r in mixing.weighted(df).select("row.doc_id", "probability").collect()))
    assert [i for i, _ in got[0]] == [i for i, _ in got[1]] and [p for _, p in got[0]] == pytest.approx([p for _, p in got[1]])


def test_columns_of_any_name_stay(spark):
    names = ["_id", "_cuts", "_row", "_m0", "_p", "_tokens", "_topic", "_probability", "_kept", "row"]
    texts = ["one two three four five six", " ".join(f"w{i}" for i in range(90)), "x " + " ".join(f"w{i}" for i in range(90))]
    df = spark.createDataFrame([(i, t, "en", "a", *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for out in (mixing.sample(df), passages.remove_repeats(df), simhash.keep_one(df), langid.keep_known(df, langid.learn(df))):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert {r.doc_id: len(r.text.split()) for r in passages.remove_repeats(df).collect()} == {0: 6, 1: 90, 2: 1}


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = entries.op10_rank_order_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    profiles = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, profiles).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert {r.doc_id for r in langid.keep_known(odd, profiles).collect()} == {None, 4, 5, 6}
    assert langid.learn(odd.where("false")).predict("text") == ("und", 0.0)


def test_a_language_whose_rows_share_an_id(spark):
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(n, "das haus und der garten", f"d{n}") for n in range(6) for _ in range(1500)]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.langs == ["d0", "d1", "d2", "d3", "d4", "d5", "en"]


def test_empty_tables(spark, odd):
    none = odd.where("false")
    profiles = langid.learn(spark.createDataFrame([(1, "the house", "en")], "doc_id long, text string, lang string"))
    assert langid.predict(none, profiles).count() == 0 and langid.keep_known(none, profiles).count() == 0 and langid.keep_known(none, profiles).columns == odd.columns
    assert langid.learn(none).langs == [] and line_rules.remove_lines(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_gam.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality_gam.score(docs.where("false"), model).count() == 0


def test_distance_like_a_plain_loop(spark):
    rnd = random.Random(20)
    texts = [("en", "the cat and the dog sat there"), ("de", "der hund und die katze waren dort"), ("xx", "der cat sat")]
    profiles = langid.learn(spark.createDataFrame([(i, " ".join(rnd.choices(t.split(), k=40)), lang) for i, (lang, t) in enumerate(texts * 5)], "doc_id long, text string, lang string"), length=40)
    own = {x: {} for x in profiles.langs}
    for g in range(len(profiles.grams)):
        for i in range(profiles.begin[g], profiles.begin[g + 1]):
            own[profiles.langs[profiles.lang[i]]][int(profiles.grams[g])] = int(profiles.rank[i])
    assert all(sorted(ranks.values()) == list(range(len(ranks))) for ranks in own.values())
    for text in ("the hund sat", "q", "die katze and the dog", "der der der"):
        top = langid.ranked(text, 40).tolist()
        far = {x: sum(min(40, abs(ranks[g] - i)) if g in ranks else 40 for i, g in enumerate(top)) for x, ranks in own.items()}
        assert profiles.distances(np.array(top)).tolist() == [far[x] for x in profiles.langs]
        best = min(far.values())
        assert profiles.predict(text)[0] == (min(x for x in far if far[x] == best) if best < 40 * len(top) else "und")
    many = spark.createDataFrame([(i, "a b c", f"l{i % 90}") for i in range(3000)], "doc_id long, text string, lang string")
    assert len(langid.learn(many, each=3).langs) == 90 and len(langid.learn(many, most=10).langs) == 10
    assert langid.predict(many.where("false"), profiles).count() == 0 and langid.keep_known(many.where("false"), profiles).count() == 0


def test_another_script_is_no_known_language(spark):
    df = spark.createDataFrame([(i, "some plain words here", "en") for i in range(3)] + [(9, "한글로쓴글", None)], "doc_id long, text string, lang string")
    profiles = langid.learn(df)
    grams = {int(g) for g in profiles.grams}
    assert profiles.predict("한글로쓴글") == ("und", 0.0) and grams
    assert {r.doc_id for r in langid.keep_known(df, profiles).collect()} == {0, 1, 2}


def test_tree_and_quadrants_are_best():
    rnd = np.random.default_rng(21)
    value = lambda g, h: g.sum() ** 2 / (h.sum() + 1.0)
    for _ in range(50):
        g, h = rnd.normal(size=9), rnd.uniform(0.1, 1, 9)
        one = max(range(1, 9), key=lambda i: value(g[:i], h[:i]) + value(g[i:], h[i:]))
        cuts = [(sum(value(g[a:b], h[a:b]) for a, b in zip([0, *c], [*c, 9])), c) for c in (sorted({one, i}) for i in range(1, 9))]
        c = max(cuts)[1]
        wanted = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1.0)) for a, b in zip([0, *c], [*c, 9])])
        assert np.allclose(quality_gam._tree(g, h, 1.0), wanted)
        g, h = rnd.normal(size=(4, 5)), rnd.uniform(0.1, 1, (4, 5))
        parts = lambda x, i, j: (x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:])
        gains = {(i, j): sum(map(value, parts(g, i, j), parts(h, i, j))) for i in range(1, 4) for j in range(1, 5)}
        (i, j), best = max(gains.items(), key=lambda x: x[1])
        gain, grid = quality_gam._quadrants(g, h, 1.0)
        assert gain == pytest.approx(best - value(g, h))
        assert grid[0, 0] == pytest.approx(g[:i, :j].sum() / (h[:i, :j].sum() + 1.0)) and grid[-1, -1] == pytest.approx(g[i:, j:].sum() / (h[i:, j:].sum() + 1.0))


def test_quality(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = entries.op1_pairwise_additive_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    rnd = np.random.default_rng(8)
    x = rnd.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # nothing but an interaction
    model = quality_gam.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    empty = quality_gam.learn(odd.where("false"), labels.where("false"))
    scores = quality_gam.score(odd, empty).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).toPandas(), docs.schema)
        assert kept.columns == names and {r.doc_id for r in kept.collect()} <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}
    run = corpus_pipeline.run(spark, SF).collect()  # how pieces are cut depends on the tasks, what is packed does not
    assert {r.doc_id for r in run} == {r.doc_id for r in pieces} and sum(r.length for r in run) == sum(r.length for r in pieces)


def test_pipeline_of_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    rows = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.col("row").alias("_topic"), F.col("fp").alias("_kept"))
    for docs in (rows, rows.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.where("doc_id is not null").count()


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
