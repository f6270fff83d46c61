"""Components of links, chunks of a judge and its calls."""

import random

import pytest
from pyspark.sql import functions as F

from findmark.operators import explore, judge, links, matcher, metrics


def test_components_of_a_long_chain(spark):
    ids = [f"{i:04}" for i in random.Random(1).sample(range(1, 9999), 200)] + ["0000"]
    rows = [("s", ids[i + j], f"{i:04}") for i in range(200) for j in (0, 1)] + [("t", "5", "5")]
    got = links.match_components(spark.createDataFrame(rows, "series_uuid string, pred_id string, gt_id string")).collect()
    assert len(got) == len(rows) and {(r.series_uuid, r.component) for r in got} == {("s", "g:0000"), ("t", "g:5")}


def test_components_like_union_find(spark):
    rnd = random.Random(2)
    rows = sorted({(f"s{rnd.randint(0, 20)}", f"{rnd.randint(0, 30):02}", f"{rnd.randint(0, 30):02}") for _ in range(500)})
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for s, p, g in rows:
        a, b = sorted((root((s, f"p:{p}")), root((s, f"g:{g}"))))
        top[b] = a
    wanted = sorted((*r, root((r[0], f"g:{r[2]}"))[1]) for r in rows)
    df = spark.createDataFrame([*rows, ("s1", None, "00"), (None, "00", "00")], "series_uuid string, pred_id string, gt_id string")
    for large in (links.LARGE, 20, 0):  # all in tasks, some and all over the cluster
        assert sorted(map(tuple, links.match_components(df, large).collect())) == wanted
    assert links.match_components(df.where("false")).count() == 0


@pytest.mark.parametrize(("size", "good"), [(1, 0), (300, 0), (10, 4), (7, 7)])
def test_each_pair_is_answered_or_fails(spark, size, good):
    """Replies are right for up to ``good`` pairs at once, unless pair 3 is among them."""
    chunks = spark.range(1, size + 1).select(F.lit("s").alias("series_uuid"), F.lit(0).alias("chunk"), F.col("id").cast("int").alias("pair_id"), F.col("id").cast("string").alias("pred_id"), F.lit("g").alias("gt_id"), F.lit("a").alias("p_text"), F.lit("b").alias("g_text"), F.lit(None).cast("array<string>").alias("same_group_pred"), F.lit(None).cast("array<string>").alias("same_group_gt"))
    seen = []

    def ask(requests, attempt):
        seen.extend((attempt, r.n_pairs, len(r.messages)) for r in requests.collect())
        item = F.transform("asked", lambda p: F.concat(F.lit('{"pair_id": '), p["pair_id"].cast("string"), F.lit(', "errors": []}')))
        right = F.concat(F.lit('{"errors_per_pair": ['), F.array_join(item, ", "), F.lit("]}"))
        return requests.withColumn("reply", F.when((F.col("n_pairs") <= good) & ~F.exists("asked", lambda p: p["pred_id"] == "3"), right).otherwise("bad"))

    answers, failures = judge.judge_with_splits(chunks, ask, retries=1)
    got, lost = sorted(int(r.pred_id) for r in answers.collect()), sorted(int(r.pred_id) for r in failures.collect())
    assert sorted(got + lost) == list(range(1, size + 1)) and lost == (list(range(1, size + 1)) if not good else [3])
    assert all(n == (3 if attempt else 2) for attempt, _, n in seen)  # the second attempt says what was wrong


def test_calls_by_rule(spark):
    df = spark.createDataFrame([(k, [("user", k)]) for k in ("ok", "empty", "slow", "wrong", "late")], f"k string, messages {judge.MESSAGES}")

    def model(messages):
        what = messages[-1]["content"]
        if what == "ok":
            return "fine", {"model": "m", "uncached_input": 3, "cache_read": 0, "cache_write": 0, "output": 1}
        if what == "empty":
            return ""
        raise {"slow": TimeoutError, "wrong": KeyError, "late": ConnectionError}[what]("x")

    call = lambda **more: {r.k: (r.reply, r.error, r.attempts) for r in judge.call_judge(df, model, ["k"], retryable=(OSError,), threads=3, **more).collect()}
    got = call()
    assert got["ok"] == ("fine", None, 1) and got["empty"] == (None, "empty reply", 5) and got["slow"][2] == 5 and got["wrong"] == (None, "KeyError: 'x'", 1) and got["late"][2] == 5
    assert call(own_timeout=True)["slow"] == (None, "TimeoutError: x", 1)
    usage = judge.call_judge(df, model, ["k"], retryable=(OSError,)).where("usage is not null").select("usage.*")
    prices = spark.createDataFrame([("m", 1e6, 2e6, None)], "model string, input double, output double, cached_input double")
    assert metrics.token_cost(usage, prices).first().token_cost == 5.0


def test_matching_reply_of_many_links(spark):
    """20,000 links, two of them repeated, one id twice in a list, an unknown id and lists of other types."""
    import json

    n = 20_000
    ids = [f"i{i}" for i in range(n)]
    links_ = [{"pred_id": i, "gt_id": i} for i in ids[:-1]] + [{"pred_id": "i7", "gt_id": "i7"}, {"pred_id": "i3", "gt_id": "i3"}]
    rows = [
        ("a", json.dumps({"matches": links_, "unmatched_pred": [ids[-1]], "unmatched_gt": [ids[-1], ids[-1], "ghost"]}), ids, ids),
        ("b", json.dumps({"matches": None, "unmatched_pred": {"x": 1}, "unmatched_gt": [7, "u"]}), ["u"], ["u"]),
        ("c", json.dumps({"matches": [3, {"pred_id": 5, "gt_id": "u"}], "unmatched_pred": ["u"], "unmatched_gt": []}), ["u"], ["u"]),
    ]
    got = {r.series_uuid: r.errors for r in judge.validate_matching(spark.createDataFrame(rows, "series_uuid string, reply string, pred_ids array<string>, gt_ids array<string>")).collect()}
    assert got["a"] == ["repeated pair: i3 - i3", "repeated pair: i7 - i7", f"twice in unmatched_gt: {ids[-1]}", "unknown gt id: ghost"]
    assert got["b"] == ["matches must be a list", "unmatched_pred must be a list", "missing pred id: u", "an id in unmatched_gt is not a string"]
    assert got["c"] == ["not an object in matches: 3", "a pred_id is not a string"]


def test_lexical_matches_by_rare_words_like_all_pairs(spark):
    """Ties, repeated texts, sides, texts without words, at several thresholds."""
    rnd = random.Random(4)
    words = [f"w{min(int(rnd.expovariate(0.15)), 60)}" for _ in range(400)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 8, 12])))
    rows = [(s, f"{i:03}", rnd.choice(["left", "right", None]), text()) for s in ("a", "b") for i in range(120)]
    side = lambda: spark.createDataFrame([*rows[:40], *((s, i, x, text()) for s, i, x, _ in rows[40:])], "series_uuid string, finding_id string, laterality string, text string")
    pred, gt = side(), side()
    for least in (0.2, 0.3, 0.6, 1.0):
        few, all_ = (sorted(map(tuple, matcher.lexical_matches(pred, gt, least, n).collect())) for n in (0, 10**9))
        assert few == all_ and few
    some = matcher.lexical_matches(pred, gt.where("series_uuid = 'a'"), 0.3, 20_000).collect()
    assert {r.series_uuid for r in some} == {"a"}


def test_lexical_matches_of_a_large_series(spark):
    """20,000 findings a side of many different words: only findings that share a rare word meet."""
    n = 20_000
    df = spark.range(n).select(F.lit("s").alias("series_uuid"), F.col("id").cast("string").alias("finding_id"), F.lit(None).cast("string").alias("laterality"), F.concat(F.lit("cyst of the part"), F.col("id").cast("string"), F.lit(" near"), (F.col("id") % 500).cast("string")).alias("text"))
    found = matcher.lexical_matches(df, df, 0.9).agg(F.count("*").alias("n"), F.count_if(F.col("pred_id") == F.col("gt_id")).alias("same")).first()
    assert (found.n, found.same) == (n, n)


def test_text_index_like_a_scan(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"s{i % 40}", rnd.choice(["gt", "pred"]), f"{i}", "".join(rnd.choice("abcÄ ") for _ in range(rnd.randint(0, 30))) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "series_uuid string, side string, finding_id string, text string")
    path = str(tmp_path / "index")
    explore.write_text_index(df, path, 5)
    found = lambda out: sorted(r.series_uuid for r in out.collect())
    for text in ("", " ", "a", "ab", "abc", "Ä a", "c ab", "aaaaab", "zzz", "abz", "ä", " BC "):
        assert found(explore.search_index(spark, path, text)) == found(explore.search_text(df.where("text is not null"), text)), text
    explore.write_text_index(df.where("false"), path, 5)
    assert found(explore.search_index(spark, path, "abc")) == []


def test_text_index_reads_only_its_buckets(spark, tmp_path, capsys):
    df = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("series_uuid"), F.lit("gt").alias("side"), F.col("id").cast("string").alias("finding_id"), F.concat(F.lit("cyst number "), F.sha1(F.col("id").cast("string"))).alias("text"))
    path = str(tmp_path / "index")
    explore.write_text_index(df, path, 16)
    wanted = df.where("series_uuid = 's77'").first().text[12:]
    out = explore.search_index(spark, path, wanted)
    assert [r.series_uuid for r in out.collect()] == ["s77"]
    home = df.where("series_uuid = 's77'").select(F.pmod(F.xxhash64("series_uuid"), F.lit(16)).alias("b")).first().b
    capsys.readouterr()
    out.explain("formatted")
    assert any("PartitionFilters" in line and f"= {home})" in line for line in capsys.readouterr().out.splitlines())
