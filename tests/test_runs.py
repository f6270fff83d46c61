"""Audits that are stopped, started again and repeated: calls, tables, summaries."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from findmark.operators import judge, maintained, metrics, replies, runs
from findmark.sources.stages import Stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
FIELDS = ("text", "clinical_status", "clinical_significance", "laterality", "comparison", "measurements")
#: Series, side, fields: one outcome each, and one series without any finding.
FINDINGS = [
    ("s1", "gt", "opacity", "abnormal", "urgent", "bilateral", None, []),
    ("s1", "pred", "opacity", "abnormal", "urgent", "bilateral", None, []),
    ("s2", "gt", "clot", "abnormal", "critical", "left", None, []),
    ("s2", "pred", "clot", "abnormal", "critical", "right", None, []),
    ("s3", "gt", "air", "abnormal", "critical", "left", "new", []),
    ("s3", "pred", "no air", "normal", "critical", None, None, []),
    ("s4", "gt", "nodule", "abnormal", "notable", None, "stable", [{"value": 6.0, "unit": "mm", "category": "size"}]),
    ("s5", "pred", "clear", "normal", "routine", None, None, []),
]
SERIES = ("s1", "s2", "s3", "s4", "s5", "s6")
REPORT = "series_uuid string, side string, text string"


def reports_of(spark, findings=FINDINGS, series=SERIES):
    told = {(s, side): [] for s in series for side in ("gt", "pred")}
    for s, side, *values in findings:
        told[s, side].append(dict(zip(FIELDS, values)))
    return spark.createDataFrame([(s, side, json.dumps(x)) for (s, side), x in told.items()], REPORT)


def extract(messages):
    return '{"findings": %s}' % messages[-1]["content"].rpartition("\n\n")[2], {"model": "m", "output": 10}


def match(messages):
    told = json.loads(messages[-1]["content"][messages[-1]["content"].index("{") :])
    ids = lambda side: [f["finding_id"] for f in told[f"{side}_findings"]]
    both = [i for i in ids("pred") if i in ids("gt")]
    return json.dumps({"matches": [{"pred_id": i, "gt_id": i} for i in both], **{f"unmatched_{s}": [i for i in ids(s) if i not in both] for s in ("pred", "gt")}}), {"model": "m", "output": 100}


def attributes(messages):
    pairs = json.loads(messages[1]["content"])["pairs"]
    return json.dumps({"errors_per_pair": [{"pair_id": p["pair_id"], "errors": [{"dimension": "grade", "severity": "minor", "reasoning": p["gt"]}] if "mild" in p["gt"] else []} for p in pairs]}), {"model": "m", "output": 1000}


class Desk:
    """A store and the runs over it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, str(root), 0

    def run(self, reports, who=(extract, match, attributes), run_id=None, per_task=2, **more):
        self.n += 1
        log = replies.ReplyLog(self.spark, f"{self.root}/log", run_id or f"run-{self.n}", per_task)
        out = runs.run(self.spark, f"{self.root}/store", reports, runs.judges(*who, log, attempts=1), log=log, buckets=2, **more)
        self.calls = {r["stage"]: r["calls"] for r in log.calls().collect()}
        return out


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    """Few tasks for few rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def desk(spark, tmp_path_factory):
    desk = Desk(spark, tmp_path_factory.mktemp("audit"))
    desk.first = desk.run(reports_of(spark))
    desk.first_calls, desk.first_summary = desk.calls, desk.first.summary.first().asDict(True)
    return desk


def test_summary_field_by_field(desk):
    s = desk.first_summary
    assert desk.first_calls == {"extraction": 12, "matching": 3}  # texts are alike or the statuses differ: nothing to judge
    assert s["metadata"] == {"n_reports": 6, "n_failed_reports": 0, "total_gt_findings": 4, "total_pred_findings": 4, "token_usage": {"calls": 15, "prompt_tokens": 0, "completion_tokens": 420}, "token_cost": 0.0}
    assert s["muc_counts"] == {"COR": 1, "PAR": 0, "INC": 2, "MIS": 1, "SPU": 1}
    wanted = {"all": (3, 1, 2, 0, 4, 1, 4, 1, 3), "significant": (3, 1, 2, 0, 4, 1, 4, 1, 3), "triage": (2, 0, 2, 0, 3, 1, 3, 1, 3), "critical": (2, 0, 2, 0, 2, 0, 2, 0, 2)}
    for tier, (errors, mis, inc, fp, stake, hits, total, p_hits, p_total) in wanted.items():
        t = s["tiers"][tier]
        assert t == {
            "fn_mis": mis, "fn_inc": inc, "fp_spu": fp, "fp_inc": 0, "findings_at_stake": stake, "recall_hits": hits, "recall_total": total, "precision_hits": p_hits, "precision_total": p_total,
            "fn": mis + inc, "fp": fp, "errors": errors, "errors_per_finding": errors / stake, "recall": hits / total, "precision": p_hits / p_total,
            "errors_per_report": errors / 6, "fn_per_report": (mis + inc) / 6, "fp_per_report": fp / 6, "significance": list(t["significance"]),
        }
    assert s["tiers"]["triage"]["significance"] == ["critical", "urgent"]
    assert {k: v["muc_counts"] for k, v in s["subsets"].items()} == {
        "measurement": {"COR": 0, "PAR": 0, "INC": 0, "MIS": 1, "SPU": 0}, "comparison": {"COR": 0, "PAR": 0, "INC": 1, "MIS": 1, "SPU": 0},
        "abnormal-regular": {"COR": 1, "PAR": 0, "INC": 1, "MIS": 0, "SPU": 0}, "normal-regular": {"COR": 0, "PAR": 0, "INC": 0, "MIS": 0, "SPU": 1},
    }
    assert "errors_per_report" not in s["subsets"]["measurement"]["tiers"]["all"]
    assert s["subsets"]["measurement"]["tiers"]["critical"]["recall"] is None
    assert s["attribute_breakdown"]["laterality"] == {"clean": 2, "minor": 0, "major": 1, "evaluated": 3, "clean_pct": 2 / 3, "minor_pct": 0.0, "major_pct": 1 / 3}
    assert len(s["attribute_breakdown"]) == 10


def test_blocks_by_report(desk):
    rows = {r["series_uuid"]: r.asDict(True) for r in desk.first.reports.collect()}
    assert set(rows) == set(SERIES)  # series without a finding count
    assert rows["s2"]["muc_counts"]["INC"] == 1 and rows["s6"]["muc_counts"] == {"COR": 0, "PAR": 0, "INC": 0, "MIS": 0, "SPU": 0}
    assert rows["s4"]["tiers"]["significant"]["errors"] == 1 and rows["s6"]["tiers"]["all"]["errors_per_finding"] == 0.0
    assert rows["s4"]["findings"] == {"evaluated_pred": 0, "evaluated_gt": 0, "total_pred": 0, "total_gt": 1}
    assert set(rows["s6"]["attribute_breakdown"]) == set(rows["s2"]["attribute_breakdown"])


def test_runs_over_changes_ask_only_for_these(spark, desk):
    same = desk.run(reports_of(spark))
    assert desk.calls == {} and same.passes == [6]
    again = same.summary.first().asDict(True)
    again["metadata"]["token_usage"] = desk.first_summary["metadata"]["token_usage"]
    assert again == desk.first_summary

    changed = [("s1", "gt", "mild opacity", *f[3:]) if f[:2] == ("s1", "gt") else f for f in FINDINGS]
    one = desk.run(reports_of(spark, changed))
    assert desk.calls == {"extraction": 1, "matching": 1, "scoring": 1}
    sums = lambda t: sorted(map(str, t.where("block <> 'x'").collect()))
    assert sums(one.counts) == sums(maintained.totals((maintained.parts(one.records, one.orphans), 1)))  # kept counts equal a whole sum
    assert one.summary.first()["muc_counts"].asDict() == {"COR": 0, "PAR": 1, "INC": 2, "MIS": 1, "SPU": 1}
    assert one.records.where("series_uuid = 's1'").first().text_errors[0].asDict() == {"dimension": "grade", "severity": "minor", "reasoning": "mild opacity"}

    # another judge is asked about all, an indication about its series; findings and links of the others are those of before
    told = spark.createDataFrame([("s2", "pain")], "series_uuid string, indication string")
    other = desk.run(reports_of(spark, changed), attributes=runs.Asked(system="look again"), indications=told)
    assert desk.calls == {"extraction": 2, "matching": 1, "scoring": 1} and sums(other.counts) == sums(one.counts)
    fewer = desk.run(reports_of(spark, changed), attributes=runs.Asked(system="look again"), indications=told, limit=2)
    assert desk.calls == {} and fewer.summary.first()["metadata"]["n_reports"] == 2
    assert fewer.summary.first()["muc_counts"].asDict() == {"COR": 0, "PAR": 1, "INC": 1, "MIS": 0, "SPU": 0}


def test_failures_are_asked_again(spark, tmp_path):
    state = tmp_path / "seen"
    state.mkdir()

    def unsteady(messages):
        """Fails on the first call for the series of the clot."""
        if "clot" in messages[-1]["content"] and not (state / "clot").exists():
            (state / "clot").write_text("")
            raise ValueError("not now")
        return match(messages)

    desk = Desk(spark, tmp_path)
    out = desk.run(reports_of(spark), (extract, unsteady, attributes), match_retries=0, passes=3)
    assert out.passes == [5, 1] and out.failures.count() == 0 and out.summary.first()["metadata"]["n_reports"] == 6
    assert desk.calls == {"extraction": 12, "matching": 4}


def test_bad_replies_and_given_findings(spark, tmp_path):
    """A reply that is no list of findings, a pair without a valid answer, and given findings of which one has no name."""
    given = [("s1", "a", "mild opacity", "abnormal", "urgent"), ("s2", "", "clot", "abnormal", "urgent"), ("s3", "b", "air", "abnormal", "critical")]
    given = spark.createDataFrame([(*g, None, None, []) for g in given], "series_uuid string, finding_id string, text string, clinical_status string, clinical_significance string, laterality string, comparison string, measurements array<struct<value:double,unit:string,category:string>>")
    bad = lambda m: "[]" if "clear" in m[-1]["content"] else extract(m)
    same = lambda m: match(m) if "s3_" in m[-1]["content"] else json.dumps({"matches": [{"pred_id": "s1_001", "gt_id": "a"}], "unmatched_pred": [], "unmatched_gt": []})
    desk = Desk(spark, tmp_path)
    out = desk.run(reports_of(spark), (bad, same, lambda m: "no JSON"), given=given, retries=0)
    assert desk.calls == {"extraction": 6, "matching": 2, "scoring": 1}
    assert sorted((r.stage, r.series_uuid, r.reason) for r in out.failures.collect()) == [("extraction", "s5", "no list of findings"), ("scoring", "s1", "no valid answer for one pair")]
    assert [r.series_uuid for r in out.reports.collect()] == ["s3"] and {r.series_uuid for r in out.orphans.collect()} == {"s3"}
    told = out.summary.first().metadata
    assert (told.n_reports, told.n_failed_reports) == (1, 1)


def test_no_reports(spark, tmp_path):
    out = Desk(spark, tmp_path).run(reports_of(spark).where("false"))
    told = out.summary.first().asDict(True)
    assert told["metadata"]["n_reports"] == 0 and told["tiers"]["all"]["errors"] == 0 and told["tiers"]["all"]["recall"] is None and len(told["subsets"]) == 4


def test_stopped_run_asks_no_finished_task_again(spark, tmp_path):
    """The third call ends its worker for good; what tasks have finished is in the log when the run is started again."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def counted(messages):
        (folder / f"{messages[-1]['content']}-{len(list(folder.iterdir()))}").write_text("")
        if messages[-1]["content"] == "3" and not (tmp_path / "mended").exists():
            os._exit(1)
        return messages[-1]["content"], {"model": "m", "output": 5}

    requests = spark.createDataFrame([(str(i),) for i in range(12)], "id string").select("id", F.array(judge.message("user", F.col("id"))).alias("messages")).coalesce(1)
    log = lambda: replies.ReplyLog(spark, str(tmp_path / "log"), "r", 1)
    with pytest.raises(Exception):
        log().judged("stage", ["id"], counted)(requests, 0).count()
    before = {r.reply for r in log().own().collect()}
    assert "3" not in before
    (tmp_path / "mended").write_text("")
    out = log().judged("stage", ["id"], counted)(requests, 0)
    assert sorted(r.reply for r in out.collect()) == sorted(map(str, range(12)))
    called = [p.name.split("-")[0] for p in folder.iterdir()]
    assert all(called.count(i) == 1 for i in before) and len(log().own().collect()) == 12
    n = len(called)
    assert out.count() == 12 and len(list(folder.iterdir())) == n
    assert log().judged("stage", ["id"], counted)(requests, 1).count() == 12 and len(list(folder.iterdir())) == n + 12  # another attempt is another request


def test_usage_of_failed_attempts(spark):
    class Paid(Exception):
        usage = {"model": "m", "uncached_input": 1, "output": 10}

    tries = []

    def judged(messages):
        tries.append(1)
        if len(tries) < 3:
            raise Paid("late") if len(tries) == 1 else Paid("again")
        return "yes", {"model": "m", "output": 10}

    requests = spark.createDataFrame([("a",)], "id string").select("id", F.array(judge.message("user", F.col("id"))).alias("messages"))
    out = judge.call_judge(requests, judged, ["id"]).first()
    assert (out.reply, out.attempts, out.usage.output, out.usage.uncached_input) == ("yes", 3, 30, 2)
    empty = judge.call_judge(requests, lambda m: ("", {"model": "m", "output": 7}), ["id"], attempts=4).first()
    assert (empty.reply, empty.error, empty.usage.output) == (None, "empty reply", 28)


def test_store_replaces_only_its_series(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "store"), 3)
    rows, schema = [(f"s{i}", i) for i in range(20)], "series_uuid string, n int"
    df = spark.createDataFrame(rows, schema)
    stages.put("x", df.select("series_uuid"), df, ("y", df))
    stages.put("x", df.where("n < 6").select("series_uuid"), df.where("n < 4").withColumn("n", F.col("n") + 100), ("y", df.where("n < 2")))
    assert stages.rows("y", schema).count() == 16
    assert sorted((r.series_uuid, r.n) for r in stages.rows("x", schema).collect()) == sorted([*((s, n + 100) for s, n in rows if n < 4), *((s, n) for s, n in rows if n > 5)])
    stages.put("x", df.select("series_uuid"), df.where("false"))
    assert stages.rows("x", schema).count() == 0 and stages.state("x", "series_uuid string").count() == 20
    assert stages.rows("never", schema).count() == 0


def test_totals_follow_changes_and_come_back(spark, tmp_path):
    """Random changes against a full sum, and totals that a run lost."""
    import random

    rnd = random.Random(8)
    kept = maintained.Maintained(Stages(spark, str(tmp_path / "store"), 5))
    make = lambda s, n: (s, "tiers", "all", "triage", *(rnd.randint(0, 5) for _ in range(9)))
    for n in range(3):
        chosen = rnd.sample([f"s{i}" for i in range(30)], 12)
        new = spark.createDataFrame([make(s, n) for s in chosen if s != "s3"], maintained.PARTS)
        kept.put(new, spark.createDataFrame([(s, str(n), "x") for s in chosen], "series_uuid string, fingerprint string, stamp string"))
        full = maintained.totals((kept.parts(), 1)).collect()
        assert kept.stages.whole("totals", maintained.TOTALS).collect() == full == kept.totals().collect()
    kept.stages.put_whole("totals", spark.createDataFrame([], maintained.TOTALS))
    assert kept.totals().collect() == full
    assert metrics.with_rates(maintained.unpacked(kept.totals(), "tiers")).first().fn >= 0
