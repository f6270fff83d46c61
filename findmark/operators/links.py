"""Joins and graph work over the links of findings.

Finding ids are unique within a series and side only, so every key holds the series.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from findmark.sources.scratch import stored, stored_by_series


def shared_series(*tables: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Series that are in every table."""
    first, *rest = [t.select("series_uuid").distinct() for t in (*tables, *([allowed] if allowed is not None else []))]
    return reduce(lambda a, b: a.join(b, "series_uuid", "left_semi"), rest, first)


def pair_findings(matches: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Each link with its two findings, columns prefixed ``p_`` and ``g_``; a link whose finding is missing has no row."""
    side = lambda df, x: df.select("series_uuid", F.col("finding_id").alias(f"{x}_finding_id"), *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in ("series_uuid", "finding_id", "side")))
    p, g = side(pred, "p").withColumnRenamed("p_finding_id", "pred_id"), side(gt, "g").withColumnRenamed("g_finding_id", "gt_id")
    return matches.join(p, ["series_uuid", "pred_id"]).join(g, ["series_uuid", "gt_id"])


def attach_indication(series: DataFrame, indications: DataFrame) -> DataFrame:
    return series.join(indications.select("series_uuid", "indication"), "series_uuid", "left").withColumn("indication", F.coalesce("indication", F.lit("")))


def todo(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without an output of the same keys."""
    return inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def orphans(findings: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Findings of a side that no link has."""
    linked = matches.select("series_uuid", F.col(f"{side}_id").alias("finding_id")).distinct()
    return findings.join(linked, ["series_uuid", "finding_id"], "left_anti")


def stale_ids(unmatched: DataFrame, findings: DataFrame) -> DataFrame:
    """Series whose list of unmatched findings names an id that is not there, with those ids."""
    keys = ["series_uuid", "side", "finding_id"]
    return unmatched.join(findings.select(*keys), keys, "left_anti").groupBy("series_uuid").agg(F.sort_array(F.collect_set("finding_id")).alias("stale_ids"))


def size_given_elsewhere(pairs: DataFrame) -> DataFrame:
    """``pairs`` with whether another candidate of the same reference finding gives a size."""
    has = F.exists(F.coalesce("p_measurements", F.array().cast("array<struct<value:double,unit:string,category:string>>")), lambda m: m["category"] == "size")
    giver, own = F.when(has, F.col("pred_id")), Window.partitionBy("series_uuid", "gt_id")
    # another one gives a size if the first or the last giver is another one: no row holds the list of all
    other = lambda end: F.coalesce(end(giver).over(own) != F.col("pred_id"), F.lit(False))
    return pairs.withColumn("size_elsewhere", other(F.min) | other(F.max))


#: Links of a series up to which one task joins them; larger series go through rounds over the cluster.
LARGE = 1_000_000


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by series, whole series at a time, with the component of each link.

    A component's name is its smallest tagged id, which is that of a reference finding, as a link has one.
    """

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = lambda side: pc.dictionary_encode(pc.binary_join_element_wise(table["series_uuid"], table[f"{side}_id"], "\0").combine_chunks())
        preds, gts = code("pred"), code("gt")
        p, names = preds.indices.to_numpy(), gts.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        g = rank[gts.indices.to_numpy()]
        label = np.arange(len(order))
        while True:  # the labels of both ends meet, then each label takes its own label's
            low = np.full(len(preds.dictionary), len(order))
            np.minimum.at(low, p, label[g])
            new = label.copy()
            np.minimum.at(new, g, low[p])
            np.minimum.at(new, label[g], low[p])
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.empty(len(order), np.int64)
        at[g] = np.arange(len(g))  # a link of each reference finding
        roots = table["gt_id"].take(pa.array(at[label[g]]))
        yield from table.append_column("component", pc.binary_join_element_wise("g:", roots, "")).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        names = batch.column("series_uuid")
        if size >= 50_000 and batch.num_rows and names[-1] != held[-1].column("series_uuid")[-1]:
            last = held[-1].column("series_uuid")[-1]
            cut = pc.sum(pc.equal(names, last)).as_py() or 0
            yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, size, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield from done(pa.Table.from_batches(held))


def _spread_components(matches: DataFrame) -> DataFrame:
    """The same by rounds of joins: all findings of a label take the smallest label next to any of them, and then that
    label's own new label, until none moves."""
    edge = matches.select("series_uuid", F.concat(F.lit("p:"), "pred_id").alias("a"), F.concat(F.lit("g:"), "gt_id").alias("b")).distinct()
    both = stored(edge.union(edge.select("series_uuid", F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy("series_uuid", F.col("a").alias("v")).agg(F.min("b").alias("m")).select("series_uuid", "v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select("series_uuid", F.col("v").alias("b"), "root"), ["series_uuid", "b"]).groupBy("series_uuid", F.col("a").alias("v")).agg(F.min("root").alias("near"))
        low = stored(labels.join(near, ["series_uuid", "v"]).groupBy("series_uuid", "root").agg(F.min(F.least("root", "near")).alias("low")), "hooks")
        up = low.join(labels.select("series_uuid", F.col("v").alias("low"), F.col("root").alias("up")), ["series_uuid", "low"])
        jump = up.join(low.select("series_uuid", F.col("root").alias("up"), F.col("low").alias("next")), ["series_uuid", "up"]).select("series_uuid", "root", F.least("low", "next").alias("new"))
        moved = stored(labels.join(jump, ["series_uuid", "root"]).select("series_uuid", "v", F.col("root").alias("was"), F.col("new").alias("root")), "labels")
        labels = moved.select("series_uuid", "v", "root")
        if moved.where("root <> was").isEmpty():
            break
    own = labels.select("series_uuid", F.substring("v", 3, 1 << 30).alias("pred_id"), F.col("root").alias("component")).where(F.col("v").startswith("p:"))
    return matches.join(own, ["series_uuid", "pred_id"])


def match_components(matches: DataFrame, large: int = LARGE) -> DataFrame:
    """Links with ``component``: the smallest tagged id of the connected findings of their series.

    A component never leaves its series, so links are dealt by series once and joined there; series of more than ``large``
    links, if any, go through rounds over the cluster instead, with the same result.  Links without a series or an id on
    either side are left out.
    """
    whole = "series_uuid is not null and pred_id is not null and gt_id is not null"
    # counted, then read: a table that is kept already is not written again
    matches = matches.where(whole) if hasattr(matches, "_stored_at") else stored_by_series(matches.where(whole), "links")
    big = [r[0] for r in matches.groupBy("series_uuid").count().where(F.col("count") > large).select("series_uuid").limit(10_000).collect()]
    schema = StructType([*matches.schema.fields, StructField("component", StringType())])
    local = lambda df: df.repartition("series_uuid").sortWithinPartitions("series_uuid").mapInArrow(_local_components, schema)
    if not big:
        return local(matches)
    if len(big) == 10_000:  # too many to name
        return _spread_components(matches).select(*schema.names)
    is_big = F.col("series_uuid").isin(big)
    return local(matches.where(~is_big)).unionByName(_spread_components(matches.where(is_big)))


def match_groups(matches: DataFrame) -> DataFrame:
    """Each link with the sorted ids of both sides of its component."""
    own = Window.partitionBy("series_uuid", "component")
    return match_components(matches).select("*", *(F.sort_array(F.collect_set(f"{s}_id").over(own)).alias(f"group_{s}s") for s in ("pred", "gt")))


def _members(linked: DataFrame, pred: DataFrame, gt: DataFrame, *columns: str) -> DataFrame:
    """The findings of each component, once each: ``series_uuid, component, side, id`` and ``columns`` of the findings."""
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in ("pred", "gt")))).alias("e")
    ids = linked.select("series_uuid", "component", ends).select("series_uuid", "component", "e.side", "e.id").distinct()
    of = lambda df, s: df.select("series_uuid", F.lit(s).alias("side"), F.col("finding_id").alias("id"), *columns)
    return ids.join(of(pred, "pred").unionByName(of(gt, "gt")), ["series_uuid", "side", "id"])


def group_context(linked: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Each link with the texts of the other findings of its component, in order of their ids; null where there are none.

    Texts are gathered once for each component, and a link takes its own out of that list.  A link that is its whole component
    has no others, and where ``n_links`` tells it (``group_sides``) its texts are not gathered; links that have their texts
    (``p_text``, ``g_text``) are not joined with the findings again.
    """
    several = linked.where("n_links > 1") if "n_links" in linked.columns else linked
    if {"p_text", "g_text"} <= set(linked.columns):
        told = lambda s: F.sort_array(F.collect_set(F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s[0]}_text").alias("text")))).alias(f"t_{s}")
        groups = several.groupBy("series_uuid", "component").agg(told("pred"), told("gt"))
    else:
        told = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("id", "text")))).alias(f"t_{s}")
        groups = _members(several, pred, gt, "text").groupBy("series_uuid", "component").agg(told("pred"), told("gt"))
    rest = lambda s: F.transform(F.filter(f"t_{s}", lambda x: x["id"] != F.col(f"{s}_id")), lambda x: x["text"])
    out = linked.join(groups, ["series_uuid", "component"], "left")
    return out.select(*linked.columns, *(F.when(F.size(rest(s)) > 0, rest(s)).alias(f"same_group_{s}") for s in ("pred", "gt")))


def group_sides(pairs: DataFrame) -> DataFrame:
    """Pairs of linked findings, with their ``component``, and ``p_group`` and ``g_group``: the union of the sides of the
    component's abnormal findings; ``n_links`` is how many links it has."""
    own = Window.partitionBy("series_uuid", "component")
    # a bit for each side, so that the rows of a component are held once for all: one, two, and three for both
    bits = lambda x: F.when(F.col(f"{x}_clinical_status") == "abnormal", F.when(F.col(f"{x}_laterality") == "left", 1).when(F.col(f"{x}_laterality") == "right", 2).when(F.col(f"{x}_laterality") == "bilateral", 3))
    out = pairs.withColumns({"n_links": F.count("*").over(own), **{f"{x}_bits": F.bit_or(bits(x)).over(own) for x in ("p", "g")}})
    told = lambda x: F.when(F.col(f"{x}_bits") == 3, "bilateral").when(F.col(f"{x}_bits") == 1, "left").when(F.col(f"{x}_bits") == 2, "right")
    return out.withColumns({f"{x}_group": told(x) for x in ("p", "g")}).drop("p_bits", "g_bits")


def siblings(matches: DataFrame, side: str = "gt") -> DataFrame:
    """Findings of a side that share a counterpart: ``series_uuid, finding_id, sibling_id``."""
    own, other = (f"{side}_id", "pred_id" if side == "gt" else "gt_id")
    a = matches.select("series_uuid", F.col(other).alias("c"), F.col(own).alias("finding_id"))
    b = matches.select("series_uuid", F.col(other).alias("c"), F.col(own).alias("sibling_id"))
    return a.join(b, ["series_uuid", "c"]).where("finding_id <> sibling_id").select("series_uuid", "finding_id", "sibling_id").distinct()


def component_of(linked: DataFrame, chosen: DataFrame) -> DataFrame:
    """All links of the components that the findings ``chosen(series_uuid, side, finding_id)`` are in, once each."""
    hit = reduce(DataFrame.union, (linked.join(chosen.where(F.col("side") == s).select("series_uuid", F.col("finding_id").alias(f"{s}_id")), ["series_uuid", f"{s}_id"], "left_semi").select("series_uuid", "component") for s in ("pred", "gt"))).distinct()
    return linked.join(hit, ["series_uuid", "component"], "left_semi").dropDuplicates(["series_uuid", "gt_id", "pred_id"])
