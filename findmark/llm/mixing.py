"""Mixing sources to target weights by iterative proportional fitting, by DataFrame functions only.

The documents' tokens are summed by cell (one value of each margin's column).  The cells are raked: round after round, each
margin in turn scales its cells so that their sum by value is the target.  For a sample the targets are shares of a stated
budget of tokens: values and cells that have less than their target are kept whole and the rest of the budget goes to the
others, so a tail of tiny cells lowers no other cell's probability.  Without a budget a document's probability is its cell's
scale over the largest scale.  Documents are dropped but never repeated, and a hash of the id decides.

Targets that contradict each other, or that the cells which occur cannot meet, are told: ``off_target`` is the largest distance
of a margin's share from its target when raking ended, and a warning says so where it is over ``TOLERANCE``.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import stored

#: Rounds over all margins between two looks at the margins, and at most.
ROUNDS, MOST_ROUNDS, CLOSE = 8, 64, 1e-6
#: Rounds where a stated number is asked for instead of closeness, as SQL needs it.
STATED_ROUNDS = 32
#: Distance of a margin's share from its target that is told by a warning.
TOLERANCE = 0.01
#: Topics by marks in the text, the first that holds; the rest is prose.
TOPICS = (("table", r" \| "), ("symbols", r"[#*$%&]{3}"), ("numbers", r"[0-9]{4}"))
#: The margin of these topics, and the margins by default.
TOPIC = "_topic"
MARGINS = {"source": None, "lang": None, TOPIC: None}
#: A margin without targets of its own aims at shares like its own shares to this power: between equal and as they are.
TEMPER = 0.7
#: Share of all tokens that a sample is to keep.
BUDGET = 0.5
#: Cells that are raked in one part and sent to every task; more are raked and joined by shuffles, with the same result.
MOST_BROADCAST = 50_000


def topic(text: Column | str, topics: tuple = TOPICS) -> Column:
    """The first topic whose pattern is in the text, else ``prose``; a null text is prose."""
    text = F.col(text) if isinstance(text, str) else text
    out = None
    for name, pattern in topics:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def words(text: Column | str) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(doc_id: Column | str, seed: str = "mix") -> Column:
    """A number in [0, 1) by a hash of the id."""
    hexes = F.substring(F.md5(F.concat(F.lit(seed), (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))), 1, 12)
    return F.conv(hexes, 16, 10).cast("double") / float(16**12)


def _fill(table: DataFrame, own: str, wish: str, budget: float, few: bool) -> Column:
    """The factor by which ``wish``, at most ``own`` in each row, sums to ``budget`` (or to all that it can).

    With the rows of the smallest ratios whole, the others' factor is what is left of the budget over their wishes; no such
    factor is over the right one, so it is the largest of them.  Few rows lie in one part and are summed up in order there;
    many are gone over again and again, each time with those whole that the last factor fills.
    """
    if few:
        ratio = Window.partitionBy(F.lit(0)).orderBy(F.col(own) / F.nullif(F.col(wish), F.lit(0.0)))
        before = F.coalesce(F.sum(F.when(F.col(wish) > 0, F.col(own))).over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum(wish).over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        return F.when(F.col(wish) > 0, (F.lit(budget) - before) / rest)
    room, factor = 1.0 + 1e-12, 0.0
    while True:
        full = F.col(wish) * F.lit(factor) >= F.col(own)
        r = table.where(F.col(wish) > 0).agg(F.sum(F.when(full, F.col(own)).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col(wish))).alias("free")).first()
        if not r["free"] or (budget - r["full"]) / r["free"] <= factor * room:
            return F.lit(factor)
        factor = (budget - r["full"]) / r["free"]


def _filled(table: DataFrame, own: str, wish: str, budget: float, few: bool, name: str) -> DataFrame:
    """``table`` with ``name``: ``wish`` by that factor, at most ``own``."""
    table = table.withColumn("_factor", _fill(table, own, wish, budget, few))
    if few:
        table = table.withColumn("_factor", F.max("_factor").over(Window.partitionBy(F.lit(0))))
    return table.withColumn(name, F.least(own, F.coalesce(F.col(wish) * F.col("_factor"), F.lit(0.0)))).drop("_factor")


def rake(cells: DataFrame, margins: Mapping[str, Mapping[str, float] | None], rounds: int = ROUNDS, most_rounds: int = MOST_ROUNDS, close: float | None = CLOSE, budget: float | None = None) -> DataFrame:
    """``cells(<margins>, tokens)`` with ``target_share`` (shares after raking), ``scale`` (its ratio to the own share) and
    ``off_target``, the same for all.

    Targets are shares by value and are normed over the values that have tokens; a value without a target gets none.
    ``None`` stands for tempered shares.  It ends when every margin is within ``close``, or after ``most_rounds``;
    with ``close`` None it goes on for all of them.  Cells
    are one row for each combination that occurs; they are kept in the shared folder between looks, and only sums reach
    the driver.  With a ``budget`` (a share of all tokens) shares sum to that and no scale is over 1: a value that has less
    than its target has all of it as its target, as has a cell, and the other targets grow by one factor to fill the budget.
    """
    names = list(margins)
    table = stored(cells.where("tokens > 0").select(*names, "tokens"), "cells")
    size = table.agg(F.sum("tokens").alias("n"), F.count("*").alias("cells")).first()
    # few cells lie in one part, where each margin's window finds its values without an exchange
    few = size["cells"] <= MOST_BROADCAST
    dealt = (lambda t: t.coalesce(1)) if few else (lambda t: t)
    table = dealt(table)
    own = F.col("tokens") / F.lit(float(size["n"] or 1))
    table = table.withColumn("own_share", own).withColumn("target_share", own)
    for i, m in enumerate(names):
        values = table.groupBy(m).agg(F.sum("own_share").alias("own"))
        if margins[m] is None:
            values = values.withColumn("wish", F.pow("own", F.lit(TEMPER)))
        else:
            kind = dict(values.dtypes)[m]
            wishes = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in margins[m].items()], f"`{m}` {kind}, wish double")
            values = values.join(wishes, m, "left").withColumn("wish", F.coalesce("wish", F.lit(0.0)))
        if budget is None:
            norm = values.agg(F.sum("wish").alias("n")).first()["n"]
            goal = F.col("wish") / F.lit(float(norm or 1))
        else:
            values = _filled(dealt(values) if few else stored(values, "values"), "own", "wish", budget, few, "goal")
            goal = F.col("goal")
        table = table.join(values.select(m, goal.alias(f"goal_{i}")), m)
    table = dealt(stored(table, "cells"))
    at = [Window.partitionBy(m) for m in names]
    for n in range(rounds, most_rounds + rounds, rounds):
        for _ in range(rounds):
            for i in range(len(names)):
                held = F.sum("target_share").over(at[i])
                scaled = F.when(held > 0, F.col("target_share") * F.col(f"goal_{i}") / held).otherwise(0.0)
                table = table.withColumn("target_share", scaled if budget is None else F.least("own_share", scaled))
        table = dealt(stored(table, "cells"))
        if close is None and n < most_rounds:
            continue
        gaps = [table.groupBy(m, f"goal_{i}").agg(F.sum("target_share").alias("s")).select(F.abs(F.col("s") - F.col(f"goal_{i}")).alias("gap")) for i, m in enumerate(names)]
        worst = reduce(DataFrame.unionAll, gaps).agg(F.max("gap").alias("gap")).first()["gap"]
        if worst is None or (close is not None and worst <= close):
            break
    if worst is not None and worst > TOLERANCE:
        warnings.warn(f"the targets of the mixture are missed by a share of up to {worst:.4f}: they contradict each other or the cells", stacklevel=2)
    if budget is not None:
        table = _filled(table, "own_share", "target_share", budget, few, "target_share")
    return table.select(*names, "tokens", "target_share", (F.col("target_share") / F.col("own_share")).alias("scale"), F.lit(worst).cast("double").alias("off_target"))


def weighted(docs: DataFrame, margins: Mapping[str, Mapping[str, float] | None] | None = None, budget: float | None = None, topics: tuple = TOPICS, **raking) -> DataFrame:
    """``row, topic, tokens, probability, off_target`` for every row of ``docs``: the row as it was, whatever the names of its
    columns, and what sampling needs.

    Margins are columns of ``docs``, such as a topic that a model or a table gives, or ``TOPIC`` for the topic by the marks of
    ``topics`` in the text; by default source, language and ``TOPIC``.  A null value of a margin is a value of its own, the
    empty string.  Null, empty and blank texts have no tokens and probability zero; a text of any length is counted whole.  With
    a ``budget`` that share of the tokens is expected to stay; without one the cell of the largest scale has probability 1.
    ``raking`` goes to ``rake``.
    """
    margins = MARGINS if margins is None else margins
    keys = [f"m{i}" for i in range(len(margins))]
    value = lambda m: topic(docs["text"], topics) if m == TOPIC else docs[m].cast("string")
    plus = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), topic(docs["text"], topics).alias("topic"), words(docs["text"]).alias("tokens"), *(F.coalesce(value(m), F.lit("")).alias(k) for k, m in zip(keys, margins)))
    raked = rake(plus.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), dict(zip(keys, margins.values())), budget=budget, **raking)
    size = raked.agg(F.count("*").alias("n"), F.max("scale").alias("most")).first()
    chances = raked.select(*keys, (F.col("scale") / F.lit(float(size["most"] or 1) if budget is None else 1.0)).alias("p"), "off_target")
    if size["n"] <= MOST_BROADCAST:
        chances = F.broadcast(chances)
    out = plus.join(chances, keys, "left")
    return out.select("row", "topic", "tokens", F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("probability"), "off_target")


def sample(docs: DataFrame, margins: Mapping[str, Mapping[str, float] | None] | None = None, seed: str = "mix", budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities keep, with all their columns.

    A null id counts as empty; rows that share an id share its draw, so of two rows of a cell both stay or both go.
    """
    out = weighted(docs, margins, budget)
    return out.where(chance(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), seed) < F.col("probability")).select("row.*")


def oracle_sql(rounds: int, budget: float) -> str:
    """The same for ``documents`` in SQL, with so many rounds."""
    factor = lambda table, own, wish: f"(SELECT max(({budget} - before) / rest) FROM (SELECT coalesce(sum({own}) OVER (ORDER BY {own} / {wish} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum({wish}) OVER (ORDER BY {own} / {wish} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {table} WHERE {wish} > 0))"
    steps = ["r0 AS MATERIALIZED (SELECT * FROM g2)"]
    for k in range(3 * rounds):
        m = "slt"[k % 3]
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(own, x * goal_{m} / sum(x) OVER (PARTITION BY {m})) AS x) FROM r{k})")
    goals = []
    for i, m in enumerate("slt"):
        before = f"g{i - 1}" if i else "c"
        goals.append(f"v{i} AS MATERIALIZED (SELECT {m}, sum(own) AS all_own, pow(sum(own), {TEMPER}) AS w FROM {before} GROUP BY 1), f{i} AS MATERIALIZED (SELECT {factor(f'v{i}', 'all_own', 'w')} AS f), g{i} AS MATERIALIZED (SELECT b.*, least(all_own, w * f) AS goal_{m} FROM {before} b JOIN v{i} ON b.{m} = v{i}.{m}, f{i})")
    tests = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    last = f"r{3 * rounds}"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, CASE {tests} ELSE 'prose' END AS t,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents),
c AS MATERIALIZED (SELECT s, l, t, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM d) AS own, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM d) AS x
      FROM d GROUP BY 1, 2, 3 HAVING sum(tokens) > 0),
{", ".join(goals)}, {", ".join(steps)},
p AS (SELECT s, l, t, least(own, x * f) / own AS p FROM {last}, (SELECT {factor(last, 'own', 'x')} AS f)),
q AS (SELECT d.doc_id, d.t AS topic, d.tokens, CASE WHEN d.tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END AS p
      FROM d LEFT JOIN p ON d.s = p.s AND d.l = p.l AND d.t = p.t)
SELECT doc_id, topic, tokens, round(p, 4) AS probability, coalesce(('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {float(16**12)} < p, false) AS sampled FROM q
"""
