"""Connected components over links, and memory of Python workers; tables are kept in the shared folder of the cluster."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmark.sources.scratch import dropped, new_path, scratch_dir, stored

__all__ = ["components", "dropped", "kept", "lean", "new_path", "scratch_dir", "stored"]

#: What this worker keeps for later tasks that ask for the same.
_kept: dict = {}


def kept(name: Hashable, make: Callable):
    """What ``make`` gave this worker for ``name``; it stays until a ``lean`` function that does not keep begins here."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Gives up all that ``kept`` holds."""
    if _kept:
        _kept.clear()
        gc.collect()
        spare_memory()


def spare_memory() -> None:
    """Gives back what Arrow and the C library hold unused."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives unused memory back when it ends: its Python worker lives on beside later tasks.

    Without ``keeps`` it first gives up what earlier functions kept in this worker, so that they do not add up.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            spare_memory()

    return wrapped


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node that is reachable from it.

    Each round gives all nodes of a label the smallest label that any of them has as a neighbour, then that label's own new
    label, so whole groups merge and not one node after another.  It ends when no label moves, however many rounds that
    takes.  Only one count per round reaches the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").groupBy(F.col("root").alias("old")).agg(F.min(F.least("root", "near")).alias("low"))
        low = stored(low, "hooks")
        up = low.join(labels.select(F.col("node").alias("low"), F.col("root").alias("up")), "low")
        jump = up.join(low.select(F.col("old").alias("up"), F.col("low").alias("next")), "up").select("old", F.least("low", "next").alias("new"))
        moved = stored(labels.join(jump, labels["root"] == jump["old"]).select("node", "old", F.col("new").alias("root")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("root <> old").limit(1).count():
            return labels
