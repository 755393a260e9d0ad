"""Templates of a stream in keyed state, with expiry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators.running import join_on, sums_before

#: What the state store has to be for keyed state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = "template_id string, count long, first long, exemplar string"


class TemplateState(StatefulProcessor):
    """Count, first page and exemplar of a template; forgotten when it hasn't been seen for ``idle_ms``, if that is given."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "count long, first long, exemplar string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        count, first, exemplar = self.seen.get() if self.seen.exists() else (0, None, None)
        for frame in rows:
            count += len(frame)
            at = frame["page_id"].idxmin()
            if first is None or frame["page_id"][at] < first:
                first, exemplar = int(frame["page_id"][at]), frame["exemplar"][at]
        self.seen.update((count, first, exemplar))
        yield pd.DataFrame({"template_id": [key[0]], "count": [count], "first": [first], "exemplar": [exemplar]})

    def close(self) -> None:
        """Nothing is held outside the state."""


def template_state(pages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``(template_id, count, first, exemplar)`` of each template that a batch of the stream ``pages(page_id, text)`` has brought up to date; for update mode.

    A template's state is one row.  With ``idle_ms`` it is dropped when the template hasn't come for so long (processing time), so
    that the state doesn't keep every template for ever; one that comes again is counted from one.  Needs the state store :data:`PROVIDER`.  Null texts are left out.
    """
    named = pages.where("text is not null").select(T.template_id(F.col("text")).alias("template_id"), "page_id", F.left("text", F.lit(2000)).alias("exemplar"))
    return named.groupBy("template_id").transformWithStateInPandas(TemplateState(idle_ms), SEEN, "Update", "ProcessingTime" if idle_ms else "None")


def ranked_templates(updates: DataFrame) -> DataFrame:
    """``(template_id, count, first, exemplar, rank)`` from the rows that :func:`template_state` has put out: the last one of each template, ranked from 0 by count, ties to the earlier page."""
    last = updates.groupBy("template_id").agg(F.max(F.struct("count", (-F.col("first")).alias("back"), "exemplar")).alias("s"))
    last = last.select("template_id", "s.count", (-F.col("s.back")).alias("first"), "s.exemplar")
    sizes = last.groupBy("count").agg(F.count(F.lit(1)).alias("_n"))
    # a row a count; within a count templates are ranked in ranges
    above = sizes.select("count", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    level = join_on(sums_before(last, ["count"], "first", {"_before": F.lit(1)}), above, ["count"])
    return level.select("template_id", "count", "first", "exemplar", (F.col("_above") + F.col("_before")).alias("rank"))
