"""One object for the three uses: compress, compact, recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import budget as B
from ..operators import compaction as C
from ..operators import packing as P
from ..operators import recall as R
from ..operators.paging import line_pages, paginate
from ..sources import tables

MODES = ("flat", "hierarchical", "budgeted", "scale", "streaming")


class PromptMemory:
    """Packs texts, compacts conversations and recalls pages over one Spark session."""

    def __init__(
        self, spark: SparkSession, *, output_budget: int = 1_000_000, input_budget: int = 10_000_000, page_chars: int = 16_000,
        compact_budget: int | None = None, cold_store: str | None = None,
    ):
        self.spark = spark
        self.output_budget, self.input_budget, self.page_chars = output_budget, input_budget, page_chars
        self.compact_budget = compact_budget or min(8000, output_budget)
        self.cold_store = cold_store

    def compress(self, texts: DataFrame, keys: Sequence[str], mode: str = "flat") -> DataFrame:
        """A packed row for each text of ``texts(keys, text)``; in the budgeted modes the pages go to the cold store, if one is named."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        if mode == "flat":
            return P.flat_pack(texts, keys)
        if mode == "hierarchical":
            return P.hierarchical_pack(texts, keys)
        return self.pack_pages(paginate(texts, keys, self.page_chars), keys)

    def pack_pages(self, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
        options = B.BudgetOptions(input_token_budget=self.input_budget, output_token_budget=self.output_budget, page_chars=self.page_chars, store_ref="cold_store")
        rows = B.cold_rows(pages, keys, options)
        if self.cold_store:
            tables.write_cold_store(rows, self.cold_store)  # read again below, so pages are encoded once
            rows = self.spark.read.parquet(self.cold_store)
        else:
            rows = cut(rows)
        return B.budget_pack(rows, keys, options)

    def pack_files(self, path: str) -> DataFrame:
        """Packs files, in pages of whole lines, a prompt each."""
        return self.pack_pages(line_pages(tables.read_texts(self.spark, path), ["path"], self.page_chars), ["path"])

    def compact(self, messages: DataFrame, keys: Sequence[str], **options) -> C.Compacted:
        return C.compact_messages(messages, keys, C.CompactOptions(**{"budget": self.compact_budget} | options))

    def recall(self, page_ids: Sequence[int | str] | None = None, query: str | None = None, top_k: int = 5, method: str = "keyword") -> DataFrame:
        if not self.cold_store:
            raise ValueError("no cold store is named")
        return R.recall(tables.read_cold_store(self.spark, self.cold_store), page_ids, query, top_k, method)
