"""Cutting texts into pages."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


def paginate(corpus: DataFrame, keys: Sequence[str], page_size: int, text: str = "text") -> DataFrame:
    """``(keys, page_id, text)``: pages of ``page_size`` characters; an empty text has one empty page.

    Null texts have no page.  ``ValueError`` if ``page_size`` isn't positive.
    """
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    last = F.greatest(F.length(text) - 1, F.lit(0))
    starts = corpus.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last, F.lit(page_size))).alias("_at"))
    return starts.select(*keys, F.floor(F.col("_at") / page_size).alias("page_id"), F.substring("_t", F.col("_at") + 1, F.lit(page_size)).alias("text"))


def whole_line_pages(content: str, page_chars: int) -> Iterator[str]:
    """Whole lines gathered until a page has ``page_chars`` characters."""
    held, size = [], 0
    for line in io.StringIO(content, newline="\n"):
        held.append(line)
        size += len(line)
        if size >= page_chars:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


@udtf(returnType="path string, page_id bigint, text string")
class LinePager:
    """The pages of :func:`line_pages` as a table function, for SQL: ``line_pager(TABLE(texts) PARTITION BY (path), page_chars)``.

    Rows that share a path are one text after the other, whose pages are numbered through; a null text has none.
    """

    def __init__(self):
        self.page = 0

    def eval(self, row: Row, page_chars: int):
        for page in whole_line_pages(row["text"] or "", page_chars):
            yield row["path"], self.page, page
            self.page += 1


def line_pages(files: DataFrame, keys: Sequence[str], page_chars: int = 16_000, text: str = "text") -> DataFrame:
    """``(keys, page_id, text)``: whole lines gathered until a page has ``page_chars`` characters.

    The last page may be shorter; an empty text has none.  A running sum that starts
    anew with each page is a fold over the text's lines, so each task walks its rows.
    """
    schema = T.StructType([*(files.schema[k] for k in keys), T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches) -> Iterator:
        import pandas as pd

        for frame in batches:
            pages = [(*key, i, page) for *key, content in frame.itertuples(index=False, name=None) for i, page in enumerate(whole_line_pages(content, page_chars))]
            yield pd.DataFrame(pages, columns=schema.names)

    return files.where(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, schema)
