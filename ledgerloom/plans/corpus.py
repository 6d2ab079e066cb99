"""Web pages to a plain-text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.html import html_to_text
from ledgerloom.operators.sampling import sample_rows


def page_texts(pages: DataFrame) -> DataFrame:
    """The whole text of every page as (page_id, text)."""
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def pages_to_corpus(pages: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The texts of n pages, drawn at random but the same ones for a seed."""
    return page_texts(sample_rows(pages.select("page_id", "html"), n, "page_id", seed))
