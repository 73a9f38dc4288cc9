"""Search requests, and listing rows taken from stored result pages."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import before_marker, first_token, or_default


@dataclass(frozen=True)
class PageField:
    """One output field: a pattern with one group, what to do with it, a default.

    ``how`` is 'text', 'first_token' or 'before_dots'. ``from_page`` reads the
    whole page and not the block.
    """

    name: str
    pattern: str
    default: str
    how: str = "text"
    from_page: bool = False

    def read(self, source: Column) -> Column:
        """The field's value in a block or page."""
        found = F.regexp_extract(source, self.pattern, 1)
        if self.how == "first_token":
            found = first_token(found)
        elif self.how == "before_dots":
            found = before_marker(found, "...")
        return or_default(found, self.default)


# The defaults of the five fields of a listing.
LISTING_DEFAULTS = {"name": "Null", "address": "Unknown", "rating": "0", "review_count": "0", "feedback": "None"}


def blocks_of(html: str, element: str, mark: str) -> list[str]:
    """The elements of a name whose opening tag matches ``mark``, each whole with all it holds, in page order.

    A block inside a block is in the outer one's text and stands for itself after it. A closing tag ends the
    element opened last; elements that are never closed reach to the end of the page.
    """
    opened: list[tuple[int, bool]] = []
    found = []
    for tag in re.finditer(rf"<(/?){element}\b[^>]*>", html, re.IGNORECASE):
        if not tag[1]:
            if not tag[0].endswith("/>"):
                opened.append((tag.start(), re.search(mark, tag[0]) is not None))
        elif opened:
            start, wanted = opened.pop()
            if wanted:
                found.append((start, tag.end()))
    found += [(start, len(html)) for start, wanted in opened if wanted]
    return [html[start:end] for start, end in sorted(found)]


def nested_blocks(html: Column, element: str, mark: str) -> Column:
    """``blocks_of`` for a column, in Arrow batches; none for a null page."""

    @F.pandas_udf("array<string>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: blocks_of(page, element, mark) if page else [])

    return found(html)


def extract_listings(df: DataFrame, html: str, block: str | Column, fields: list[PageField]) -> DataFrame:
    """One row per listing block of a page, fields with their defaults.

    ``block`` is a pattern, for blocks without blocks of their kind inside, or a column of block lists such as
    ``nested_blocks``. All other columns of the page, such as its location, come along.

    Fields of the page are read once per page, before its blocks become rows,
    and the page text is dropped there.
    """
    keep = [c for c in df.columns if c != html]
    shared = [f for f in fields if f.from_page]
    pages = df.select(
        *keep,
        *[f.read(F.col(html)).alias(f.name) for f in shared],
        (block if isinstance(block, Column) else F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("__blocks"),
    )
    rows = pages.select(*keep, *[f.name for f in shared], F.posexplode("__blocks"))
    return rows.select(
        *keep,
        F.col("pos").alias("position"),
        *[(F.col(f.name) if f.from_page else f.read(F.col("col"))).alias(f.name) for f in fields],
    )


def search_requests(
    df: DataFrame, location: str, base: str, route: str, host_word: str, params: Mapping[str, str]
) -> DataFrame:
    """(location, url): one first-page search request per location.

    A route that already names the host is taken as it is.
    """
    target = F.lit(route) if host_word in route else F.concat(F.lit(base), F.lit(route))
    encode = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    query = [F.concat(F.lit(f"{k}="), encode(F.lit(v))) for k, v in params.items()]
    query.append(F.concat(F.lit("find_loc="), encode(F.col(location).cast("string"))))
    query.append(F.lit("start=0"))
    return df.select(location, F.concat(target, F.lit("?"), F.concat_ws("&", *query)).alias("url"))
