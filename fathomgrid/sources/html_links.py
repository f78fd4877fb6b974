"""Outgoing links of web pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LINK = r"""(?is)<(?:a|area|frame|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@F.pandas_udf(StringType())
def _absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    from urllib.parse import urljoin, urlsplit

    def one(b, x):
        try:
            made = urljoin(b or "", x.strip())
            return made.partition("#")[0].partition("?")[0] if urlsplit(made).scheme in ("http", "https") else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def outlinks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str | Column = "html") -> DataFrame:
    """(key, url, link): absolute http(s) links without query or fragment, each once a page, not to the page itself."""
    tags = F.regexp_extract_all(html, F.lit(f"({_LINK})"), F.lit(1))
    value = F.concat(*(F.regexp_extract("tag", _LINK, i) for i in (1, 2, 3)))
    links = pages.select(key, url, F.explode(F.array_distinct(tags)).alias("tag")).select(key, url, value.alias("link")).where("link <> ''").distinct()
    links = links.select(key, url, _absolute(F.col(url), F.col("link")).alias("link"))
    return links.where(F.col("link").isNotNull() & (F.col("link") != F.col(url))).distinct()
