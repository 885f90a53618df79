"""Text helpers of feeds, tickers and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern and host of article pictures, length of short descriptions in bytes.
IMAGE = r'<img[^>]+src="([^">]+)"'
IMAGE_HOST = "https://cdn"
SHORT_BYTES = 150


def strip_html(html: Column) -> Column:
    """Text without tags, comments and the bodies of scripts and styles; entities stay as they are."""
    bodies = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->", "")
    return F.regexp_replace(bodies, r"(?s)<[^>]*>", "")


def shorten(text: Column, limit: int = SHORT_BYTES) -> Column:
    """At most ``limit`` bytes and '...'. A character that the limit would split is left out."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.concat(F.rtrim(head, F.lit("�")), F.lit("..."))).otherwise(text)


def first_image(html: Column) -> Column:
    """Address of the first picture if it is on the article host, else ''."""
    found = F.regexp_extract(html, IMAGE, 1)
    return F.when(found.contains(IMAGE_HOST), found).otherwise(F.lit(""))


def market_id(base: Column, quote: Column) -> Column:
    return F.concat_ws("/", base, quote)


def ticker_id(base: Column, quote: Column) -> Column:
    return F.concat_ws("_", base, quote)


def ticker_to_market(ticker: str) -> str:
    """Every underscore is a slash, also one that belongs to a denomination."""
    return ticker.replace("_", "/")


def unquoted(value: Column) -> Column:
    return F.btrim(value, F.lit('"'))


def settings(text: Column) -> Column:
    """'k=v,k=v' as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))
