"""Articles of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_image, shorten, strip_html

ARTICLES = 6


def articles(items: DataFrame, limit: int = ARTICLES) -> DataFrame:
    """The first items of a feed (position, title, link, content, description, published, authors) as articles.

    The description stands in for empty content; the first author counts, '' if there is none.
    """
    body = F.when(F.coalesce("content", F.lit("")) == "", F.coalesce("description", F.lit(""))).otherwise(F.col("content"))
    return (
        items.orderBy("position")
        .limit(limit)
        .select(
            "title", F.col("link").alias("url"), shorten(strip_html(body)).alias("description"), F.col("published").alias("publish_date"),
            F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author_name"), first_image(body).alias("picture_url"),
        )
    )
