"""Text of HTML pages: tags, comments and scripts are told apart as browsers do, character references are resolved."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = r"[\t\n\f\r ]"
#: What follows a tag's name: names, and values with quotes, which may hold ``>``, or without. Nothing is tried twice.
_ATTRIBUTES = rf"""(?:(?:{_BLANK}|/)++|[^\t\n\f\r />][^\t\n\f\r /=>]*+(?:{_BLANK}*+={_BLANK}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\t\n\f\r >]*+))?+)*+"""
#: Comments; scripts and styles with all up to their end tag; tags; declarations and other markup without a name.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)(?={_BLANK}|[/>]){_ATTRIBUTES}(?:>.*?(?=</\1(?:{_BLANK}|[/>])|\Z)|\Z)|</?[a-z][^\t\n\f\r />]*+{_ATTRIBUTES}(?:>|\Z)|<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\Z)", re.IGNORECASE | re.DOTALL
)


def text_of(page: str | None) -> str | None:
    """The text between tags; markup that the page's end cuts is left out, a ``<`` that begins no markup stays."""
    if page is None:
        return None
    bare = TOKEN.sub("", page) if "<" in page else page
    return unescape(bare) if "&" in bare else bare


@F.pandas_udf(StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """:func:`text_of` of a column, in Arrow batches; null stays null. It takes time in proportion to a page, whatever its markup."""
    return pages.map(text_of, na_action="ignore")
