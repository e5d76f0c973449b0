"""Text: HTML to plain text, folding, tokens, page data, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: HTML elements that start a new block, and entities that are decoded.
BLOCKS = "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul|br"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: Letters that folding maps though they don't decompose.
PLAIN = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th", "ð": "d", "—": "-", "–": "-", "‐": "-", "’": "'", "‘": "'"}


def strip_html(html: Column) -> Column:
    """Plain text: scripts, styles and comments go, blocks and line breaks become one space, entities are decoded, spaces trimmed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCKS})\b[^>]*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[\x20\t\n\f\r]+", " "))


_SPECIAL = str.maketrans(PLAIN)


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text.casefold()).translate(_SPECIAL)
    return "".join(str(unicodedata.decimal(c, c)) for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility form without case, diacritics and ignorable characters; digits of all scripts become 0-9."""
    return text.map(_fold)


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits with single inner joiners (. ' ’ _), each Han character alone."""
    return F.regexp_extract_all(text, F.lit(r"(\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+(?:[.'’_][\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+)*)"), 1)


def extract_page_data(pages: DataFrame, elements: list[str], class_prefix: str, html: str = "html") -> DataFrame:
    """pages with page_json (schema.org blocks), class_values (class attribute values with a prefix) and has_<element>."""
    h = F.col(html)
    out = {
        "page_json": F.regexp_extract_all(h, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1),
        "class_values": F.filter(F.flatten(F.transform(F.regexp_extract_all(h, F.lit(r'(?i)\bclass="([^"]*)"'), 1), lambda c: F.split(c, r"\s+"))), lambda c: c.startswith(class_prefix)),
    }
    return pages.withColumns(out | {f"has_{e}": h.rlike(rf"(?i)<{e}[\s/>]") for e in elements})


def validate_links(rows: DataFrame, link: str = "str_value") -> DataFrame:
    """rows with link_error: null, 'empty', 'no scheme', 'bad scheme', 'no host' or 'space'."""
    v = F.col(link)
    scheme, host = F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(v, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return rows.withColumn("link_error", F.when(v.isNull() | (v == ""), "empty").when(v.rlike(r"\s"), "space").when(scheme == "", "no scheme").when(~scheme.isin("http", "https", "mailto"), "bad scheme").when((scheme != "mailto") & (host == ""), "no host"))
