"""String, date and document-building expressions.

All are built-in column expressions evaluated per row over the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of the item documents, as the reference writes them.
TOPIC_LABEL = "Topic "          # "Topic {i}: {field}\n", i from 1
DESCRIPTION_LABEL = "Description: "
YEAR_LABEL = "Year: "
CITATIONS_LABEL = "#Citations: "
NAME_LABEL = "Name: "
GENRES_LABEL = "Genres: "
BLANK = r"[ \t\n\x0B\f\r]"
BRACKETED = r"[(\[].*?[)\]]"     # D5: a bracketed part of a title

# Supported HTML subset -- comments, doctype, script/style blocks and tags
# are removed, the common entities decoded (&amp; last), then \n \r \t dropped.
HTML_DROP = [r"(?s)<!--.*?-->", r"(?is)<!doctype[^>]*>", r"(?is)<script\b[^>]*>.*?</script\s*>",
             r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<[^>]*>"]
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                 ("&amp;", "&")]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def course_document(fields: str | Column, about: str | Column) -> Column:
    """``Topic i: f\\n`` per field (i from 1), then ``Description: about``
    (null about -> empty)."""
    topics = F.array_join(F.transform(_c(fields), lambda f, i: F.concat(
        F.lit(TOPIC_LABEL), (i + 1).cast("string"), F.lit(": "), f, F.lit("\n"))), "")
    return F.concat(F.coalesce(topics, F.lit("")), F.lit(DESCRIPTION_LABEL), F.coalesce(_c(about), F.lit("")))


def paper_document(title, year, citations, doc_type, publisher, abstract=None, fos=None) -> Column:
    """Title, ``Year: y``, ``#Citations: n``, doc type, publisher and,
    when present, the abstract and the field names -- joined by newlines
    (``concat_ws`` skips the null optionals)."""
    parts = [_c(title), F.concat(F.lit(YEAR_LABEL), _c(year).cast("string")),
             F.concat(F.lit(CITATIONS_LABEL), _c(citations).cast("string")), _c(doc_type), _c(publisher)]
    if abstract is not None:
        parts.append(_c(abstract))
    if fos is not None:
        parts.append(_c(fos))
    return F.concat_ws("\n", *parts)


def movie_document(name: str | Column, genres: str | Column) -> Column:
    """D3: ``Name: n Genres: a, b`` from a ``|``-separated genre list."""
    return F.concat(F.lit(NAME_LABEL), _c(name), F.lit(" " + GENRES_LABEL),
                    F.regexp_replace(_c(genres), r"\|", ", "))


def strip_html(col: str | Column) -> Column:
    """Text of an HTML page (supported subset above), without \\n \\r \\t."""
    c = _c(col)
    for pat in HTML_DROP:
        c = F.regexp_replace(c, pat, "")
    for ent, ch in HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.translate(c, "\n\r\t", "")


def clean_title(col: str | Column) -> Column:
    """Drop bracketed parts, then white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(col), BRACKETED, ""), rf"^{BLANK}+|{BLANK}+$", "")


def first_active(flags: Sequence[str]) -> Column:
    """Name of the first column among ``flags`` whose value is 1, else ''.
    The column list is a parameter (the reference skips some by position)."""
    expr = None
    for f in flags:
        expr = F.when(F.col(f) == 1, F.lit(f)) if expr is None else expr.when(F.col(f) == 1, F.lit(f))
    return expr.otherwise(F.lit("")) if expr is not None else F.lit("")


def epoch_seconds(col: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Time string -> epoch seconds (session time zone pinned to UTC)."""
    return F.unix_timestamp(F.to_timestamp(_c(col), fmt))


def index_pairs(index: str | Column) -> Column:
    """C7 step 1: the (position, term) pairs of ``map<term, array<position>>``,
    sorted by position."""
    return F.sort_array(F.flatten(F.transform(
        F.map_entries(_c(index)),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("term"))))))


def text_from_pairs(pairs: str | Column, length: str | Column) -> Column:
    """C7 step 2: each term at its position, empty strings in the gaps,
    joined by single spaces -- i.e. ``pos - previous pos`` spaces before each
    term, then the trailing gap.  Linear in the pairs (``zip_with`` with the
    shifted positions; no per-element lookups).  Pass a materialised column."""
    p = _c(pairs)
    pos = F.transform(p, lambda e: e["pos"])
    prev = F.concat(F.array(F.lit(0)), F.slice(pos, 1, F.greatest(F.size(pos) - 1, F.lit(0))))
    pieces = F.zip_with(p, prev, lambda e, q: F.concat(F.repeat(F.lit(" "), e["pos"] - q), e["term"]))
    n = _c(length)
    last = F.coalesce(F.try_element_at(pos, F.lit(-1)), F.lit(0))
    tail_gap = F.when(F.size(p) == 0, F.greatest(n - 1, F.lit(0))).otherwise(n - 1 - last)
    return F.concat(F.array_join(pieces, ""), F.repeat(F.lit(" "), tail_gap))


def json_int(col: str | Column, key: str) -> Column:
    """An integer field of a JSON object string (null when absent)."""
    return F.get_json_object(_c(col), f"$.{key}").try_cast("bigint")
