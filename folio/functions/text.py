"""Scalar functions over texts, titles, citations and page addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Patterns that give a line or a title its meaning.
SQUEEZE = r"(?U)[\s\p{P}\p{S}]+"
DOT_LEADER = r"(?i)\.{3,}\s*(?:\d+|[ivxlcdm]+)$"
NUMBERED = r"^(\d+(?:\.\d+)*)(?:[.)]|(?U:\s))(?U:\s)*\S"
NAMED_HEADING = (
    r"(?i)^(?:chapter|section|appendix|abstract|references|conclusion|introduction"
    r"|第[一二三四五六七八九十百\d]+[章节]|目录|参考文献|附录)"
)
CONTENTS_WORD = r"(?i)(?:contents|table of contents|目录)"
CITATION = r"\]\(cite:([^\s)]+)\)"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def compatible(text: Column) -> Column:
    """NFKC, in the JVM: by the ICU library that Spark's collations bring along. ASCII needs none, of Latin-1 only the compatibility characters do."""
    plain = text.rlike(r"^[\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF]*$")
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNull() | plain, text).otherwise(composed)


def normalized_title(text: Column) -> Column:
    """NFKC, lower case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(compatible(text)), SQUEEZE, "")


def line_signature(text: Column) -> Column:
    """normalized title, runs of digits as #."""
    return F.regexp_replace(normalized_title(text), r"\d+", "#")


def is_dot_leader(text: Column) -> Column:
    """dots, then an Arabic or Roman number at the end."""
    return text.rlike(DOT_LEADER)


def heading_number(text: Column) -> Column:
    """The number before a title, as 1.2.3; empty without one."""
    return F.regexp_extract(text, NUMBERED, 1)


def heading_number_depth(text: Column) -> Column:
    """dots in the number of a heading; null without a number."""
    number = heading_number(text)
    return F.when(number != "", F.size(F.split(number, r"\.")) - 1)


def is_named_heading(text: Column) -> Column:
    return text.rlike(NAMED_HEADING)


def squeezed(text: Column) -> Column:
    """NFKC without white space."""
    return F.regexp_replace(compatible(text), r"(?U)\s", "")


def sorted_chars(text: Column) -> Column:
    """The characters of a text, sorted."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def normalized_chars(text: Column) -> Column:
    """the characters of a text without white space, sorted."""
    return sorted_chars(squeezed(text))


def _ordered(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind)
        return F.when(column.isNotNull(), F.struct(*[_ordered(column[n], kind[n].dataType).alias(n) for n in names]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    return column


def canonical_digest(column: Column, kind: T.StructType) -> Column:
    """sha256 of the JSON of a struct, keys in order at every level, nulls written."""
    return F.sha2(F.to_json(_ordered(column, kind), {"ignoreNullFields": "false"}), 256)


def citation_ids(text: Column) -> Column:
    """F8: ids of ](cite:ID), in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), 1)


def page_uri(version: Column, page: Column) -> Column:
    """address of a page."""
    return F.format_string("folio://source/%s/page/%d", version, page.cast("long"))


def parsed_page_uri(uri: Column) -> tuple[Column, Column]:
    """version and page of an address; null where it is none."""
    pattern = "^folio://source/([^/]+)/page/([1-9][0-9]*)$"
    found = uri.rlike(pattern)
    return F.when(found, F.regexp_extract(uri, pattern, 1)), F.when(found, F.regexp_extract(uri, pattern, 2).cast("long"))


def document_name(filename: Column) -> Column:
    """file name without its .pdf."""
    return F.regexp_replace(filename, r"(?i)\.pdf$", "")


def upper_median(values: Column, default: float) -> Column:
    """The element at floor(n / 2) of sorted values."""
    order = F.array_sort(values)
    return F.coalesce(F.try_element_at(order, (F.floor(F.size(order) / 2) + 1).cast("int")), F.lit(default))
