"""Text functions over columns: DOIs, numeric prefixes, page counts, ISSNs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in DOIs, replaced in this order, so that double escapes resolve.
DOI_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;", "–"), ("&#x003c;", "<"), ("&#x003e;", ">"), ("&#60;", "<"), ("&#62;", ">"))
# How patents state DOIs, and the form of a DOI.
DOI_IN_TEXT = r"(?i)((doi: *)|(doi\.org/))([^,; )>]+)"
DOI_FORM = r"^10\.[0-9]{4,9}/.."


def doi_sql(value: str) -> str:
    """SQL for a DOI in normal form: lower case, one of two equal halves, no blanks, entities resolved."""
    x = f"lower({value})"
    halves = f"split({x}, ' ')"
    x = f"if(size({halves}) = 2 and {halves}[0] = {halves}[1], {halves}[0], replace({x}, ' ', ''))"
    for a, b in DOI_ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def normalized_doi(value: Column) -> Column:
    low = F.lower(value)
    halves = F.split(low, " ")
    x = F.when((F.size(halves) == 2) & (F.get(halves, 0) == F.get(halves, 1)), F.get(halves, 0)).otherwise(F.replace(low, F.lit(" "), F.lit("")))
    for a, b in DOI_ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def doi_in_text(text: Column) -> Column:
    """The DOI stated in free text, or null: the text after ``doi:`` or ``doi.org/``, taken twice to drop nested prefixes, without a final full stop."""
    once = F.regexp_extract(text, DOI_IN_TEXT, 4)
    twice = F.regexp_extract(once, DOI_IN_TEXT, 4)
    found = F.lower(F.regexp_replace(F.when(twice != "", twice).otherwise(once), r"\.$", ""))
    return F.when(found.rlike(DOI_FORM), found)


def numeric_prefix(text: Column) -> Column:
    """The integer a text begins with, 0 when it begins with none, null for null; beyond 64 bits the nearest one."""
    digits = F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    beyond = F.when(F.startswith(digits, F.lit("-")), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(text.isNotNull() & digits.isNull(), F.lit(0)).when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), beyond)).cast("bigint")


def page_count(pages: Column) -> Column:
    """Pages of a range like ``12-15``, null without a dash."""
    at = F.instr(pages, "-")
    first = F.substring(pages, F.lit(1), at - 1)
    last = F.substring(pages, at + 1, F.length(pages))
    return F.when(at > 0, F.try_add(F.try_subtract(numeric_prefix(last), numeric_prefix(first)), F.lit(1)))


def plain_issn(value: Column) -> Column:
    return F.nullif(F.replace(F.replace(value, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")), F.lit(""))


def phrase_pattern(phrase: str) -> str:
    """A pattern for the words of a phrase, one after the other in any case, whatever stands between them but letters and digits."""
    import re

    words = [re.escape(w) for w in re.findall(r"[^\W_]+", phrase)]
    return r"(?i)(?:^|[^\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(words) + r"(?:[^\p{L}\p{N}]|$)"


def mentions(text: Column, *phrases: str) -> Column:
    """Whether a text holds one of the phrases as whole words (full-text phrase search, phrases joined by OR)."""
    return text.rlike("|".join(map(phrase_pattern, phrases)))
