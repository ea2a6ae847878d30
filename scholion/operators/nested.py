"""Deeply nested semi-structured records to related flat tables.

Bodies are parsed once into VARIANT values; nested ``transform`` calls attach the ancestors' keys and
positions, ``flatten`` joins the levels and one ``inline`` per target table emits its rows. Everything
runs inside the JVM and within the row, so no shuffle is needed to tie children to their parents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NestedTable:
    """A list in a record: its table, the path from the record (or from an element of ``parent``), and its columns.

    columns maps a column to its path in the element; a column whose path is ``$`` takes an element given
    as a bare string. bits: width of the position in the packed id, (parent id << bits) | position; positions that
    don't fit get ids of their own below zero.
    """

    name: str
    path: str
    parent: str | None = None
    key: str = "work_id"
    bits: int = 20
    columns: dict[str, str] = field(default_factory=dict)


#: Width of the positions that don't fit their table's bits.
WIDE = 20

ENVELOPES = {"crossref": "message", "pubmed": "PubmedArticle", "datacite": "attributes"}
ROOT_KEYS = {"crossref": ("doi", "$.DOI"), "pubmed": ("article_pubmed_id", "$.MedlineCitation.PMID"), "datacite": ("doi", "$.doi")}

_PERSON = {"name": "$.name", "name_type": "$.nameType", "given_name": "$.givenName", "family_name": "$.familyName"}
_IDENTIFIER = {"name_identifier": "$.nameIdentifier", "name_identifier_scheme": "$.nameIdentifierScheme", "scheme_uri": "$.schemeUri"}

# The lists of each source and the keys of their fields.
TABLES: dict[str, list[NestedTable]] = {
    "crossref": [
        NestedTable("work_authors", "$.author", bits=14, columns={"orcid": "$.ORCID", "suffix": "$.suffix", "given": "$.given", "family": "$.family", "name": "$.name", "sequence": "$.sequence"}),
        NestedTable("author_affiliations", "$.affiliation", "work_authors", "author_id", 7, {"name": "$.name"}),
        NestedTable("work_references", "$.reference", columns={"key": "$.key", "doi": "$.DOI", "unstructured": "$.unstructured", "author": "$.author", "year": "$.year"}),
        NestedTable("work_funders", "$.funder", bits=10, columns={"doi": "$.DOI", "name": "$.name"}),
        NestedTable("funder_awards", "$.award", "work_funders", "funder_id", 10, {"name": "$"}),
        NestedTable("work_licenses", "$.license", columns={"url": "$.URL", "start_timestamp": "$.start.timestamp", "delay_in_days": "$['delay-in-days']"}),
        NestedTable("work_updates", "$['update-to']", columns={"label": "$.label", "type": "$.type", "doi": "$.DOI", "timestamp": "$.updated.timestamp"}),
    ],
    "pubmed": [
        NestedTable("pubmed_authors", "$.MedlineCitation.Article.AuthorList.Author", key="article_id", bits=14, columns={"given": "$.ForeName", "family": "$.LastName", "suffix": "$.Suffix", "initials": "$.Initials", "valid": "$['@ValidYN']", "collective_name": "$.CollectiveName"}),
        NestedTable("pubmed_author_affiliations", "$.AffiliationInfo", "pubmed_authors", "author_id", 4, {"affiliation": "$.Affiliation", "identifier": "$.Identifier"}),
        NestedTable("pubmed_references", "$.PubmedData.ReferenceList.Reference", key="article_id", columns={"citation": "$.Citation"}),
        NestedTable("pubmed_reference_articles", "$.ArticleIdList.ArticleId", "pubmed_references", "reference_id", 5, {"article_id": "$['#text']", "id_type": "$['@IdType']"}),
    ],
    "datacite": [
        NestedTable("dc_work_creators", "$.creators", bits=14, columns=_PERSON),
        NestedTable("dc_creator_name_identifiers", "$.nameIdentifiers", "dc_work_creators", "creator_id", 7, _IDENTIFIER),
        NestedTable("dc_creator_affiliations", "$.affiliation", "dc_work_creators", "creator_id", 7, {"name": "$.name"}),
        NestedTable("dc_work_contributors", "$.contributors", bits=14, columns={"contributor_type": "$.contributorType", **_PERSON}),
        NestedTable("dc_contributor_name_identifiers", "$.nameIdentifiers", "dc_work_contributors", "contributor_id", 7, _IDENTIFIER),
        NestedTable("dc_contributor_affiliations", "$.affiliation", "dc_work_contributors", "contributor_id", 7, {"name": "$.name"}),
    ],
}


def _literal(path: str) -> str:
    return '"' + path + '"'


def _list(value: str, path: str) -> str:
    """SQL for the list at a path; a single value counts as a list of one, missing or null as one null."""
    p = _literal(path)
    return f"coalesce(try_variant_get({value}, {p}, 'array<variant>'), array(variant_get({value}, {p}, 'variant')))"


def packed(parent: str, position: str, bits: int, root: str = "record_id") -> str:
    """SQL for the id of a list element. A position beyond ``bits`` is packed with WIDE bits into a negative id, so it
    meets no other; one that fits neither way is an error. Parents may be negative only below a negative ``root``."""
    wide = f"~(shiftleft({parent}, {WIDE}) | {position})"
    error = f"cast(raise_error('position ' || {position} || ' of parent ' || {parent} || ' fits no id') as bigint)"
    fits = f"{parent} between 0 and {(1 << 63 - WIDE) - 1} and {position} < {1 << WIDE}"
    return f"(case when {parent} is null then null when ({parent} >= 0 or {root} < 0) and {position} < {1 << bits} then shiftleft({parent}, {bits}) | {position} when {fits} then {wide} else {error} end)"


def packed_id(parent: int, position: int, bits: int) -> int:
    """As ``packed``, of numbers."""
    if parent >= 0 and position < 1 << bits:
        return parent << bits | position
    if 0 <= parent < 1 << 63 - WIDE and position < 1 << WIDE:
        return ~(parent << WIDE | position)
    raise ValueError(f"position {position} of parent {parent} fits no id")


def _present(value: str) -> str:
    return f"({value} is not null and not is_variant_null({value}))"


def _emit(t: NestedTable, by_name: dict[str, NestedTable], row: str, v: str = "doc") -> str:
    """SQL for the array of ``row`` structs (null for null elements); row may use e, i and, for child lists, p and h."""
    if t.parent is None:
        return f"transform({_list(v, t.path)}, (e, i) -> if({_present('e')}, {row}, null))"
    up = by_name[t.parent]
    inner = f"transform({_list('p', t.path)}, (e, i) -> if({_present('e')}, {row}, null))"
    return f"flatten(transform({_list(v, up.path)}, (p, h) -> if({_present('p')}, {inner}, array())))"


def parsed(records: DataFrame) -> DataFrame:
    """record_id, source, doc: the parsed body without its envelope; bodies that are not one valid JSON value are left out."""
    wrapped = records.select("record_id", F.lower(F.trim("source")).alias("source"), F.expr("try_parse_json('[' || body || ']')").alias("w"))
    one = wrapped.select("record_id", "source", F.expr("try_variant_get(w, '$', 'array<variant>')").alias("a")).where("size(a) = 1")
    env = " ".join(f"when source = '{s}' then try_variant_get(b, '$.{e}', 'variant')" for s, e in ENVELOPES.items())
    opened = one.select("record_id", "source", F.expr("a[0]").alias("b")).withColumn("inside", F.expr(f"case {env} end"))
    return opened.select("record_id", "source", F.expr("if(inside is null or is_variant_null(inside), b, inside)").alias("doc"))


def element_paths(records: DataFrame) -> DataFrame:
    """record_id, table_name, path: one row per element of every list in ``TABLES``.

    Null elements give no row but keep their position; missing, null and empty lists give none; a
    single object or string in place of a list counts as a list of one; a body that is null or not valid
    JSON gives none. Other columns of ``records`` are ignored, repeated records give their rows once.
    """
    cases = []
    for source, tables in TABLES.items():
        by_name = {t.name: t for t in tables}
        parts = []
        for t in tables:
            path = "cast(i as string)" if t.parent is None else "concat(cast(h as string), '.', cast(i as string))"
            parts.append(_emit(t, by_name, f"struct('{t.name}' as table_name, {path} as path)"))
        cases.append(f"when source = '{source}' then concat({', '.join(parts)})")
    rows = parsed(records).select("record_id", F.expr(f"inline(filter(case {' '.join(cases)} end, r -> r is not null))"))
    return rows.distinct()


def flat_table(records: DataFrame, name: str) -> DataFrame:
    """One flat table: record_id, the key of its root (DOI or PubMed id), its packed id, its parent's id, position and columns.

    A list element given as a bare string fills the table's first text column. Ids are
    (parent id << bits) | position, so they are equal on every run.
    """
    source, tables = next((s, ts) for s, ts in TABLES.items() if any(t.name == name for t in ts))
    by_name = {t.name: t for t in tables}
    t = by_name[name]
    up = by_name.get(t.parent) if t.parent else None
    parent_id = "record_id" if up is None else packed("record_id", "h", up.bits)
    cols = []
    for k, (c, p) in enumerate(t.columns.items()):
        own = f"try_variant_get(e, {_literal(p)}, 'string')"
        bare = "if(schema_of_variant(e) = 'STRING', try_variant_get(e, '$', 'string'), null)"
        cols.append(f"{f'coalesce({own}, {bare})' if k == 0 and p != '$' else own} as `{c}`")
    row = f"struct({packed(parent_id, 'i', t.bits)} as id, {parent_id} as `{t.key}`, i as position, {', '.join(cols)})"
    key, at = ROOT_KEYS[source]
    docs = parsed(records.where(F.lower(F.trim("source")) == source))
    return docs.select(
        "record_id", F.lower(F.expr(f"try_variant_get(doc, '{at}', 'string')")).alias(f"root_{key}"), F.expr(f"inline(filter({_emit(t, by_name, row)}, r -> r is not null))")
    ).distinct()
