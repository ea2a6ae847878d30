"""Queries of the general training-data problems (1, 2, 3, 6), and their SQL where SQL can state them."""

from __future__ import annotations

from scholion.operators import hierarchy, multivalue, nested, orphans
from scholion.session import table


def p1_found(spark, d):
    return orphans.orphan_references(table(spark, d, "work_references"), table(spark, d, "works"))


def p1_orphan_report(spark, d):
    return orphans.orphan_report(p1_found(spark, d))


def p2_found(spark, d):
    return hierarchy.organisation_paths(table(spark, d, "ror_relationships"), table(spark, d, "research_organizations"))


def p2_descendants(spark, d):
    return hierarchy.descendants(hierarchy.all_links(table(spark, d, "ror_relationships"), table(spark, d, "research_organizations")))


def p2_top_links(spark, d):
    orgs = table(spark, d, "research_organizations")
    return hierarchy.raise_to_root(table(spark, d, "work_authors_top_rors"), hierarchy.organisation_paths(table(spark, d, "ror_relationships"), orgs), orgs)


def p3_found(spark, d):
    return nested.element_paths(table(spark, d, "raw_records"))


def _flat(name):
    def query(spark, d):
        return nested.flat_table(table(spark, d, "raw_records"), name)

    return query


def p6_found(spark, d):
    from pyspark.sql import functions as F

    issns = multivalue.split_column(table(spark, d, "journal_names"), "id", "issns_additional", multivalue.CODES, multivalue.issn_value)
    titles = multivalue.split_column(table(spark, d, "works"), "id", "title", multivalue.PROSE)
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), "pos", "value")
    return named(issns, "journal_names").unionByName(named(titles, "works"))


QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_report": p1_orphan_report,
    "p2_found": p2_found,
    "p2_descendants": p2_descendants,
    "p2_top_links": p2_top_links,
    "p3_found": p3_found,
    **{f"p3_{t.name}": _flat(t.name) for tables in nested.TABLES.values() for t in tables},
    "p6_found": p6_found,
}

_P1 = r"""
WITH refs AS (
  SELECT work_id, key AS ref_key, arg_min(doi, indexed_at) AS doi, min(indexed_at) AS seen FROM work_references GROUP BY work_id, key),
r AS (SELECT work_id, ref_key, seen, {k} AS k FROM refs),
w AS (SELECT {k} AS k, min(indexed_at) AS first_at, min(deleted_at) AS gone_at FROM works GROUP BY 1),
orphans AS (
  SELECT work_id, ref_key, 'work_id' AS side, 'missing' AS reason, seen FROM r
  WHERE work_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM works WHERE works.id = r.work_id)
  UNION ALL
  SELECT work_id, ref_key, 'doi', CASE WHEN w.k IS NULL THEN 'missing' WHEN first_at > seen THEN 'late' WHEN gone_at <= seen THEN 'deleted' END, seen
  FROM r LEFT JOIN w ON r.k = w.k WHERE r.k IS NOT NULL)
""".format(k=r"nullif(lower(regexp_replace(regexp_replace(doi, '^\s+|\s+$', '', 'g'), '^.*?(10\.)', '\1')), '')")

_LINKS = """
WITH RECURSIVE held AS (SELECT DISTINCT id, ror_path FROM research_organizations),
every AS (
    SELECT DISTINCT CASE WHEN lower(trim(type)) = 'parent' THEN r.ror_id ELSE h.id END AS id, CASE WHEN lower(trim(type)) = 'parent' THEN h.id ELSE r.ror_id END AS parent
    FROM ror_relationships r JOIN held h USING (ror_path)
    WHERE lower(trim(type)) IN ('parent', 'child') AND r.ror_id IN (SELECT id FROM held)),
links AS (SELECT id, min(parent) AS parent FROM every GROUP BY id),
walk AS (
  SELECT id, parent AS top, 1 AS depth, [parent] AS chain FROM links
  UNION ALL
  SELECT w.id, l.parent, depth + 1, list_prepend(l.parent, chain) FROM walk w JOIN links l ON l.id = w.top WHERE NOT list_contains(w.chain[2:], w.top)),
looped AS (SELECT id, bool_or(top = id) AS own FROM walk GROUP BY id HAVING bool_or(list_contains(chain[2:], top)) OR bool_or(top = id)),
nodes AS (
  SELECT w.id, w.top AS root, w.depth, w.chain FROM walk w WHERE w.id NOT IN (SELECT id FROM looped) AND w.top NOT IN (SELECT id FROM links)),
paths AS (
  SELECT id AS ror_id, root AS root_id, CAST(depth AS INTEGER) AS depth, array_to_string(list_append(chain, id), '/') AS path FROM nodes
  UNION ALL SELECT id, -1, -1, CASE WHEN own THEN 'cycle' ELSE 'below' END FROM looped)
"""


_ENV = " ".join(f"WHEN '{s}' THEN '$.{e}'" for s, e in nested.ENVELOPES.items())
_DOCS = f"""WITH bodies AS (SELECT DISTINCT record_id, source, CAST(body AS JSON) AS b FROM raw_records WHERE json_valid(body)),
    opened AS (SELECT record_id, source, b, json_extract(b, CASE source {_ENV} END) AS inside FROM bodies),
    docs AS (SELECT record_id, source, CASE WHEN inside IS NULL OR json_type(inside) = 'NULL' THEN b ELSE inside END AS doc FROM opened)"""


def _steps(path: str) -> str:
    """A key path in DuckDB's quoting."""
    if path == "$":
        return path
    names = [path[3:-2]] if path.startswith("$['") else path[2:].split(".")
    return "$" + "".join(f'."{n}"' for n in names)


def _unnested(rows: str, value: str, keep: str, at: str) -> str:
    """One level by position; a value that is no list is wrapped into one."""
    as_list = "CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'NULL' THEN []::JSON[] ELSE [v] END"
    lists = f"(SELECT {keep}, {as_list} AS l FROM (SELECT {keep}, {value} AS v FROM {rows}) WHERE v IS NOT NULL)"
    flat = f"(SELECT {keep}, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS {at} FROM {lists})"
    return f"(SELECT * FROM {flat} WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"


def _elements(source: str, t: nested.NestedTable, by_name: dict) -> str:
    docs = f"(SELECT * FROM docs WHERE source = '{source}')"
    if t.parent is None:
        return _unnested(docs, f"json_extract(doc, '{_steps(t.path)}')", "record_id, doc", "i")
    up = _unnested(docs, f"json_extract(doc, '{_steps(by_name[t.parent].path)}')", "record_id, doc", "h")
    return _unnested(up, f"json_extract(e, '{_steps(t.path)}')", "record_id, doc, h", "i")


def _p3_sql() -> str:
    parts = []
    for source, tables in nested.TABLES.items():
        by_name = {t.name: t for t in tables}
        for t in tables:
            path = "CAST(i AS VARCHAR)" if t.parent is None else "concat(h, '.', i)"
            parts.append(f"SELECT record_id, '{t.name}' AS table_name, {path} AS path FROM {_elements(source, t, by_name)}")
    return f"{_DOCS} SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


def _flat_sql(source: str, t: nested.NestedTable, by_name: dict) -> str:
    key, at = nested.ROOT_KEYS[source]
    parent = "record_id" if t.parent is None else f"(record_id << {by_name[t.parent].bits} | h)"
    cols = []
    for k, (c, p) in enumerate(t.columns.items()):
        own = f"json_extract_string(e, '{_steps(p)}')"
        bare = "CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END"
        cols.append(f'{f"coalesce({own}, {bare})" if k == 0 and p != "$" else own} AS "{c}"')
    return f"""{_DOCS} SELECT DISTINCT record_id, lower(json_extract_string(doc, '{_steps(at)}')) AS root_{key}, ({parent} << {t.bits} | i)::BIGINT AS id,
        {parent}::BIGINT AS {t.key}, i::INTEGER AS position, {', '.join(cols)} FROM {_elements(source, t, by_name)}"""


ORACLE = {
    "p1_found": _P1 + "SELECT work_id, ref_key, side, reason, strftime(seen, '%Y-%m') AS period FROM orphans WHERE reason IS NOT NULL",
    "p1_orphan_report": _P1
    + "SELECT 'work_references' AS table_name, side, reason, strftime(seen, '%Y-%m') AS period, count(*) AS orphans FROM orphans WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": _LINKS + "SELECT ror_id, root_id, depth, path FROM paths",
    "p2_descendants": _LINKS
    + """, up AS (SELECT id, parent AS top, 1 AS k FROM every UNION SELECT up.id, e.parent, k + 1 FROM up JOIN every e ON e.id = up.top WHERE k < 100),
         bad AS (SELECT id FROM up WHERE top IN (SELECT id FROM up WHERE id = top) OR id = top)
         SELECT top AS ror_id, id AS descendant_id, CAST(min(k) AS INTEGER) AS distance FROM up WHERE id NOT IN (SELECT id FROM bad) GROUP BY ALL""",
    "p2_top_links": _LINKS
    + """SELECT DISTINCT coalesce(nullif(p.root_id, -1), a.ror_id) AS ror_id, a.work_author_id FROM work_authors_top_rors a
         LEFT JOIN paths p ON p.ror_id = a.ror_id WHERE a.ror_id IN (SELECT id FROM held) AND a.work_author_id IS NOT NULL""",
    "p3_found": _p3_sql(),
    **{f"p3_{t.name}": _flat_sql(s, t, {u.name: u for u in tables}) for s, tables in nested.TABLES.items() for t in tables},
}
