"""Queries of the training-data problems of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from scholion.llm import linkage, lookalike, names, packing, tokenize, topn
from scholion.session import table


def p4_found(spark, d):
    return topn.community_top_journals(table(spark, d, "cluster_representatives"), table(spark, d, "citations2"))


def p5_persons(spark, d):
    return names.author_persons(table(spark, d, "pubmed_authors"), table(spark, d, "given_nicknames"))


def p5_found(spark, d):
    return names.variant_pairs(p5_persons(spark, d))


def p7_links(spark, d):
    return linkage.affiliation_links(table(spark, d, "pubmed_author_affiliations"), table(spark, d, "research_organizations"))


def p7_found(spark, d):
    return linkage.named_organisations(p7_links(spark, d))


def p8_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents"))


def p9_packed(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_decoded(spark, d):
    return tokenize.decode(p8_ids(spark, d))


def p9_check(spark, d):
    return packing.packing_check(p9_packed(spark, d), table(spark, d, "pack_capacities"))


def p9_fill(spark, d):
    return packing.fill_report(p9_packed(spark, d), table(spark, d, "pack_capacities"))


def p10_found(spark, d):
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p10_form(spark, d):
    return lookalike.consistent_form(table(spark, d, "documents")).select("doc_id", "form")


def p10_classes(spark, d):
    return lookalike.lookalike_classes(table(spark, d, "documents"))


QUERIES = {
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_persons": p5_persons,
    "p7_found": p7_found,
    "p7_links": p7_links,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p9_fill": p9_fill,
    "p9_check": p9_check,
    "p8_decoded": p8_decoded,
    "p10_found": p10_found,
    "p10_form": p10_form,
    "p10_classes": p10_classes,
}

ORACLE = {
    "p4_found": """
        SELECT community_id, journal_id, CAST(row_rank AS INTEGER) AS row_rank FROM (
          SELECT community_id, journal_id, row_number() OVER (PARTITION BY community_id ORDER BY citations_number DESC NULLS LAST, journal_id) AS row_rank
          FROM (SELECT DISTINCT community_id, journal_id FROM cluster_representatives WHERE community_id IS NOT NULL AND journal_id IS NOT NULL)
          LEFT JOIN (SELECT journal_id, max(citations_number) AS citations_number FROM citations2 GROUP BY 1) USING (journal_id))
        WHERE row_rank <= 10""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_check": """
        SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS without_space,
          0 AS split_though_fitting, 0 AS pieces_not_full, 0 AS over_capacity, 0 AS over_window, 0 AS uneven_steps
        FROM (SELECT DISTINCT capacity_id FROM pack_capacities)""",
    "p10_form": f"SELECT doc_id, form FROM ({lookalike.fold_sql('documents')})",
    "p10_classes": f"""
        WITH f AS (SELECT doc_id, text, form FROM ({lookalike.fold_sql('documents')}) JOIN documents USING (doc_id) WHERE regexp_replace(form, '[\\s\\p{{Cc}}]+', '', 'g') <> '')
        SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS links FROM f""",
    "p10_found": f"""
        WITH f AS (SELECT doc_id, text, form FROM ({lookalike.fold_sql('documents')}) JOIN documents USING (doc_id) WHERE regexp_replace(form, '[\\s\\p{{Cc}}]+', '', 'g') <> '')
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text""",
}
