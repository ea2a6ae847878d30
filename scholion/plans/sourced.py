"""Queries through the sources and processes: containers are written from the tables, read by a source, and compared with SQL over the tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.text import DOI_ENTITIES
from scholion.operators import metrics
from scholion.plans import processes
from scholion.plans.studies import _W
from scholion.session import checkpoint_dir, table
from scholion.sources.all import Asjcs, Crossref, JournalNames, Pubmed

QUERIES: dict = {}
ORACLE: dict = {}
#: Container files that a table is written to.
FILES = 16
_MADE: dict[tuple, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# ---- containers from the tables ----


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under that of the checkpoints, which all machines share."""
    at = os.path.join(urlparse(checkpoint_dir(spark)).path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(at, exist_ok=True)
    return at


def _once(spark: SparkSession, d: str, name: str, make: Callable[[str], None]) -> str:
    """The folder that ``make`` has filled from the tables under d, once a session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        at = _folder(spark, name)
        make(at)
        _MADE[key] = at
    return _MADE[key]


def write_containers(bodies: DataFrame, folder: str, pattern: str, head: str = "", tail: str = "") -> None:
    """Writes (file, place, body) rows as gzip files, one a value of ``file``, bodies in the order of ``place`` with one a line.

    The bodies of a file pass through its task in batches; they are never held together.
    """

    def write(batches):
        import gzip
        from itertools import chain, groupby

        import pandas as pd

        rows = chain.from_iterable(zip(pdf["file"], pdf["body"]) for pdf in batches)
        for number, of_file in groupby(rows, key=lambda row: row[0]):
            n = 0
            with gzip.open(os.path.join(folder, pattern.format(int(number))), "wt", encoding="utf-8") as f:
                f.write(head)
                for _, body in of_file:
                    f.write(body + "\n")
                    n += 1
                f.write(tail)
            yield pd.DataFrame({"file": [number], "n": [n]})

    apart = bodies.repartitionById(FILES, F.col("file").cast("int")).sortWithinPartitions("file", "place")
    apart.select("file", "body").mapInPandas(write, "file long, n long").count()


def _references(t) -> DataFrame:
    """One row a (work_id, key). The rows of a work lie together, so that neither this nor what groups them by work shuffles again."""
    return t("work_references").where("work_id is not null and key is not null").select("work_id", "key", "doi", "year", "article_title").repartition("work_id").groupBy("work_id", "key").agg(*(F.min(c).alias(c) for c in ("doi", "year", "article_title")))


_R = "r AS (SELECT work_id, key, min(doi) AS doi, min(year) AS year, min(article_title) AS article_title FROM work_references WHERE work_id IS NOT NULL AND key IS NOT NULL GROUP BY ALL)"


def crossref(spark: SparkSession, d: str, **options) -> Crossref:
    """A source of gzip files of JSON works with their references; file k holds the works whose id has the remainder k."""

    def make(at: str) -> None:
        t = lambda name: table(spark, d, name)
        refs = _references(t).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("key", F.col("doi").alias("DOI"), "year", F.col("article_title").alias("article-title")))).alias("reference"))
        w = metrics.deduplicated_works(t("works")).join(refs, F.col("id") == F.col("work_id"), "left")
        issn = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("value")))
        body = F.struct(
            F.col("doi").alias("DOI"), F.when(F.col("title").isNotNull(), F.array("title")).alias("title"), F.struct(F.when(F.col("published_year").isNotNull(), F.array(F.array("published_year"))).alias("date-parts")).alias("published"),
            "type", "page", "publisher", F.array_compact(F.array(issn("print", "issn_print"), issn("electronic", "issn_electronic"))).alias("issn-type"), "reference",
        )
        write_containers(w.select(F.pmod("id", F.lit(FILES)).alias("file"), F.col("id").alias("place"), F.to_json(body).alias("body")), at, "{:05d}.json.gz")

    return Crossref(spark, _once(spark, d, "crossref", make), **options)


def pubmed(spark: SparkSession, d: str) -> Pubmed:
    """A source of gzip files of XML articles with their authors and these' affiliations."""

    def make(at: str) -> None:
        escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>"))).otherwise("")
        a = table(spark, d, "pubmed_authors").where("article_id is not null and id is not null").select("id", "article_id", "given", "family", "suffix", "initials", "valid", "collective_name").distinct()
        aff = table(spark, d, "pubmed_author_affiliations").select("author_id", "affiliation").distinct()
        per = aff.groupBy("author_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<AffiliationInfo>"), tag("Affiliation", F.col("affiliation")), F.lit("</AffiliationInfo>")))), "").alias("affs"))
        names = (("LastName", "family"), ("ForeName", "given"), ("Suffix", "suffix"), ("Initials", "initials"), ("CollectiveName", "collective_name"))
        author = F.concat(F.lit("<Author>"), *(tag(n, F.col(c)) for n, c in names), F.coalesce("affs", F.lit("")), F.lit("</Author>"))
        listed = a.join(per, F.col("id") == F.col("author_id"), "left").groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", author.alias("x")))), lambda s: s["x"]), "").alias("authors"))
        body = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("article_id").cast("string"), F.lit("</PMID><Article><AuthorList>"), F.col("authors"), F.lit("</AuthorList></Article></MedlineCitation></PubmedArticle>"))
        write_containers(listed.select(F.pmod("article_id", F.lit(FILES)).alias("file"), F.col("article_id").alias("place"), body.alias("body")), at, "pubmed{:05d}.xml.gz", "<PubmedArticleSet>\n", "</PubmedArticleSet>")

    return Pubmed(spark, _once(spark, d, "pubmed", make))


def _csv(frame: DataFrame, at: str, delimiter: str) -> str:
    """A CSV file with a header; the rows come through the driver one partition at a time, as the format is one file."""
    import csv

    path = os.path.join(at, "table.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=delimiter)
        out.writerow(frame.columns)
        out.writerows(frame.toLocalIterator())
    return path


def journal_names(spark: SparkSession, d: str) -> JournalNames:
    columns = ("title", "crossref_id", "publisher", "issn_print", "issn_eprint", "issns_additional", "doi", "volume_info")
    at = _once(spark, d, "journals", lambda folder: _csv(table(spark, d, "journal_names").orderBy("id").select(*columns), folder, ","))
    return JournalNames(spark, os.path.join(at, "table.csv"))


def subjects(spark: SparkSession, d: str) -> Asjcs:
    part = table(spark, d, "part").orderBy("p_partkey").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("field"), F.col("p_brand").alias("subject_area"))
    return Asjcs(spark, os.path.join(_once(spark, d, "asjcs", lambda folder: _csv(part, folder, ";")), "table.csv"))


def _doi(x: str) -> str:
    """SQL for a DOI in normal form."""
    x = f"lower({x})"
    halves = f"string_split({x}, ' ')"
    x = f"CASE WHEN len({halves}) = 2 AND {halves}[1] = {halves}[2] THEN {halves}[1] ELSE replace({x}, ' ', '') END"
    for a, b in DOI_ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_JOIN = f"WITH {_W}, {_R} "


# ---- queries ----


@query(f"WITH {_W} SELECT {_doi('doi')} AS doi, title, published_year::INTEGER AS published_year, type, page, publisher, replace(issn_print, '-', '') AS issn_print, replace(issn_electronic, '-', '') AS issn_electronic FROM w")
def source_table(spark, d):
    """A table of a source, with its DOIs and ISSNs in normal form."""
    return crossref(spark, d).table("works").select("doi", "title", "published_year", "type", "page", "publisher", "issn_print", "issn_electronic")


@query(_JOIN + f"SELECT type, count(*)::BIGINT AS refs, count(DISTINCT {_doi('r.doi')})::BIGINT AS dois FROM w JOIN r ON r.work_id = w.id GROUP BY ALL")
def source_query(spark, d):
    """SQL over two tables of a source."""
    sql = "SELECT type, count(*) AS refs, count(DISTINCT work_references.doi) AS dois FROM works JOIN work_references ON works.id = work_references.work_id GROUP BY type"
    return crossref(spark, d).query(sql)


@query(f"WITH {_W} SELECT type, count(*)::BIGINT AS n FROM w GROUP BY id % {FILES}, type")
def source_query_partitioned(spark, d):
    """A grouping on each container, of which only the file is read."""
    return crossref(spark, d).query("SELECT type, count(*) AS n FROM works GROUP BY type", partition=True)


@query(f"WITH {_W} SELECT count(*)::BIGINT AS n, count(title)::BIGINT AS titles FROM w WHERE id % {FILES} IN (3, 8)")
def source_sample(spark, d):
    """Whole containers, chosen by their paths before reading."""
    return crossref(spark, d, sample=lambda path: path.endswith(("00003.json.gz", "00008.json.gz"))).query("SELECT count(*) AS n, count(title) AS titles FROM works")


def _populated(source, spark, name: str, columns: list[str], condition: str | None = None) -> Callable[[str], DataFrame]:
    at = _folder(spark, name)
    source.populate(at, columns, condition)
    return lambda t: spark.read.parquet(os.path.join(at, t))


@query(_JOIN + f"SELECT {_doi('w.doi')} AS doi, r.key, r.year FROM w JOIN r ON r.work_id = w.id WHERE w.published_year BETWEEN 2010 AND 2012")
def source_populate_root(spark, d):
    """Child rows of the roots that a condition on the root selects, joined by the ids written."""
    read = _populated(crossref(spark, d), spark, "root", ["works.id", "works.doi", "work_references.work_id", "work_references.key", "work_references.year"], "works.published_year BETWEEN 2010 AND 2012")
    return read("works").join(read("work_references"), F.col("id") == F.col("work_id")).select("doi", "key", "year")


@query(_JOIN + f"SELECT {_doi('w.doi')} AS doi, count(r.key)::BIGINT AS refs FROM w JOIN r ON r.work_id = w.id WHERE w.id IN (SELECT work_id FROM r WHERE year = '2009') GROUP BY w.id, w.doi")
def source_populate_detail(spark, d):
    """Roots and all child rows of those that a condition on a child table selects."""
    read = _populated(crossref(spark, d), spark, "detail", ["works.id", "works.doi", "work_references.work_id", "work_references.key"], "work_references.year = '2009'")
    return read("works").join(read("work_references"), F.col("id") == F.col("work_id")).groupBy("id", "doi").agg(F.count("key").alias("refs")).select("doi", "refs")


@query(f"{_JOIN} SELECT r.key, {_doi('r.doi')} AS doi FROM w JOIN r ON r.work_id = w.id WHERE r.year = '2009'")
def source_populate_single(spark, d):
    """A condition on the only table populated filters its rows."""
    return _populated(crossref(spark, d), spark, "single", ["work_references.key", "work_references.doi"], "year = '2009'")("work_references")


@query(_JOIN + f"SELECT {_doi('w.doi')} AS doi, w.title FROM w WHERE w.published_year > 2015 AND EXISTS (SELECT 1 FROM r JOIN w v ON r.work_id = v.id WHERE r.year = '2009' AND {_doi('r.doi')} = {_doi('w.doi')})")
def source_attached(spark, d):
    """A query over a source and an attached database, which was populated before."""
    at, name = _folder(spark, "attached"), f"kept_{uuid.uuid4().hex[:8]}"
    crossref(spark, d).populate(at, ["work_references.doi"], "year = '2009'")
    source = crossref(spark, d, attach=[f"{name}:{at}"])
    return source.query(f"SELECT doi, title FROM works WHERE published_year > 2015 AND EXISTS (SELECT 1 FROM {name}.work_references k WHERE k.doi = works.doi)")


@query("SELECT article_id::VARCHAR AS article, nullif(family, '') AS family, nullif(given, '') AS given, nullif(initials, '') AS initials, nullif(collective_name, '') AS collective_name FROM (SELECT DISTINCT id, article_id, given, family, suffix, initials, valid, collective_name FROM pubmed_authors WHERE article_id IS NOT NULL AND id IS NOT NULL)")
def source_xml_table(spark, d):
    """Articles and authors of XML containers, joined by their ids."""
    with pubmed(spark, d) as source:
        return source.query("SELECT pubmed_id AS article, family, given, initials, collective_name FROM pubmed_articles JOIN pubmed_authors ON pubmed_articles.id = pubmed_authors.article_id")


@query("""WITH a AS (SELECT DISTINCT id, article_id, given, family, suffix, initials, valid, collective_name FROM pubmed_authors WHERE article_id IS NOT NULL AND id IS NOT NULL), f AS (SELECT DISTINCT author_id, affiliation FROM pubmed_author_affiliations)
SELECT article_id::VARCHAR AS article, count(*)::BIGINT AS affiliations, count(nullif(affiliation, ''))::BIGINT AS stated FROM a JOIN f ON f.author_id = a.id GROUP BY 1""")
def source_xml_grandchildren(spark, d):
    """Affiliations of XML authors, tied to the article over two ids."""
    sql = """SELECT pubmed_articles.pubmed_id AS article, count(*) AS affiliations, count(affiliation) AS stated FROM pubmed_articles JOIN pubmed_authors ON pubmed_articles.id = pubmed_authors.article_id
             JOIN pubmed_author_affiliations ON pubmed_author_affiliations.author_id = pubmed_authors.id GROUP BY 1"""
    return pubmed(spark, d).query(sql)


@query("""WITH j AS (SELECT replace(issn_print, '-', '') AS p, replace(issn_eprint, '-', '') AS e, replace(issns_additional, '-', '') AS a FROM journal_names),
i AS (SELECT unnest(string_split(a, '; ')) AS issn, 'A' AS issn_type FROM j UNION ALL SELECT p, 'P' FROM j UNION ALL SELECT e, 'E' FROM j)
SELECT issn, issn_type, count(*)::BIGINT AS n FROM i WHERE issn IS NOT NULL AND issn <> '' GROUP BY ALL""")
def source_csv_journals(spark, d):
    """A CSV file populated, its ISSNs normalised and spread to a table of their own."""
    read = _populated(journal_names(spark, d), spark, "journals_db", ["journal_names.*"])
    return read("journals_issns").groupBy("issn", "issn_type").agg(F.count("*").alias("n"))


# ---- processes ----


def _database(spark, d: str, name: str, tables: dict[str, DataFrame]) -> str:
    at = _folder(spark, name)
    for t, frame in tables.items():
        frame.write.parquet(os.path.join(at, t))
    return at


def _linking(spark, d: str) -> dict[str, DataFrame]:
    orgs = table(spark, d, "research_organizations").select("id", "name", "status", "ror_path", "address_city").distinct()
    none = orgs.where("false").select(F.col("id").alias("ror_id"))
    return {
        "author_affiliations": table(spark, d, "pubmed_author_affiliations").select("author_id", F.col("affiliation").alias("name")).distinct(),
        "research_organizations": orgs, "ror_acronyms": none.withColumn("acronym", F.lit("").cast("string")),
        "ror_aliases": orgs.where("id % 7 = 0 and name is not null").select(F.col("id").alias("ror_id"), F.concat(F.lit("The "), F.col("name")).alias("alias")).distinct(),
        "ror_relationships": table(spark, d, "ror_relationships").select("ror_id", "type", "ror_path"),
    }


_WORDS = """n AS (SELECT name AS word, min(id) AS ror_id FROM (SELECT DISTINCT id, name, status, ror_path, address_city FROM research_organizations WHERE coalesce(status, '') <> 'withdrawn' AND name IS NOT NULL) GROUP BY name HAVING count(*) = 1),
al AS (SELECT word, min(id) AS ror_id FROM (SELECT DISTINCT id, 'The ' || name AS word FROM research_organizations WHERE id % 7 = 0 AND name IS NOT NULL) GROUP BY word HAVING count(*) = 1),
every AS (SELECT word, ror_id FROM al UNION ALL SELECT word, ror_id FROM n WHERE word NOT IN (SELECT word FROM al)),
inside AS (SELECT DISTINCT a.word FROM every a JOIN every b ON a.word <> b.word AND contains(b.word, a.word)),
kept AS (SELECT * FROM every WHERE word <> '' AND word NOT IN (SELECT word FROM inside)),
f AS (SELECT row_number() OVER () AS k, author_id, affiliation FROM (SELECT DISTINCT author_id, affiliation FROM pubmed_author_affiliations WHERE affiliation IS NOT NULL)),
best AS (SELECT author_id, arg_min(ror_id, (-length(word), strpos(affiliation, word))) AS ror_id FROM f JOIN kept ON contains(affiliation, word) GROUP BY k, author_id)"""


@query(f"WITH {_WORDS} SELECT ror_id, author_id AS work_author_id FROM best")
def process_link_organisations(spark, d):
    """Affiliations to the organisations they name, by names and aliases that occur once and inside no other."""
    at = _database(spark, d, "linked", _linking(spark, d))
    processes.link_aa_base_ror(spark, at)
    return spark.read.parquet(os.path.join(at, "work_authors_rors"))


@query(f"""WITH RECURSIVE {_WORDS}, held AS (SELECT DISTINCT id, ror_path FROM research_organizations WHERE id IS NOT NULL AND ror_path IS NOT NULL),
l AS (SELECT lower(trim(type)) AS kind, ror_id, held.id AS other FROM ror_relationships JOIN held USING (ror_path) WHERE ror_id IN (SELECT id FROM held)),
p AS (SELECT id, min(parent) AS parent FROM (SELECT ror_id AS id, other AS parent FROM l WHERE kind = 'parent' UNION ALL SELECT other, ror_id FROM l WHERE kind = 'child') GROUP BY 1),
u AS (SELECT id, parent, 1 AS k FROM p UNION ALL SELECT u.id, p.parent, k + 1 FROM u JOIN p ON p.id = u.parent WHERE k < 200),
roots AS (SELECT id, any_value(parent) AS root FROM u WHERE parent NOT IN (SELECT id FROM p) GROUP BY 1)
SELECT DISTINCT coalesce(root, ror_id) AS ror_id, author_id AS work_author_id FROM best LEFT JOIN roots ON roots.id = ror_id""")
def process_link_top_organisations(spark, d):
    """The same, raised along the hierarchy to the top."""
    at = _database(spark, d, "topped", _linking(spark, d))
    processes.link_aa_top_ror(spark, at)
    return spark.read.parquet(os.path.join(at, "work_authors_rors"))


@query("SELECT l_orderkey AS work_id, p_partkey AS asjc_id FROM (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1) JOIN part USING (p_name)")
def process_link_subjects(spark, d):
    """Works to the codes of their subjects, which come from a CSV file."""
    line = table(spark, d, "lineitem").where("l_linenumber = 1").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    at = _database(spark, d, "subjects", {"work_subjects": line.select(F.col("l_orderkey").alias("work_id"), F.col("p_name").alias("name")).distinct()})
    subjects(spark, d).populate(at, ["asjc_import.*"])
    processes.link_works_asjcs(spark, at)
    return spark.read.parquet(os.path.join(at, "works_asjcs"))


@query(r"""WITH a AS (SELECT doc_id::VARCHAR AS patent_id, source AS nplcit_num, regexp_extract(text, '(?i)((doi: *)|(doi\.org/))([^,; )>]+)', 4) AS x FROM documents WHERE text ILIKE '%DOI:%' OR text ILIKE '%doi.org/%'),
b AS (SELECT patent_id, nplcit_num, lower(regexp_replace(coalesce(nullif(regexp_extract(x, '(?i)((doi: *)|(doi\.org/))([^,; )>]+)', 4), ''), x), '\.$', '')) AS doi FROM a) SELECT * FROM b WHERE regexp_matches(doi, '^10\.[0-9]{4,9}/..')""")
def process_patent_dois(spark, d):
    """DOIs stated in free text."""
    cited = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("patent_id"), F.col("source").alias("nplcit_num"), F.col("text").alias("nplcit_othercit"))
    at = _database(spark, d, "patents", {"usp_citations": cited})
    processes.link_uspto_doi(spark, at)
    return spark.read.parquet(os.path.join(at, "usp_nplcit_dois"))
