"""Study queries over whole tables: the relational operators, alone and in chains, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholion.functions import text
from scholion.operators import linking, metrics, normalize, ranking
from scholion.session import cut, table

QUERIES: dict = {}
ORACLE: dict = {}

#: Deliveries of a work to one row, and references with a DOI, as in metrics.deduplicated_works and metrics.citations.
_W = """w AS (SELECT id, unnest(max({'a': indexed_at, 'doi': doi, 'published_year': published_year, 'title': title, 'issn_print': issn_print,
  'issn_electronic': issn_electronic, 'page': page, 'type': type, 'publisher': publisher, 'published_month': published_month, 'published_day': published_day})) FROM works WHERE deleted_at IS NULL GROUP BY id)"""
_C = "c AS (SELECT DISTINCT work_id, lower(trim(doi)) AS doi FROM work_references WHERE doi IS NOT NULL AND trim(doi) <> '')"


def study(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        def run(spark, d):
            return f(lambda name: table(spark, d, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _works(t):
    return metrics.deduplicated_works(t("works"))


def _citations(t):
    return metrics.citations(t("work_references"))


# ---- projections, filters, predicates ----


@study("SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 AND o_orderstatus IS NOT NULL")
def project_filter_between(t):
    return t("orders").where(F.year("o_orderdate").between(1994, 1996) & F.col("o_orderstatus").isNotNull()).select("o_orderkey", "o_orderpriority")


_KINDS = [("review", "%review%"), ("survey", "%survey%"), ("trial", "%trial%"), ("case", "%case %"), ("study", "%study%"), ("notes", "%with notes%")]


@study(f"SELECT CASE {' '.join(f'''WHEN title ILIKE '{p}' THEN '{k}' ''' for k, p in _KINDS)} ELSE 'other' END AS kind, count(*)::BIGINT AS n FROM works WHERE title IS NOT NULL GROUP BY 1")
def like_ci_case_buckets(t):
    kind = F.coalesce(*(F.when(F.col("title").ilike(p), k) for k, p in _KINDS), F.lit("other"))
    return t("works").where("title is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@study("SELECT doc_id FROM documents WHERE regexp_matches(text, '[α-ωа-я]{3}') AND NOT text ILIKE '%doi%'")
def glob_class(t):
    return t("documents").where(F.col("text").rlike("[α-ωа-я]{3}") & ~F.col("text").ilike("%doi%")).select("doc_id")


@study("SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def in_list_boolean_group(t):
    return t("orders").groupBy(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent")).agg(F.count("*").alias("n"))


# ---- joins ----


@study("SELECT o_orderstatus, count(*)::BIGINT AS lines, count(DISTINCT l_partkey)::BIGINT AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def inner_group_count(t):
    return t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"))


@study("SELECT c_custkey, count(o_orderkey)::BIGINT AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer_counts(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return t("customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@study("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti_unmatched(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@study("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def exists_semi(t):
    return t("orders").join(t("lineitem").where("l_quantity > 48"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@study("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def in_subquery(t):
    return t("lineitem").join(t("part").where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@study("""WITH p AS (SELECT DISTINCT issn_print AS issn, 1 AS printed FROM works WHERE issn_print IS NOT NULL), e AS (SELECT DISTINCT issn_electronic AS issn, 1 AS online FROM works WHERE issn_electronic IS NOT NULL)
SELECT issn, printed, online FROM p FULL OUTER JOIN e USING (issn)""")
def full_outer_using(t):
    of = lambda c, n: t("works").where(F.col(c).isNotNull()).select(F.col(c).alias("issn")).distinct().withColumn(n, F.lit(1))
    return of("issn_print", "printed").join(of("issn_electronic", "online"), "issn", "full_outer").select("issn", "printed", "online")


@study("""WITH w AS (SELECT DISTINCT id, issn_print, issn_electronic FROM works), j AS (SELECT id AS journal_id, replace(issn_print, '-', '') AS p FROM journal_names)
SELECT DISTINCT w.id AS work_id, journal_id FROM w JOIN j ON replace(w.issn_print, '-', '') = p OR replace(w.issn_electronic, '-', '') = p""")
def or_join_rewrite(t):
    """A disjunction of two keys as the union of two equi joins."""
    works = t("works").select(F.col("id").alias("work_id"), F.replace("issn_print", F.lit("-"), F.lit("")).alias("a"), F.replace("issn_electronic", F.lit("-"), F.lit("")).alias("b")).distinct()
    journals = t("journal_names").select(F.col("id").alias("journal_id"), F.replace("issn_print", F.lit("-"), F.lit("")).alias("p"))
    one = lambda c: works.join(journals, F.col(c) == F.col("p")).select("work_id", "journal_id")
    return one("a").union(one("b")).distinct()


@study("""WITH s AS (SELECT DISTINCT l_suppkey AS unit, l_partkey AS ref FROM lineitem) SELECT a.unit AS unit_a, b.unit AS unit_b, count(*)::BIGINT AS coupling_strength
FROM s a JOIN s b ON a.ref = b.ref AND a.unit < b.unit GROUP BY ALL HAVING count(*) >= 5""")
def bibliographic_coupling(t):
    return metrics.coupling(t("lineitem"), "l_suppkey", "l_partkey", 5)


@study(f"""WITH {_W}, {_C} SELECT a.published_year::BIGINT AS year, count(*)::BIGINT AS citations_number FROM c JOIN w a ON a.id = c.work_id JOIN w b ON lower(trim(b.doi)) = c.doi
WHERE a.published_year - b.published_year BETWEEN 1 AND 2 GROUP BY 1""")
def two_year_citations(t):
    got = metrics.windowed_citations(_works(t), _citations(t), 2)
    return got.select(F.col("year").cast("bigint").alias("year"), "citations_number")


@study(f"""WITH {_W}, {_C} SELECT a.published_year::BIGINT AS year, count(*)::BIGINT AS citations_number FROM c JOIN w a ON a.id = c.work_id JOIN w b ON lower(trim(b.doi)) = c.doi
WHERE a.published_year - b.published_year BETWEEN 1 AND 20 GROUP BY 1""")
def twenty_year_citations(t):
    got = metrics.windowed_citations(_works(t), _citations(t), 20)
    return got.select(F.col("year").cast("bigint").alias("year"), "citations_number")


@study("""WITH r AS (SELECT max(year(o_orderdate)) AS y FROM orders) SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) BETWEEN (SELECT y FROM r) - 2 AND (SELECT y FROM r) - 1 GROUP BY 1""")
def scalar_subquery_bounds(t):
    orders = t("orders").withColumn("y", F.year("o_orderdate"))
    last = orders.agg(F.max("y").alias("last")).scalar()
    return orders.where(F.col("y").between(last - 2, last - 1)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# ---- aggregations ----


@study("SELECT published_year::BIGINT AS year, count(*)::BIGINT AS n, count(DISTINCT issn_print)::BIGINT AS journals, count(abstract)::BIGINT AS abstracts FROM works GROUP BY 1")
def yearly_works(t):
    return t("works").groupBy(F.col("published_year").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("issn_print").alias("journals"), F.count("abstract").alias("abstracts"))


_TYPES = ["journal-article", "book-chapter", "proceedings-article", "dataset"]


@study(" UNION ALL ".join(f"SELECT '{k}' AS metric, coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)::BIGINT AS n FROM works" for k, c in [("titled", "title IS NOT NULL"), ("abstracts", "abstract IS NOT NULL"), ("referenced", "references_count > 0"), *((k, f"type = '{k}'") for k in _TYPES)]))
def conditional_sums_unpivot(t):
    """Many counts in one pass over the table, then turned into rows."""
    parts = {"titled": F.col("title").isNotNull(), "abstracts": F.col("abstract").isNotNull(), "referenced": F.col("references_count") > 0} | {k: F.col("type") == k for k in _TYPES}
    one = t("works").agg(*(F.count_if(c).alias(k) for k, c in parts.items()))
    return one.unpivot([], list(parts), "metric", "n")


@study("SELECT 'works' AS metric, count(*)::BIGINT AS n FROM works UNION SELECT 'work DOIs', count(DISTINCT doi) FROM works UNION SELECT 'references', count(*) FROM work_references UNION SELECT 'authors', count(*) FROM pubmed_authors UNION SELECT 'affiliations', count(*) FROM pubmed_author_affiliations UNION SELECT 'organizations', count(*) FROM research_organizations UNION SELECT 'journals', count(*) FROM journal_names")
def metric_report(t):
    one = lambda k, df, e: df.agg(F.lit(k).alias("metric"), e.alias("n"))
    n = F.count("*")
    parts = [one("works", t("works"), n), one("work DOIs", t("works"), F.countDistinct("doi"))]
    parts += [one(k, t(x), n) for k, x in (("references", "work_references"), ("authors", "pubmed_authors"), ("affiliations", "pubmed_author_affiliations"), ("organizations", "research_organizations"), ("journals", "journal_names"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@study("SELECT 'status' AS property, status AS value, count(*)::BIGINT AS n FROM research_organizations GROUP BY ALL UNION SELECT 'country', address_country_code, count(*) FROM research_organizations GROUP BY ALL")
def categorical_profile(t):
    """Counts of several columns' values in one pass."""
    long = t("research_organizations").select(F.col("status").alias("status"), F.col("address_country_code").alias("country")).unpivot([], ["status", "country"], "property", "value")
    return long.groupBy("property", "value").agg(F.count("*").alias("n"))


@study("SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def group_concat_sorted(t):
    return t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("nations"))


@study("SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND avg(l_quantity) > 25")
def having_filter(t):
    got = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return got.where("n >= 20 and q > 25").drop("q")


@study("SELECT o_orderpriority, median(o_totalprice) AS median, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def group_median(t):
    p = "o_totalprice"
    return t("orders").groupBy("o_orderpriority").agg(F.median(p).alias("median"), F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"))


# ---- sets ----


@study("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).distinct()


@study("SELECT nation, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_all(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).groupBy("nation").agg(F.count("*").alias("n"))


@study("SELECT issn_print AS issn FROM works WHERE issn_print IS NOT NULL EXCEPT SELECT issn_electronic FROM works WHERE issn_electronic IS NOT NULL")
def except_distinct(t):
    w = t("works")
    return w.where("issn_print is not null").select(F.col("issn_print").alias("issn")).subtract(w.where("issn_electronic is not null").select("issn_electronic"))


# ---- sort, limit, ranks, windows ----


@study("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_multi_key(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@study("SELECT o_orderpriority, o_orderkey, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def topk_per_group(t):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("o_orderpriority", "o_orderkey", "rn")


@study("""WITH n AS (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1), top AS (SELECT c_nationkey FROM n ORDER BY k DESC, c_nationkey LIMIT 5)
SELECT CASE WHEN c_nationkey IN (SELECT c_nationkey FROM top) THEN c_nationkey ELSE -1 END AS nation, sum(k)::BIGINT AS n FROM n GROUP BY 1""")
def top_and_others(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    top = n.orderBy(F.desc("k"), "c_nationkey").limit(5).select("c_nationkey", F.lit(True).alias("top"))
    return n.join(F.broadcast(top), "c_nationkey", "left").groupBy(F.when(F.col("top"), F.col("c_nationkey")).otherwise(-1).alias("nation")).agg(F.sum("k").alias("n"))


@study("SELECT rank() OVER (ORDER BY count(*) DESC)::INTEGER AS rank, publisher, count(*)::BIGINT AS n FROM works WHERE publisher IS NOT NULL GROUP BY publisher QUALIFY rank <= 20")
def rank_over_count(t):
    n = t("works").where("publisher is not null").groupBy("publisher").agg(F.count("*").alias("n"))
    return ranking.rank_by_count(n, "n").where("rank <= 20").select("rank", "publisher", "n")


@study("""WITH n AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), q AS (SELECT k, ntile(4) OVER (ORDER BY k, o_custkey) AS quartile FROM n)
SELECT quartile::INTEGER AS quartile, min(k)::BIGINT AS least, max(k)::BIGINT AS most FROM q GROUP BY 1""")
def ntile_quartiles(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    q = ranking.global_ntile(n, ["k", "o_custkey"], 4, "quartile")
    return q.groupBy("quartile").agg(F.min("k").alias("least"), F.max("k").alias("most"))


@study("""WITH y AS (SELECT published_year AS year, count(*) AS n FROM works WHERE published_year IS NOT NULL GROUP BY 1)
SELECT year::INTEGER AS year, (sum(n) OVER (ORDER BY year))::BIGINT AS running, (sum(n) OVER (ORDER BY year ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))::BIGINT AS before FROM y""")
def running_and_framed_sums(t):
    y = t("works").where("published_year is not null").groupBy(F.col("published_year").alias("year")).agg(F.count("*").alias("n"))
    w = Window.orderBy("year")
    return y.select("year", F.sum("n").over(w).alias("running"), F.sum("n").over(w.rowsBetween(-21, -1)).alias("before"))


@study("""WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), i AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS island FROM m)
SELECT o_custkey, min(m)::INTEGER AS start, count(*)::BIGINT AS streak FROM i GROUP BY o_custkey, island HAVING count(*) >= 3""")
def islands_streaks(t):
    return metrics.streaks(t("orders").withColumn("at", F.year("o_orderdate") * 12 + F.month("o_orderdate")), "o_custkey", "at", 3)


_PARTS = "SELECT l_suppkey, l_partkey, count(*) AS k FROM lineitem GROUP BY ALL"


@study(f"""WITH {_W}, {_C}, n AS (SELECT doi, count(*) AS k FROM c GROUP BY 1), s AS (SELECT issn_print AS issn, k FROM w JOIN n ON n.doi = lower(trim(w.doi)) WHERE issn_print IS NOT NULL),
r AS (SELECT issn, k, row_number() OVER (PARTITION BY issn ORDER BY k DESC) AS rn FROM s) SELECT issn, max(rn)::INTEGER AS h_index FROM r WHERE rn <= k GROUP BY 1""")
def journal_h_index(t):
    counts = metrics.citation_counts(_citations(t))
    scores = _works(t).where("issn_print is not null").select(F.col("issn_print").alias("issn"), F.lower(F.trim("doi")).alias("doi")).join(counts, "doi")
    return metrics.h_index(scores, "issn", "citations_number")


@study(f"""WITH s AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC) AS rn FROM s), h AS (SELECT l_suppkey, max(rn) AS h FROM r WHERE rn <= k GROUP BY 1)
SELECT l_suppkey, h::INTEGER AS h_index, median(k)::DOUBLE AS h_median FROM h JOIN r USING (l_suppkey) WHERE rn <= h GROUP BY ALL""")
def journal_h_median(t):
    return metrics.h_median(t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("k")), "l_suppkey", "k")


@study(f"""WITH {_W}, {_C}, y AS (SELECT max(published_year) AS y FROM w), p AS (SELECT issn_print AS issn, count(*) AS n FROM w, y WHERE published_year BETWEEN y - 2 AND y - 1 AND issn_print IS NOT NULL GROUP BY 1),
q AS (SELECT b.issn_print AS issn, count(*) AS n FROM c JOIN w a ON a.id = c.work_id JOIN w b ON lower(trim(b.doi)) = c.doi, y WHERE a.published_year = y AND b.published_year BETWEEN y - 2 AND y - 1 AND b.issn_print IS NOT NULL GROUP BY 1)
SELECT p.issn, coalesce(q.n, 0)::BIGINT AS citations_number, p.n::BIGINT AS publications_number, round(coalesce(q.n, 0) / p.n, 6) AS impact_factor FROM p LEFT JOIN q USING (issn)""")
def impact_factor_chain(t):
    works = _works(t)
    dated = works.withColumn("y", works.agg(F.max("published_year").alias("y")).scalar())
    recent = dated.where(F.col("published_year").between(F.col("y") - 2, F.col("y") - 1) & F.col("issn_print").isNotNull()).select(F.col("issn_print").alias("issn"), F.lower(F.trim("doi")).alias("doi"))
    citing = dated.where("published_year = y").select(F.col("id").alias("work_id"))
    counts = metrics.citation_counts(_citations(t).join(citing, "work_id", "left_semi"))
    per = recent.join(counts, "doi", "left").groupBy("issn").agg(F.coalesce(F.sum("citations_number"), F.lit(0)).alias("citations_number"), F.count("*").alias("publications_number"))
    return per.withColumn("impact_factor", F.round(F.col("citations_number") / F.col("publications_number"), 6))


@study("""WITH i AS (SELECT id, issn_print AS issn, 1 AS p FROM journal_names UNION ALL SELECT id, issn_eprint, 2 FROM journal_names), r AS (SELECT *, row_number() OVER (PARTITION BY issn ORDER BY p, id) AS rn FROM i WHERE issn IS NOT NULL AND length(trim(issn)) > 7)
SELECT issn, id AS journal_id, p::INTEGER AS priority FROM r WHERE rn = 1""")
def prioritised_dedup(t):
    j = t("journal_names")
    i = j.select("id", F.col("issn_print").alias("issn"), F.lit(1).alias("p")).union(j.select("id", "issn_eprint", F.lit(2))).where("issn is not null and length(trim(issn)) > 7")
    best = i.groupBy("issn").agg(F.min(F.struct("p", "id")).alias("b"))
    return best.select("issn", F.col("b.id").alias("journal_id"), F.col("b.p").alias("priority"))


@study("""WITH h AS (SELECT o_orderkey, o_orderstatus, (o_orderkey * 2654435761) % 4294967296 AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS rn FROM h)
SELECT o_orderstatus, o_orderkey FROM r WHERE rn <= 10""")
def stratified_sample(t):
    """A repeatable random sample of ten rows a stratum: order by a hash."""
    h = t("orders").withColumn("h", (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296))
    return h.withColumn("rn", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("h", "o_orderkey"))).where("rn <= 10").select("o_orderstatus", "o_orderkey")


@study("""WITH a AS (SELECT published_year AS year, count(*) AS n FROM works GROUP BY 1), o AS (SELECT published_year AS year, count(*) AS n FROM works WHERE abstract IS NOT NULL GROUP BY 1)
SELECT a.year::INTEGER AS year, round(coalesce(o.n, 0) / a.n, 6) AS ratio FROM a LEFT JOIN o USING (year) WHERE year IS NOT NULL""")
def yearly_ratio(t):
    got = t("works").where("published_year is not null").groupBy(F.col("published_year").alias("year")).agg(F.count("abstract").alias("o"), F.count("*").alias("n"))
    return got.select("year", F.round(F.col("o") / F.col("n"), 6).alias("ratio"))


@study("""WITH a AS (SELECT article_id, substr(given, 1, 1) || '. ' || family AS name FROM pubmed_authors WHERE given IS NOT NULL AND family IS NOT NULL)
SELECT count(DISTINCT article_id)::BIGINT AS works, count(DISTINCT name)::BIGINT AS authors, round(count(DISTINCT article_id) / count(DISTINCT name), 6) AS ratio FROM a""")
def author_productivity(t):
    name = F.concat(F.substring("given", 1, 1), F.lit(". "), F.col("family"))
    got = t("pubmed_authors").select("article_id", name.alias("name")).where("name is not null").agg(F.countDistinct("article_id").alias("works"), F.countDistinct("name").alias("authors"))
    return got.withColumn("ratio", F.round(F.col("works") / F.col("authors"), 6))


@study("SELECT family, count(*)::BIGINT AS n FROM pubmed_authors WHERE family IS NOT NULL GROUP BY 1 ORDER BY n DESC, family LIMIT 20")
def common_surnames(t):
    return t("pubmed_authors").where("family is not null").groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(20)


# ---- scalar functions ----

_PREFIX = "coalesce(try_cast(nullif(regexp_extract({}, '^\\s*([+-]?[0-9]{{1,9}})', 1), '') AS INTEGER), 0)"


@study(f"""WITH p AS (SELECT published_year AS year, {_PREFIX.format("substr(page, instr(page, '-') + 1)")} - {_PREFIX.format("substr(page, 1, instr(page, '-') - 1)")} + 1 AS pages FROM works WHERE instr(page, '-') > 0)
SELECT year::INTEGER AS year, count(*)::BIGINT AS n, round(avg(pages), 4) AS pages FROM p WHERE pages BETWEEN 1 AND 1000 GROUP BY 1""")
def yearly_page_counts(t):
    p = t("works").select(F.col("published_year").alias("year"), text.page_count(F.col("page")).alias("pages")).where("pages between 1 and 1000")
    return p.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("pages"), 4).alias("pages"))


@study("SELECT ((published_year // 10) * 10)::INTEGER AS decade, count(*)::BIGINT AS n, round(avg(references_count), 4) AS refs FROM works WHERE published_year IS NOT NULL GROUP BY 1")
def integer_decade(t):
    decade = F.expr("cast(published_year div 10 as int) * 10")
    return t("works").where("published_year is not null").groupBy(decade.alias("decade")).agg(F.count("*").alias("n"), F.round(F.avg("references_count"), 4).alias("refs"))


@study("SELECT lower(substr(doi, 1, instr(doi, '/') - 1)) AS prefix, count(*)::BIGINT AS n, max(length(trim(doi)))::INTEGER AS longest FROM works WHERE instr(doi, '/') > 0 GROUP BY 1")
def doi_prefixes(t):
    w = t("works").where(F.instr("doi", "/") > 0)
    return w.groupBy(F.lower(F.expr("substr(doi, 1, instr(doi, '/') - 1)")).alias("prefix")).agg(F.count("*").alias("n"), F.max(F.length(F.trim("doi"))).alias("longest"))


@study("""SELECT p_partkey, replace(upper(trim(p_name)), ' ', '_') AS name, CASE WHEN p_size >= 25 THEN round(p_retailprice, 1) END AS price, '<a href="/part/' || p_partkey || '">' || p_brand || '</a>' AS link, abs(p_size - 25)::INTEGER AS off FROM part""")
def string_functions(t):
    link = F.concat(F.lit('<a href="/part/'), F.col("p_partkey").cast("string"), F.lit('">'), F.col("p_brand"), F.lit("</a>"))
    return t("part").select("p_partkey", F.replace(F.upper(F.trim("p_name")), F.lit(" "), F.lit("_")).alias("name"), F.when(F.col("p_size") >= 25, F.round("p_retailprice", 1)).alias("price"), link.alias("link"), F.abs(F.col("p_size") - 25).alias("off"))


@study("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_field_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@study("SELECT DISTINCT id AS journal_id, trim(v) AS issn FROM (SELECT id, unnest(string_split(issns_additional, ';')) AS v FROM journal_names) WHERE trim(v) <> ''")
def split_explode_list(t):
    values = F.transform(F.split("issns_additional", ";"), lambda x: F.trim(x))
    return t("journal_names").select(F.col("id").alias("journal_id"), F.explode(values).alias("issn")).where("issn <> ''").distinct()


@study("""SELECT vec_id, ((vec_id << 14) | i)::BIGINT AS id, i::INTEGER AS position, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""")
def nested_unnest_ids(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("position", "v")).select("vec_id", F.shiftleft("vec_id", 14).bitwiseOR(F.col("position").cast("bigint")).alias("id"), "position", "v")


@study("""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM documents), w AS (SELECT doc_id, i, unnest(string_split(s, ' ')) AS w FROM s)
SELECT doc_id, max(i)::INTEGER AS last_sentence, count(*)::BIGINT AS words FROM w WHERE w <> '' GROUP BY 1""")
def grandchild_unnest(t):
    s = t("documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    return s.select("doc_id", "i", F.explode(F.split("s", " ")).alias("w")).where("w <> ''").groupBy("doc_id").agg(F.max("i").alias("last_sentence"), F.count("*").alias("words"))


@study(r"""WITH a AS (SELECT doc_id, regexp_extract(text, '(?i)((doi: *)|(doi\.org/))([^,; )>]+)', 4) AS x FROM documents WHERE text ILIKE '%DOI:%' OR text ILIKE '%doi.org/%'),
b AS (SELECT doc_id, lower(regexp_replace(coalesce(nullif(regexp_extract(x, '(?i)((doi: *)|(doi\.org/))([^,; )>]+)', 4), ''), x), '\.$', '')) AS doi FROM a) SELECT doc_id, doi FROM b WHERE regexp_matches(doi, '^10\.[0-9]{4,9}/..')""")
def doi_extract(t):
    hinted = t("documents").where(F.col("text").ilike("%DOI:%") | F.col("text").ilike("%doi.org/%"))
    return hinted.select("doc_id", text.doi_in_text(F.col("text")).alias("doi")).where("doi is not null")


# ---- selection by hierarchy, containers, samples ----


@study("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def populate_root_condition(t):
    """All child rows of the roots a condition on the root selects."""
    return t("lineitem").join(t("orders").where("o_orderstatus = 'F' and o_totalprice > 200000"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@study("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount = 0.1 AND o_orderpriority LIKE '1%')")
def populate_detail_condition(t):
    """All child rows of the roots a condition on root and children selects."""
    o, l = t("orders"), t("lineitem")
    roots = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).where("l_discount = 0.1 and o_orderpriority like '1%'").select(F.col("o_orderkey").alias("k")).distinct()
    return l.join(roots, F.col("l_orderkey") == F.col("k"), "left_semi").select("l_orderkey", "l_linenumber", "l_returnflag")


@study("SELECT container_id, type, count(*)::BIGINT AS n FROM works GROUP BY ALL")
def partitioned_query(t):
    """A query on each container, its results put together: the container joins the grouping."""
    return t("works").groupBy("container_id", "type").agg(F.count("*").alias("n"))


@study("SELECT container_id, count(*)::BIGINT AS n FROM works WHERE container_id IN (SELECT container_id FROM (SELECT DISTINCT container_id FROM works) ORDER BY (container_id * 2654435761) % 4294967296 LIMIT 3) GROUP BY 1")
def container_sample(t):
    """Whole containers, chosen by a hash: the sampling operator."""
    ids = t("works").select("container_id").distinct().orderBy((F.col("container_id") * F.lit(2654435761)) % F.lit(4294967296)).limit(3)
    return t("works").join(F.broadcast(ids), "container_id", "left_semi").groupBy("container_id").agg(F.count("*").alias("n"))


# ---- linking and normalisation ----


@study("SELECT min(id) AS id, name FROM (SELECT DISTINCT id, name FROM research_organizations WHERE coalesce(status, '') <> 'withdrawn' AND name IS NOT NULL) GROUP BY name HAVING count(*) = 1")
def unique_names(t):
    named = t("research_organizations").where("coalesce(status, '') <> 'withdrawn' and name is not null").select("id", "name").distinct()
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id", "name")


@study("""WITH n AS (SELECT name AS word, min(id) AS ror_id FROM (SELECT DISTINCT id, name, status FROM research_organizations WHERE coalesce(status, '') <> 'withdrawn' AND name IS NOT NULL) GROUP BY name HAVING count(*) = 1),
inside AS (SELECT DISTINCT a.word FROM n a JOIN n b ON a.word <> b.word AND contains(b.word, a.word)), kept AS (SELECT * FROM n WHERE word <> '' AND word NOT IN (SELECT word FROM inside)),
f AS (SELECT DISTINCT id, affiliation FROM pubmed_author_affiliations WHERE affiliation IS NOT NULL)
SELECT DISTINCT arg_min(ror_id, (-length(word), strpos(affiliation, word))) AS ror_id, id AS work_author_id FROM f JOIN kept ON contains(affiliation, word) GROUP BY id, affiliation""")
def dictionary_longest_match(t):
    """The organisation of the longest unique name in each affiliation."""
    orgs = t("research_organizations").select("id", "name", "status").distinct()
    none = orgs.sparkSession.createDataFrame([], "ror_id bigint, alias string, acronym string")
    words = linking.name_dictionary(orgs, none, none)
    got = linking.link_affiliations(t("pubmed_author_affiliations"), words, "id", "affiliation")
    return got.distinct()


@study("""WITH j AS (SELECT id, replace(issn_print, '-', '') AS p, replace(issn_eprint, '-', '') AS e, replace(issns_additional, '-', '') AS a FROM journal_names)
SELECT id AS journal_id, issn, issn_type FROM (SELECT id, unnest(string_split(a, '; ')) AS issn, 'A' AS issn_type FROM j UNION ALL SELECT id, p, 'P' FROM j UNION ALL SELECT id, e, 'E' FROM j) WHERE issn IS NOT NULL AND issn <> ''""")
def journals_issns(t):
    return normalize.journals_issns(normalize.plain_journal_issns(t("journal_names")))


@study("SELECT p_partkey, CASE WHEN p_type ILIKE '%steel' THEN 1 WHEN p_type ILIKE '%tin' THEN 0 END AS steel, nullif(replace(p_brand, 'Brand#', ''), '') AS brand FROM part")
def yes_no_columns(t):
    steel = F.when(F.col("p_type").ilike("%steel"), 1).when(F.col("p_type").ilike("%tin"), 0)
    return t("part").select("p_partkey", steel.alias("steel"), F.nullif(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("")).alias("brand"))


@study("""WITH c AS (SELECT p_partkey AS code, p_name AS field, p_brand AS area FROM part), a AS (SELECT area, row_number() OVER (ORDER BY area) AS id FROM (SELECT DISTINCT area FROM c))
SELECT code AS id, field, a.id::INTEGER AS subject_area_id, ((code // 100) * 100)::INTEGER AS general_field_id FROM c JOIN a USING (area)""")
def subject_codes(t):
    return normalize.asjc_tables(t("part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("field"), F.col("p_brand").alias("subject_area")))["asjcs"]


# ---- chains and reports on citations ----


@study(f"""WITH {_W}, {_C}, r AS (SELECT work_id, count(*) AS k FROM c GROUP BY 1) SELECT published_year::INTEGER AS year, count(*)::BIGINT AS works, round(avg(k), 4) AS refs FROM w JOIN r ON r.work_id = w.id WHERE published_year IS NOT NULL GROUP BY 1""")
def references_per_paper(t):
    r = _citations(t).groupBy("work_id").agg(F.count("*").alias("k"))
    w = _works(t).where("published_year is not null").select(F.col("id").alias("work_id"), F.col("published_year").alias("year"))
    return w.join(r, "work_id").groupBy("year").agg(F.count("*").alias("works"), F.round(F.avg("k"), 4).alias("refs"))


@study(f"""WITH {_W}, {_C}, d AS (SELECT published_year AS year, lower(trim(doi)) AS doi FROM w WHERE published_year IS NOT NULL AND doi IS NOT NULL), k AS (SELECT DISTINCT doi FROM c)
SELECT year::INTEGER AS year, round(avg(CASE WHEN k.doi IS NULL THEN 0 ELSE 1 END), 6) AS cited FROM d LEFT JOIN k USING (doi) GROUP BY 1""")
def proportion_of_cited_works(t):
    d = _works(t).where("published_year is not null and doi is not null").select(F.col("published_year").alias("year"), F.lower(F.trim("doi")).alias("doi"))
    k = _citations(t).select("doi").distinct().withColumn("hit", F.lit(1))
    return d.join(k, "doi", "left").groupBy("year").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("cited"))


@study(f"WITH {_C} SELECT doi, count(*)::BIGINT AS citations_number FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def most_cited(t):
    return metrics.citation_counts(_citations(t)).orderBy(F.desc("citations_number"), "doi").limit(50)


@study(f"""WITH {_W}, {_C}, n AS (SELECT doi, count(*) AS k FROM c GROUP BY 1), s AS (SELECT CASE WHEN title ILIKE '%study%' THEN 1 ELSE 0 END AS g, coalesce(k, 0) AS v FROM w LEFT JOIN n ON n.doi = lower(trim(w.doi)) WHERE title IS NOT NULL),
m AS (SELECT count(*) FILTER (g = 0) AS n_0, avg(v) FILTER (g = 0) AS m0, median(v) FILTER (g = 0) AS median_0, count(*) FILTER (g = 1) AS n_1, avg(v) FILTER (g = 1) AS m1, median(v) FILTER (g = 1) AS median_1, var_pop(v) FILTER (g = 0) AS v0, var_pop(v) FILTER (g = 1) AS v1 FROM s),
k AS (SELECT v, count(*) FILTER (g = 0) AS c0, count(*) FILTER (g = 1) AS c1 FROM s GROUP BY v), o AS (SELECT sum(c1 * below) AS more, sum(c1 * above) AS less FROM (SELECT *, coalesce(sum(c0) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(c0) OVER (ORDER BY v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above FROM k))
SELECT n_0::BIGINT AS n_0, n_1::BIGINT AS n_1, median_0::DOUBLE AS median_0, median_1::DOUBLE AS median_1, round((m1 - m0) / sqrt((v0 + v1) / 2), 6) AS cohens_d, round((more - less) / (n_0 * n_1), 6) AS cliffs_delta FROM m, o""")
def effect_size(t):
    n = metrics.citation_counts(_citations(t))
    w = _works(t).where("title is not null").select(F.lower(F.trim("doi")).alias("doi"), F.when(F.col("title").ilike("%study%"), 1).otherwise(0).alias("g"))
    s = w.join(n, "doi", "left").select("g", F.coalesce("citations_number", F.lit(0)).alias("v"))
    got = metrics.effect_size(s, "g", "v")
    return got.select("n_0", "n_1", F.col("median_0").cast("double").alias("median_0"), F.col("median_1").cast("double").alias("median_1"), F.round("cohens_d", 6).alias("cohens_d"), F.round("cliffs_delta", 6).alias("cliffs_delta"))


_E = """n AS (SELECT lower(trim(doi)) AS doi, min(id) AS id, min(coalesce(try_cast(printf('%d-%d-%d', published_year, coalesce(published_month, 1), coalesce(published_day, 1)) AS DATE), make_date(published_year, 1, 1))) AS day FROM w WHERE doi IS NOT NULL AND published_year BETWEEN 1945 AND 2023 GROUP BY 1),
e AS (SELECT DISTINCT a.id AS citing, b.id AS cited FROM c JOIN n a ON a.id = c.work_id JOIN n b ON b.doi = c.doi WHERE a.id <> b.id)"""


def _graph(t):
    """(id, day), (citing, cited) of the works of 1945 to 2023; days count from 1900, a missing month or day is the first."""
    w = _works(t).where("doi is not null and published_year between 1945 and 2023")
    one = F.lit(1)
    whole = F.concat_ws("-", "published_year", F.coalesce("published_month", one), F.coalesce("published_day", one)).try_cast("date")
    day = F.coalesce(whole, F.make_date("published_year", one, one))
    nodes = w.groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.min("id").alias("id"), F.datediff(F.min(day), F.lit("1900-01-01")).alias("day"))
    c = _citations(t).join(nodes.select(F.col("id").alias("work_id")), "work_id", "left_semi").join(nodes.select("doi", F.col("id").alias("cited")), "doi")
    return nodes.select("id", "day"), c.select(F.col("work_id").alias("citing"), "cited").where("citing <> cited").distinct()


@study(f"""WITH {_W}, {_C}, {_E}, d AS (SELECT f.id, e.citing AS later, 1 AS f, 0 AS b FROM n f JOIN e ON e.cited = f.id JOIN n l ON l.id = e.citing WHERE date_diff('day', f.day, l.day) BETWEEN 1 AND 1825 AND f.id IN (SELECT citing FROM e)
UNION ALL SELECT f.id, x.citing, 0, 1 FROM n f JOIN e r ON r.citing = f.id JOIN e x ON x.cited = r.cited JOIN n l ON l.id = x.citing WHERE date_diff('day', f.day, l.day) BETWEEN 1 AND 1825),
s AS (SELECT id, later, max(f) AS f, max(b) AS b FROM d WHERE id IN (SELECT id FROM n WHERE day <= DATE '2018-12-31') GROUP BY ALL) SELECT id, round(avg(f - 2 * f * b), 6) AS cd, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def disruption_index(t):
    works, edges = _graph(t)
    until = (date(2018, 12, 31) - date(1900, 1, 1)).days
    return metrics.disruption(works, edges, until=until).select("id", F.round("cd", 6).alias("cd"), "n")


def _journal_edges(t, years: int):
    """Cites between journals (by print ISSN) of works at most ``years`` old, counted before the cited works are met."""
    w = _works(t).where("issn_print is not null and published_year is not null")
    citing = _citations(t).join(w.select(F.col("id").alias("work_id"), F.col("issn_print").alias("citing"), F.col("published_year").alias("year")), "work_id").groupBy("doi", "citing", "year").agg(F.count("*").alias("k"))
    cited = w.select(F.lower(F.trim("doi")).alias("doi"), F.col("issn_print").alias("cited"), F.col("published_year").alias("cited_year"))
    return citing.join(cited, "doi").where((F.col("year") - F.col("cited_year")).between(1, years)).groupBy("citing", "cited").agg(F.sum("k").alias("n"))


def _articles(t):
    return _works(t).where("issn_print is not null").groupBy(F.col("issn_print").alias("journal")).agg(F.count("*").alias("n"))


def _net(years: int) -> str:
    return f"""{_W}, {_C}, j AS (SELECT a.issn_print AS citing, b.issn_print AS cited, count(*) AS n FROM c JOIN w a ON a.id = c.work_id JOIN w b ON lower(trim(b.doi)) = c.doi
    WHERE a.issn_print IS NOT NULL AND b.issn_print IS NOT NULL AND a.published_year - b.published_year BETWEEN 1 AND {years} GROUP BY ALL),
    art AS (SELECT issn_print AS journal, count(*) AS n FROM w WHERE issn_print IS NOT NULL GROUP BY 1)"""


#: Rounds of the power iteration in the registered queries, so that SQL can state the same; by default it runs to convergence.
ROUNDS = 20


def _power(edges: str) -> str:
    """SQL for ``ROUNDS`` rounds of the power iteration over a table of (citing, cited, n); gives score(journal, score)."""
    steps = [
        f"outs AS (SELECT citing, sum(n) AS o FROM {edges} WHERE citing <> cited GROUP BY 1)", f"h AS (SELECT e.citing, e.cited, e.n / o AS h FROM {edges} e JOIN outs USING (citing) WHERE e.citing <> e.cited)",
        "s0 AS (SELECT journal, n / (SELECT sum(n) FROM art) AS a, journal IN (SELECT citing FROM outs) AS cites, 1 / (SELECT count(*) FROM art) AS p FROM art)",
    ]
    for k in range(ROUNDS):
        steps.append(f"g{k} AS (SELECT cited AS journal, sum(h * p) AS g FROM h JOIN s{k} ON s{k}.journal = h.citing GROUP BY 1)")
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT journal, a, cites, 0.85 * coalesce(g, 0) + (0.85 * coalesce((SELECT sum(p) FROM s{k} WHERE NOT cites), 0) + 0.15) * a AS p FROM s{k} LEFT JOIN g{k} USING (journal))")
    steps.append(f"f AS (SELECT cited AS journal, sum(h * p) AS g FROM h JOIN s{ROUNDS} s ON s.journal = h.citing GROUP BY 1), score AS (SELECT journal, 100 * g / (SELECT sum(g) FROM f) AS score FROM f)")
    return ", ".join(steps)


@study(f"WITH {_net(5)}, {_power('j')} SELECT journal, round(score, 6) AS score FROM score")
def journal_centrality(t):
    got = metrics.centrality(_journal_edges(t, 5), _articles(t), fixed=ROUNDS)
    return got.select("journal", F.round("score", 6).alias("score"))


@study(f"""WITH {_net(3)}, got AS (SELECT cited, sum(n) AS total FROM j GROUP BY 1), capped AS (SELECT citing, cited, CASE WHEN citing = cited THEN least(n::DOUBLE, 0.33 * total) ELSE n::DOUBLE END AS n FROM j JOIN got USING (cited)),
{_power('capped')}, per AS (SELECT journal, score / n AS per FROM score JOIN art USING (journal)) SELECT journal, round(per / (SELECT avg(per) FROM per WHERE per > 0), 6) AS score FROM per""")
def journal_prestige(t):
    edges = metrics.capped_self_citations(_journal_edges(t, 3))
    got = metrics.centrality(edges, _articles(t), fixed=ROUNDS).join(_articles(t), "journal").withColumn("per", F.col("score") / F.col("n"))
    return metrics.over_mean(got, "per").select("journal", F.round("score", 6).alias("score"))


@study(f"""WITH {_net(5)}, e AS (SELECT cited AS journal, sum(n) AS c FROM j WHERE citing <> cited GROUP BY 1), p AS (SELECT journal, c / n AS per FROM e JOIN art USING (journal))
SELECT journal, round(per / (SELECT avg(per) FROM p WHERE per > 0), 6) AS score FROM p""")
def mean_article_score(t):
    return metrics.mean_article_score(_journal_edges(t, 5), _articles(t)).select("journal", F.round("score", 6).alias("score"))


@study()
def coupling_communities(t):
    """Journals by label propagation over their coupling; exact parity with other methods of detection isn't claimed."""
    edges = metrics.coupling(t("lineitem"), "l_suppkey", "l_partkey", 5).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), F.col("coupling_strength").alias("w"))
    return metrics.communities(edges)


@study()
def context_normalised_impact(t):
    edges = metrics.coupling(t("lineitem"), "l_suppkey", "l_partkey", 5).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), F.col("coupling_strength").alias("w"))
    journals = t("lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("citations"), F.countDistinct("l_orderkey").alias("publications"), F.avg("l_quantity").alias("density"))
    members = metrics.soft_communities(edges, metrics.communities(edges), journals.select("node"))
    return metrics.context_impact(members, journals)


@study("""WITH j AS (SELECT l_suppkey AS node, count(*) AS c, count(DISTINCT l_orderkey) AS p, CASE WHEN l_suppkey % 5 > 0 THEN avg(l_quantity) END AS density FROM lineitem GROUP BY 1)
SELECT node, round(c / p / coalesce(density, (SELECT median(density) FROM j)), 3) AS impact FROM j""")
def context_impact_alone(t):
    """Without communities a journal's own density is its potential; missing ones are filled with the median."""
    density = F.when(F.col("l_suppkey") % 5 > 0, F.avg("l_quantity"))
    journals = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("citations"), F.countDistinct("l_orderkey").alias("publications"), density.alias("density"))
    return metrics.context_impact(None, journals.withColumnRenamed("l_suppkey", "node"))


@study()
def citations_normality(t):
    """Shapiro-Wilk test over the citation counts of all works; tested against published values."""
    n = metrics.citation_counts(_citations(t))
    counted = _works(t).select(F.lower(F.trim("doi")).alias("doi")).join(n, "doi", "left")
    return metrics.shapiro(counted.select(F.coalesce("citations_number", F.lit(0)).alias("v")), "v")


_G = "g AS (SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b FROM e)"


@study(f"""WITH {_W}, {_C}, {_E}, {_G}, d AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY 1), t AS (SELECT x.a, x.b, y.b AS c FROM g x JOIN g y ON y.a = x.b JOIN g z ON z.a = x.a AND z.b = y.b),
k AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1) SELECT d.node, k::BIGINT AS degree, CASE WHEN k > 1 THEN round(2 * coalesce(t, 0) / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS clustering FROM d LEFT JOIN k ON k.node = d.node""")
def citation_graph_clustering(t):
    _, edges = _graph(t)
    g = edges.select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b")).distinct()
    return metrics.ego_clustering(g).select("node", "degree", F.round("clustering", 6).alias("clustering"))


@study(f"""WITH {_W}, {_C}, {_E}, {_G}, b AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), s AS (SELECT id FROM n WHERE id IN (SELECT x FROM b) ORDER BY (id * 2654435761) % 4294967296 LIMIT 20),
r AS (SELECT id AS seed, id AS node, 0 AS d FROM s UNION ALL SELECT s.id, y, 1 FROM s JOIN b ON x = s.id UNION ALL SELECT s.id, b2.y, 2 FROM s JOIN b b1 ON b1.x = s.id JOIN b b2 ON b2.x = b1.y)
SELECT seed, node, min(d)::INTEGER AS distance FROM r GROUP BY ALL""")
def ego_graphs(t):
    """Citation graphs within two steps of a repeatable sample of 20 works: the sampling operator."""
    _, edges = _graph(t)
    g = cut(edges.select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b")).distinct())
    known = g.select(F.explode(F.array("a", "b")).alias("seed")).distinct()
    return metrics.neighbourhood(g, known.orderBy((F.col("seed") * F.lit(2654435761)) % F.lit(4294967296)).limit(20))


_TOOLS = ["stratified sampling", "optical profiling", "record linkage", "gradient elution"]


_PHRASES = {x: r"(?i)(^|[^\p{L}\p{N}])" + x.replace(" ", r"[^\p{L}\p{N}]+") + r"([^\p{L}\p{N}]|$)" for x in _TOOLS}


@study("SELECT published_year::INTEGER AS year, tool, round(100 * avg(CASE WHEN regexp_matches(text, pattern) THEN 1 ELSE 0 END), 1) AS share FROM documents, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _PHRASES.items()) + ") p(tool, pattern) WHERE text IS NOT NULL AND published_year IS NOT NULL GROUP BY ALL")
def mention_share(t):
    """Share of texts of a year that mention each phrase as whole words: all phrases in one pass."""
    hits = [F.avg(text.mentions(F.col("text"), x).cast("int")).alias(x) for x in _TOOLS]
    got = t("documents").where("text is not null and published_year is not null").groupBy(F.col("published_year").alias("year")).agg(*hits)
    return got.unpivot(["year"], _TOOLS, "tool", "s").select("year", "tool", F.round(100 * F.col("s"), 1).alias("share"))


@study(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_PHRASES[_TOOLS[0]]}') OR regexp_matches(text, '{_PHRASES[_TOOLS[2]]}')")
def phrase_search(t):
    """Full-text search for one phrase or another."""
    return t("documents").where(text.mentions(F.col("text"), _TOOLS[0], _TOOLS[2])).select("doc_id")


@study("""SELECT * FROM (SELECT year(o_orderdate)::INTEGER AS year, c_nationkey, count(*)::BIGINT AS orders, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY count(*) DESC, c_nationkey)::INTEGER AS place
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY year(o_orderdate), c_nationkey) WHERE place <= 5""")
def ranked_groups_per_year(t):
    """row_number over an aggregate: the five nations of most orders a year."""
    counted = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("year"), "c_nationkey").agg(F.count("*").alias("orders"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("orders"), "c_nationkey"))
    return counted.withColumn("place", place).where("place <= 5")


@study("""SELECT year(o_orderdate)::INTEGER AS year, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS "F", coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS "O", coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY 1""".replace("coalesce(sum", "round(coalesce(sum").replace(", 0) AS", ", 0), 2) AS"))
def pivot_year_status(t):
    got = t("orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return got.select("year", *(F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("F", "O", "P")))


@study("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_events(t):
    got = t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")
