"""Scientometric operators over works and references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators.ranking import global_row_number
from scholion.session import cut


def deduplicated_works(works: DataFrame) -> DataFrame:
    """One row a work id: its latest delivery that is no removal notice."""
    row = F.struct("indexed_at", "doi", "published_year", "title", "issn_print", "issn_electronic", "page", "type", "publisher", "published_month", "published_day")
    return works.where("deleted_at is null").groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*")


def citations(references: DataFrame) -> DataFrame:
    """Distinct (work_id, doi) pairs with a DOI."""
    return references.where("doi is not null and trim(doi) <> ''").select("work_id", F.lower(F.trim("doi")).alias("doi")).distinct()


def citation_counts(references: DataFrame) -> DataFrame:
    """doi, citations_number; counted before any join, so that a hot DOI is one row a partition."""
    return references.groupBy("doi").agg(F.count("*").alias("citations_number"))


def windowed_citations(works: DataFrame, references: DataFrame, years: int) -> DataFrame:
    """year, citations_number: citations made in a year to works of the ``years`` years before it.

    References are first counted by (doi, citing year), which leaves at most one row a cited work and year to
    meet the cited works, however hot a DOI is.
    """
    citing = references.join(works.select(F.col("id").alias("work_id"), F.col("published_year").alias("year")), "work_id").where("year is not null")
    counted = citing.groupBy("doi", "year").agg(F.count("*").alias("n"))
    cited = works.where("doi is not null and published_year is not null").select(F.lower(F.trim("doi")).alias("doi"), F.col("published_year").alias("cited_year"))
    age = F.col("year") - F.col("cited_year")
    return counted.join(cited, "doi").where(age.between(1, years)).groupBy("year").agg(F.sum("n").alias("citations_number"))


def h_index(scores: DataFrame, group: str, score: str) -> DataFrame:
    """group, h_index: the largest h such that h items of the group have a score of at least h.

    Only scores count, so items are first grouped by (group, score): a window then runs over the distinct scores of
    a group, not its items.
    """
    by_score = scores.where(F.col(group).isNotNull() & (F.col(score) > 0)).groupBy(group, score).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(group).orderBy(F.desc(score)))
    return by_score.withColumn("above", above).groupBy(group).agg(F.max(F.least("above", F.col(score))).cast("int").alias("h_index"))


def h_median(scores: DataFrame, group: str, score: str) -> DataFrame:
    """group, h_index, h_median: with the median score of the h best items."""
    h = h_index(scores, group, score)
    by_score = scores.where(F.col(group).isNotNull() & (F.col(score) > 0)).groupBy(group, score).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = by_score.withColumn("before", before).join(h, group).where("before < h_index").withColumn("last", F.least(F.col("before") + F.col("n"), F.col("h_index")))
    low, high = F.floor((F.col("h_index") + 1) / 2), F.floor((F.col("h_index") + 2) / 2)
    at = lambda k: F.max(F.when((k > F.col("before")) & (k <= F.col("last")), F.col(score)))
    return core.groupBy(group, "h_index").agg(((at(low) + at(high)) / 2).alias("h_median"))


def streaks(rows: DataFrame, group: str, at: str, least: int) -> DataFrame:
    """group, start, streak: runs of consecutive numbers of at least ``least`` (gaps and islands)."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(group).orderBy(at))
    runs = rows.select(group, at).distinct().withColumn("island", island).groupBy(group, "island")
    return runs.agg(F.min(at).alias("start"), F.count("*").alias("streak")).where(F.col("streak") >= least).drop("island")


def coupling(citing: DataFrame, unit: str, reference: str, shared: int) -> DataFrame:
    """unit_a < unit_b and the number of references both cite, for pairs that share at least ``shared``.

    ``citing`` has (unit, reference) pairs. References of one unit make no pair and are dropped first. A reference that
    very many units cite makes quadratically many pairs, which is the measure's definition.
    """
    pairs = citing.select(unit, reference).where(F.col(unit).isNotNull() & F.col(reference).isNotNull()).distinct()
    several = pairs.groupBy(reference).agg(F.count("*").alias("k")).where("k > 1").select(reference)
    kept = pairs.join(several, reference, "left_semi")
    a, b = kept.withColumnRenamed(unit, "unit_a"), kept.withColumnRenamed(unit, "unit_b")
    return a.join(b, reference).where("unit_a < unit_b").groupBy("unit_a", "unit_b").agg(F.count("*").alias("coupling_strength")).where(F.col("coupling_strength") >= shared)


def disruption(works: DataFrame, edges: DataFrame, days: int = 5 * 365, hot: int = 1000, until: int | None = None) -> DataFrame:
    """id, cd, n: the CD index of works that cite something, within ``days`` after each; of works up to the day ``until`` where it is given.

    works(id, day), edges(citing, cited) with distinct pairs between known works. A later work counts once for a
    focal work: -2*f*b + f, with f = cites the focal work, b = cites one of its references (Funk and Owen-Smith 2017).

    Later works reached by a reference of at most ``hot`` cites are joined one by one. All works that cite the same
    hot references on the same day stand alike to a focal work, so they are counted by (hot references, day) and
    never paired: a reference that a tenth of all works cite costs no quadratic join. A work with one hot reference takes the
    difference of two running sums over its days. The result is the same.
    """
    day = works.select(F.col("id").alias("citing"), F.col("day").alias("citing_day"))
    popular = edges.groupBy("cited").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("cited")
    hot_sets = cut(edges.join(popular, "cited", "left_semi").groupBy("citing").agg(F.array_sort(F.collect_set("cited")).alias("hot")))
    on = edges.join(day, "citing").join(hot_sets, "citing", "left")
    early = works if until is None else works.where(F.col("day") <= until)
    focal = early.join(edges.select(F.col("citing").alias("id")).distinct(), "id", "left_semi").join(hot_sets.select(F.col("citing").alias("id"), F.col("hot").alias("own_hot")), "id", "left")
    within = (F.col("citing_day") > F.col("day")) & (F.col("citing_day") <= F.col("day") + days)
    meets_hot = F.coalesce(F.arrays_overlap("hot", "own_hot"), F.lit(False)).alias("h")
    direct = on.select(F.col("cited").alias("id"), F.col("citing").alias("later"), "citing_day", "hot").join(focal, "id").where(within).select("id", "later", meets_hot, F.lit(1).alias("f"), F.lit(0).alias("b"))
    cold = edges.join(popular, "cited", "left_anti")
    refs = cold.select(F.col("citing").alias("id"), F.col("cited").alias("reference")).join(focal, "id")
    cited_by = on.join(popular, "cited", "left_anti").select(F.col("cited").alias("reference"), F.col("citing").alias("later"), "citing_day", "hot")
    through = refs.join(cited_by, "reference").where(within).select("id", "later", meets_hot, F.lit(0).alias("f"), F.lit(1).alias("b"))
    seen = direct.unionByName(through).groupBy("id", "later").agg(F.max("f").alias("f"), F.max("b").alias("b"), F.max("h").alias("h"))
    b = F.greatest("b", F.col("h").cast("int"))
    paired = seen.groupBy("id").agg(F.sum(F.col("f") * (1 - 2 * b)).alias("total"), F.count_if(~F.col("h")).alias("n_cold"))

    dated = hot_sets.join(day, "citing").groupBy("hot", "citing_day").agg(F.count("*").alias("k"))
    kinds = focal.where("own_hot is not null").select("own_hot", "day").distinct()
    several = kinds.where(F.size("own_hot") > 1)
    met = several.select("own_hot", "day", F.explode("own_hot").alias("reference")).join(dated.select("hot", "citing_day", "k", F.explode("hot").alias("reference")), "reference").where(within)
    through_several = met.select("own_hot", "day", "hot", "citing_day", "k").distinct().groupBy("own_hot", "day").agg(F.sum("k").alias("n_hot"))
    # of one hot reference the citing works are counted by day, and a span of days is the difference of two running sums
    single = kinds.where(F.size("own_hot") == 1).select("own_hot", "day", F.element_at("own_hot", 1).alias("reference"))
    points = single.select("reference", F.explode(F.array("day", F.col("day") + days)).alias("at"), F.lit(0).cast("bigint").alias("k"))
    daily = dated.select(F.explode("hot").alias("reference"), F.col("citing_day").alias("at"), "k").unionByName(points).groupBy("reference", "at").agg(F.sum("k").alias("k"))
    running = daily.select("reference", "at", F.sum("k").over(Window.partitionBy("reference").orderBy("at")).alias("total"))
    until_day, until_end = (running.select("reference", F.col("at").alias(at), F.col("total").alias(total)) for at, total in (("day", "before"), ("end", "by_end")))
    through_single = single.withColumn("end", F.col("day") + days).join(until_day, ["reference", "day"]).join(until_end, ["reference", "end"]).select("own_hot", "day", (F.col("by_end") - F.col("before")).alias("n_hot")).where("n_hot > 0")
    through_hot = through_several.unionByName(through_single)
    hot_counts = focal.join(through_hot, ["own_hot", "day"]).select("id", "n_hot")
    both = paired.join(hot_counts, "id", "full").select("id", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("n_cold", F.lit(0)) + F.coalesce("n_hot", F.lit(0))).alias("n"))
    return both.select("id", (F.col("total") / F.col("n")).alias("cd"), "n")


def centrality(edges: DataFrame, articles: DataFrame, alpha: float = 0.85, epsilon: float = 1e-6, rounds: int = 1000, fixed: int | None = None) -> DataFrame:
    """journal, score: influence by power iteration over cites between journals, as a share of 100.

    edges(citing, cited, n) without self-cites after the first step, articles(journal, n). Shares of a citing
    journal sum to 1; a journal that cites none gives its weight to all in proportion to their articles. ``fixed`` runs
    that many rounds instead of stopping at an L1 change under ``epsilon``.
    """
    total = articles.agg(F.sum("n").alias("all")).scalar()
    weight = cut(articles.select("journal", (F.col("n") / total).alias("a")))
    out = edges.where("citing <> cited").groupBy("citing").agg(F.sum("n").alias("out"))
    shares = cut(edges.where("citing <> cited").join(out, "citing").select("citing", "cited", (F.col("n") / F.col("out")).alias("h")))
    nodes = weight.join(out.select(F.col("citing").alias("journal"), F.lit(True).alias("cites")), "journal", "left").withColumn("p", F.lit(1.0) / F.lit(max(1, weight.count())))
    state = cut(nodes)
    for k in range(fixed if fixed is not None else rounds):
        dangling = state.where("cites is null").agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]
        gained = shares.join(state.select(F.col("journal").alias("citing"), "p"), "citing").groupBy(F.col("cited").alias("journal")).agg(F.sum(F.col("h") * F.col("p")).alias("g"))
        new = state.join(gained, "journal", "left").withColumn("q", alpha * F.coalesce("g", F.lit(0.0)) + F.lit(alpha * dangling + 1 - alpha) * F.col("a"))
        new = cut(new)
        moved = new.agg(F.sum(F.abs(F.col("q") - F.col("p")))).first()[0] or 0.0
        state = new.select("journal", "a", "cites", F.col("q").alias("p"))
        if fixed is None and moved < epsilon:
            break
    final = shares.join(state.select(F.col("journal").alias("citing"), "p"), "citing").groupBy(F.col("cited").alias("journal")).agg(F.sum(F.col("h") * F.col("p")).alias("g"))
    final = cut(final)
    return final.select("journal", (100 * F.col("g") / final.agg(F.sum("g").alias("s")).scalar()).alias("score"))


def capped_self_citations(edges: DataFrame, share: float = 0.33) -> DataFrame:
    """Edges in which a journal's cites of itself are at most ``share`` of all it receives."""
    received = edges.groupBy("cited").agg(F.sum("n").alias("all"))
    own = F.col("citing") == F.col("cited")
    return edges.join(received, "cited").select("citing", "cited", F.when(own, F.least(F.col("n").cast("double"), share * F.col("all"))).otherwise(F.col("n").cast("double")).alias("n"))


def mean_article_score(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """journal, score: cites from other journals per article, over the mean of the positive ones."""
    got = edges.where("citing <> cited").groupBy(F.col("cited").alias("journal")).agg(F.sum("n").alias("c")).join(articles, "journal").select("journal", (F.col("c") / F.col("n")).alias("per"))
    return over_mean(got, "per")


def over_mean(scores: DataFrame, value: str) -> DataFrame:
    """journal, score: a value over the mean of its positive values."""
    mean = scores.where(F.col(value) > 0).agg(F.avg(value).alias("m")).scalar()
    return scores.select("journal", (F.col(value) / mean).alias("score"))


def communities(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, community: label propagation over a weighted undirected graph (a, b, w); ties take the smaller label.

    Labels that still move after ``rounds`` are an error, as they would depend on it.
    """
    both = cut(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    state = cut(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for k in range(rounds):
        votes = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.max_by("community", F.struct("w", (-F.col("community")).alias("c"))).alias("best"))
        # half of the nodes move a round, so that two-sided groups don't swap labels for ever
        moves = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        new = cut(state.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community"), (moves & (F.col("best") != F.col("community"))).alias("moved"), (F.col("best") != F.col("community")).alias("wants")))
        state = new.select("node", "community")
        if new.where("wants").isEmpty():
            return state
    raise RuntimeError(f"the labels still move after {rounds} rounds")


def soft_communities(edges: DataFrame, labels: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """node, community, weight: communities with at least ``least`` of a node's strongest coupling, weights summing to 1.

    Nodes without an edge are their own community with weight 1.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    pull = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    kept = pull.withColumn("most", F.max("w").over(Window.partitionBy("node"))).where(F.col("w") >= least * F.col("most"))
    shared = kept.select("node", "community", (F.col("w") / F.sum("w").over(Window.partitionBy("node"))).alias("weight"))
    alone = nodes.join(shared.select("node").distinct(), "node", "left_anti").select("node", F.col("node").alias("community"), F.lit(1.0).alias("weight"))
    return shared.unionByName(alone)


def context_impact(members: DataFrame | None, journals: DataFrame) -> DataFrame:
    """node, impact: citations per publication over the citation potential of the journal's communities.

    journals(node, citations, publications, density). Missing densities are filled with the median; a community's
    potential is the weighted mean density of its members. Without communities a journal's own density is its potential.
    Missing citations count as none; where a divisor is missing or 0 the impact is 0.
    """
    filled = journals.withColumn("density", F.coalesce("density", journals.agg(F.median("density").alias("m")).scalar()))
    if members is None:
        own = filled.select("node", F.col("density").alias("potential"))
    else:
        potential = members.join(filled, "node").groupBy("community").agg((F.sum(F.col("weight") * F.col("density")) / F.sum("weight")).alias("potential"))
        own = members.join(potential, "community").groupBy("node").agg(F.sum(F.col("weight") * F.col("potential")).alias("potential"))
    rate = F.try_divide(F.coalesce("citations", F.lit(0)).cast("double"), F.col("publications").cast("double"))
    return filled.join(own, "node", "left").select("node", F.coalesce(F.round(F.try_divide(rate, F.col("potential")), 3), F.lit(0.0)).alias("impact"))


# Acklam's rational approximations of the normal quantile, in the middle and in the tails.
_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
# Royston's polynomials for the two outermost weights of the Shapiro-Wilk test, and for its significance.
_OUTER = ((0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
_FEW = ((0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322))
_MANY = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def _polynomial(coefficients, x):
    """Value of a polynomial, lowest power first."""
    total = coefficients[-1]
    for c in coefficients[-2::-1]:
        total = total * x + c
    return total


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability above 0 and below 1, to nine digits."""
    low = F.least(p, 1 - p)
    q = p - 0.5
    middle = q * _polynomial(_MIDDLE[0][::-1], q * q) / _polynomial(_MIDDLE[1][::-1], q * q)
    t = F.sqrt(-2 * F.log(low))
    tail = _polynomial(_TAIL[0][::-1], t) / _polynomial(_TAIL[1][::-1], t)
    return F.when(low >= 0.02425, middle).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def shapiro(samples: DataFrame, value: str) -> DataFrame:
    """n, w, p: the Shapiro-Wilk test of normality (Royston 1992) over all values that are not null, in one row.

    Values are ranked by ranges and weighted where they lie, so samples of any size take one pass; p is meant for up to
    some thousand values. Fewer than four values, or equal ones, give a null w and p.
    """
    from statistics import NormalDist

    ranked = global_row_number(samples.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.monotonically_increasing_id().alias("i")), ["x", "i"])
    spark, n = samples.sparkSession, ranked.count()
    schema = "n bigint, w double, p double"
    normal = NormalDist()
    if n < 4:
        return spark.createDataFrame([(n, None, None)], schema)
    outer = 1 if n < 6 else 2
    rn = F.col("rn")
    m = normal_quantile((rn - 0.375) / (n + 0.25))
    inside = rn.between(outer + 1, n - outer)
    ends = [F.max(F.when(rn == k, F.col("x"))).alias(f"e{k}") for e in range(outer) for k in {e + 1, n - e}]
    got = ranked.agg(F.sum(m * m).alias("mm"), F.sum(F.when(inside, m * F.col("x"))).alias("inner"), (F.var_pop("x") * n).alias("ss"), *ends).first()
    if not got.ss:
        return spark.createDataFrame([(n, None, None)], schema)
    u = n**-0.5
    top = [normal.inv_cdf((n - e - 0.375) / (n + 0.25)) for e in range(outer)]
    weights = [_polynomial((top[e] / math.sqrt(got.mm), *_OUTER[e]), u) for e in range(outer)]
    spread = (got.mm - 2 * sum(t * t for t in top)) / (1 - 2 * sum(a * a for a in weights))
    total = (got.inner or 0.0) / math.sqrt(spread) + sum(a * (got[f"e{n - e}"] - got[f"e{e + 1}"]) for e, a in enumerate(weights))
    w = min(1.0, total**2 / got.ss)
    y = math.log(max(1e-300, 1 - w))
    if n < 12:
        gap = -2.273 + 0.459 * n - y
        y, means = (-math.log(gap), _FEW) if gap > 0 else (math.inf, _FEW)
        x = n
    else:
        x, means = math.log(n), _MANY
    z = (y - _polynomial(means[0], x)) / math.exp(_polynomial(means[1], x))
    return spark.createDataFrame([(n, w, 1 - normal.cdf(z))], schema)


def effect_size(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, maximum, standard deviation and population variance of two groups (0 and 1), Cohen's d and Cliff's delta, in one row.

    Cliff's delta comes from counts by value, so its window runs over the distinct values.
    """
    rows = samples.where(F.col(group).isin(0, 1) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))

    def of(g: int, f: Column) -> Column:
        return F.when(F.col("g") == g, f)

    v = F.col("v")
    stats = rows.agg(
        *(x.alias(f"{n}_{g}") for g in (0, 1) for n, x in (("n", F.count(of(g, v))), ("mean", F.avg(of(g, v))), ("median", F.median(of(g, v))), ("most", F.max(of(g, v))), ("sd", F.stddev_samp(of(g, v))), ("variance", F.var_pop(of(g, v)))))
    )
    counts = rows.groupBy("v").agg(F.count(of(0, v)).alias("n0"), F.count(of(1, v)).alias("n1"))
    below = F.coalesce(F.sum("n0").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = counts.withColumn("below", below).agg(F.struct(F.sum(F.col("n1") * F.col("below")).alias("more"), F.sum(F.col("n1") * F.col("n0")).alias("ties")).alias("o"))
    both = stats.withColumn("o", order.scalar()).select("*", "o.more", "o.ties").drop("o")
    pooled = F.sqrt((F.col("variance_0") + F.col("variance_1")) / 2)
    pairs = F.col("n_0") * F.col("n_1")
    less = pairs - F.col("more") - F.col("ties")
    return both.withColumn("cohens_d", F.try_divide(F.col("mean_1") - F.col("mean_0"), pooled)).withColumn("cliffs_delta", F.try_divide((F.col("more") - less).cast("double"), pairs.cast("double"))).drop("more", "ties")


def ego_clustering(edges: DataFrame) -> DataFrame:
    """node, degree, clustering: local clustering coefficients of an undirected graph, given as distinct pairs (a, b).

    Edges are turned from the node of lower degree to that of higher, so that a hub makes no wedges between
    all its neighbours: no node has more than sqrt(2 * edges) edges away from it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = cut(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")))
    da, db = (degree.select(F.col("node").alias(x), F.col("degree").alias("d" + x)) for x in "ab")
    ranked = edges.select("a", "b").join(da, "a").join(db, "b")
    swap = F.struct("da", "a") > F.struct("db", "b")
    turned = cut(ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y")))
    wedges = turned.join(turned.withColumnRenamed("y", "z"), "x").where("y < z")
    closing = turned.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    triangles = wedges.join(closing, ["y", "z"])
    corners = triangles.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    k = F.col("degree")
    return degree.join(corners, "node", "left").select("node", "degree", F.when(k > 1, 2 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, steps: int = 2) -> DataFrame:
    """seed, node, distance: the nodes within ``steps`` edges of each seed in an undirected graph (a, b), seeds included.

    ``seeds`` has one column, seed. Each step joins the newly reached nodes only.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")))
    for k in range(steps):
        edge = reached.where(F.col("distance") == k).join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        new = edge.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(k + 1))
        reached = cut(reached.unionByName(new))
    return reached
