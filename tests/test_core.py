from datetime import datetime, timedelta

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.functions import text
from scholion.operators import hierarchy, linking, metrics, multivalue, nested, orphans, ranking, skew

T0 = datetime(2024, 1, 31, 23)


def day(n):
    return T0 + timedelta(days=n)


REFS = "work_id bigint, key string, doi string, indexed_at timestamp_ntz, ref_key string, at string, side int"
WORKS = "id bigint, doi string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, doi_key string, held int"


def orphan_rows(spark, refs, works, rows):
    pad = lambda rs, n: [(*r, *[None] * n) for r in rs]
    return rows(orphans.orphan_references(spark.createDataFrame(pad(refs, 3), REFS), spark.createDataFrame(pad(works, 2), WORKS)))


def test_orphans(spark, rows):
    works = [
        (1, "10.9/a", day(0), None), (1, "10.9/a", day(5), None), (2, "https://doi.example/10.9/B ", day(9), None),
        (3, "10.9/c", day(0), None), (3, "10.9/c", day(2), day(2)), (None, None, day(0), None),
    ]
    refs = [
        (1, "ok", "doi:10.9/A", day(1)), (1, "ok", "doi:10.9/A", day(3)), (1, "late", "10.9/b", day(2)), (1, "late2", "10.9/b", day(9)), (1, "gone", "10.9/C", day(3)), (1, "before", "10.9/C", day(1)),
        (1, "missing", "10.9/zz", day(1)), (7, "both", "10.9/zz", day(1)), (7, "blank", "  ", day(1)), (None, "null", None, day(1)), (1, None, "10.9/zz", None), (1, "same", "10.9/c", day(2)),
    ]
    assert orphan_rows(spark, refs, works, rows) == sorted(
        [
            (1, "late", "doi", "late", "2024-02"), (1, "gone", "doi", "deleted", "2024-02"), (1, "same", "doi", "deleted", "2024-02"), (1, "missing", "doi", "missing", "2024-02"), (7, "both", "doi", "missing", "2024-02"),
            (7, "both", "work_id", "missing", "2024-02"), (7, "blank", "work_id", "missing", "2024-02"), (1, None, "doi", "missing", None),
        ],
        key=repr,
    )


def test_orphans_empty_tables(spark, rows):
    assert orphan_rows(spark, [], [(1, "10.9/a", day(0), None)], rows) == []
    assert orphan_rows(spark, [(1, "k", "10.9/a", day(0))], [], rows) == [(1, "k", "doi", "missing", "2024-01"), (1, "k", "work_id", "missing", "2024-01")]


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    probe = spark.range(4000).select(F.col("id").cast("string").alias("k"), "id")
    got = skew.BloomFilter(keys, "k", 2000).probe(probe, "k", "may").collect()
    assert all(r.may for r in got if r.id < 2000)
    assert sum(r.may for r in got if r.id >= 2000) < 60
    # beyond the bound the filter is partitioned, and as selective as before
    large = skew.BloomFilter(keys, "k", 2000, max_blocks=1)
    hot = probe.unionByName(spark.range(500).select(F.when(F.col("id") % 2 == 0, "7").alias("k"), F.lit(7).cast("bigint").alias("id")))
    again = large.probe(hot, "k", "may").collect()
    assert large.partitioned and len(again) == 4500 and sorted(r.k for r in again if r.may and int(r.k) >= 2000) == sorted(r.k for r in got if r.may and r.id >= 2000)
    assert sum(r.may is None for r in again) == 250 and all(r.may for r in again if r.k and int(r.k) < 2000)
    assert skew.BloomFilter(keys, "k", 167_000_000).blocks * 512 >= 16 * 167_000_000  # 16 bits a key at any size


def test_skew_safe_lookup(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    got = skew.skew_safe_lookup(left, right, "k", hot=2)
    plain = left.join(right, "k", "left").select("k", "id", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def organisations(spark, ids):
    return spark.createDataFrame([(i, f"p{i}", "x", 1) for i in ids], "id bigint, ror_path string, name string, parent int")


def test_hierarchy(spark, rows):
    rel = [(2, "Parent", "p1"), (2, " PARENT ", "p1"), (2, "child", "p3"), (4, "parent", "p3"), (5, "Related", "p1"), (6, "Parent", "p7"), (7, "Parent", "p8"), (8, "Parent", "p6"), (9, "Parent", "p6"), (10, "Parent", "p9"), (11, "Parent", "p11"), (12, "Parent", "p99"), (99, "Child", "p12"), (5, None, "p1"), (None, "Parent", "p1"), (5, "Parent", None)]
    relationships = spark.createDataFrame([(*r, "x") for r in rel], "ror_id bigint, type string, ror_path string, id string")
    orgs = organisations(spark, [*range(1, 13), 1])
    paths = hierarchy.organisation_paths(relationships, orgs)
    assert rows(paths) == sorted([(2, 1, 1, "1/2"), (3, 1, 2, "1/2/3"), (4, 1, 3, "1/2/3/4"), *((i, -1, -1, "cycle") for i in (6, 7, 8, 11)), (9, -1, -1, "below"), (10, -1, -1, "below")], key=repr)
    links = spark.createDataFrame([(4, 100), (4, 100), (1, 100), (9, 5), (50, 5), (12, None), (12, 6)], "ror_id bigint, work_author_id bigint")
    assert rows(hierarchy.raise_to_root(links, paths, orgs)) == [(1, 100), (12, 6), (9, 5)]
    assert rows(hierarchy.descendants(hierarchy.all_links(relationships, orgs))) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1)]
    none = relationships.limit(0)
    assert rows(hierarchy.organisation_paths(none, orgs)) == []


def test_all_parents_count_in_descendants(spark, rows):
    rel = [(4, "Parent", "p2"), (4, "Parent", "p3"), (2, "Parent", "p1"), (3, "Parent", "p2"), (5, "Parent", "p4"), (5, "Parent", "p9"), (9, "Parent", "p8"), (8, "Parent", "p9"), (6, "Parent", "p7")]
    relationships = spark.createDataFrame(rel, "ror_id bigint, type string, ror_path string")
    orgs = organisations(spark, range(1, 10))
    want = [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1), (3, 4, 1), (7, 6, 1)]  # 5 has a parent below a loop
    assert rows(hierarchy.descendants(hierarchy.all_links(relationships, orgs))) == want
    assert rows(hierarchy.descendants(hierarchy.all_links(relationships.limit(0), orgs))) == []
    assert {r.ror_id: r.path for r in hierarchy.organisation_paths(relationships, orgs).collect()}[4] == "1/2/4"


def test_hierarchy_deep_chain_and_loops_against_walk(spark):
    rng = np.random.default_rng(5)
    parent = {i: i - 1 for i in range(1, 70)} | {i: int(rng.integers(100, 160)) for i in range(100, 160)}
    links = spark.createDataFrame(list(parent.items()), "id bigint, parent bigint")

    def walk(i):
        chain, seen = [], {i}
        while i in parent:
            i = parent[i]
            chain.append(i)
            if i in seen:
                return None
            seen.add(i)
        return chain[::-1]

    def loops(i):
        x = parent[i]
        for _ in range(200):
            if x == i:
                return True
            x = parent.get(x)
            if x is None:
                return False
        return False

    for r in hierarchy.resolve(links).collect():
        want = walk(r.id)
        assert (r.status, r.chain if want else None) == (("tree", want) if want else ("cycle" if loops(r.id) else "below", None))


def test_nested_paths(spark, rows):
    bodies = [
        (1, "crossref", '{"message":{"author":[null,{"affiliation":["a",null,{"name":"b"}]},{"affiliation":{"name":"c"}}],"funder":{"award":"x"},"license":[],"reference":null}}'),
        (1, "crossref", '{"message":{"author":[null,{"affiliation":["a",null,{"name":"b"}]},{"affiliation":{"name":"c"}}],"funder":{"award":"x"},"license":[],"reference":null}}'),
        (2, "pubmed", '{"PubmedArticle":{"MedlineCitation":{"PMID":"9","Article":{"AuthorList":{"Author":{"LastName":"L","AffiliationInfo":{"Affiliation":"z"}}}}}}}'),
        (3, "datacite", '{"attributes":{"doi":"10.9/X","creators":["Plain",{"name":"N","nameIdentifiers":[{"nameIdentifier":"i"},null]}]}}'),
        (4, "crossref", '{"author":[{"given":"cut'), (5, "crossref", '{"author":[{}]} tail'), (6, "crossref", None), (7, "crossref", ""), (8, None, "{}"), (9, "other", '{"author":[1]}'), (10, "crossref", "[]"), (11, "crossref", '{"message":null,"author":[{}]}'),
    ]
    records = spark.createDataFrame([(*b, "clash", 1) for b in bodies], "record_id bigint, source string, body string, doc string, i int")
    got = rows(nested.element_paths(records))
    assert got == sorted([(1, "work_authors", "1"), (1, "work_authors", "2"), (1, "author_affiliations", "1.0"), (1, "author_affiliations", "1.2"), (1, "author_affiliations", "2.0"), (1, "work_funders", "0"), (1, "funder_awards", "0.0"), (2, "pubmed_authors", "0"), (2, "pubmed_author_affiliations", "0.0"), (3, "dc_work_creators", "0"), (3, "dc_work_creators", "1"), (3, "dc_creator_name_identifiers", "1.0"), (11, "work_authors", "0")], key=repr)
    aff = rows(nested.flat_table(records, "author_affiliations").select("record_id", "id", "author_id", "position", "name"))
    assert aff == [(1, (16385 << 7), 16385, 0, "a"), (1, (16385 << 7) | 2, 16385, 2, "b"), (1, 16386 << 7, 16386, 0, "c")]
    assert rows(nested.flat_table(records, "dc_work_creators").select("root_doi", "name")) == [("10.9/x", "N"), ("10.9/x", "Plain")]
    assert rows(nested.element_paths(records.limit(0))) == []


def test_nested_ids_of_long_lists_stay_apart(spark):
    author = '{"LastName":"%s","AffiliationInfo":[%s]}'
    lists = [",".join('{"Affiliation":"%d"}' % i for i in range(n)) for n in (40, 20, 1)]
    body = '{"MedlineCitation":{"Article":{"AuthorList":{"Author":[' + ",".join(author % x for x in zip("abc", lists)) + "]}}}}"
    records = spark.createDataFrame([(1, "pubmed", body), (2, "pubmed", body)], "record_id bigint, source string, body string")
    got = nested.flat_table(records, "pubmed_author_affiliations").collect()
    authors = {r.id for r in nested.flat_table(records, "pubmed_authors").collect()}
    assert len(got) == len({r.id for r in got}) == 2 * 61 and {r.author_id for r in got} == authors
    assert all(r.id == (r.author_id << 4) | r.position if r.position < 16 else r.id < 0 for r in got)


def test_multivalue_titles_and_issns(spark, rows):
    heads = ["Notes on the", "Towards a", "Study of the"]
    tails = ["problem", "series", "sample"]
    single = [f"{heads[i % 3]} input/output of birds, with the {tails[i % 3]}" for i in range(60)]
    packed = [f"{single[i]} / {single[i + 1]}" for i in range(10)] + [f"{single[i]}\t{single[i + 1]}" for i in range(10)]
    odd = [
        (500, '["Notes on the \\"true\\" problem", "Towards a sample", "Towards a sample"]'), (501, '"Notes; on the problem"'), (502, '"Notes; on the problem"; "Study of the ""big"" series"'),
        (503, "Study of the &lt;big&gt; series"), (504, None), (505, "  "), (506, "Notes on the problem\t\tTowards a sample\t"), (507, "Towards a sample " * 4000), (508, "/"),
    ]
    data = [*enumerate(single + packed), *odd]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data * 2], "id bigint, title string, value string, pos int")
    got = {}
    for r in multivalue.split_column(df, "id", "title", multivalue.PROSE).collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    values = {k: [v for _, v in sorted(x)] for k, x in got.items()}
    assert set(values) == {*range(60, 80), 500, 502, 506}
    for i in range(20):
        assert values[60 + i] == [single[i % 10], single[i % 10 + 1]]
    assert values[500] == ['Notes on the "true" problem', "Towards a sample", "Towards a sample"]
    assert values[502] == ["Notes; on the problem", 'Study of the "big" series']
    assert values[506] == ["Notes on the problem", "Towards a sample"]
    assert multivalue.split_column(df.limit(0), "id", "title", multivalue.PROSE).count() == 0
    codes = ["1234-5678", "1234567x; 8765-4321", '"1111-1111","2222-2222"', "3333-3333 (print), 44444444 (online)", "5555-5555\t6666-6666;", "n/a", None, "7777-7777;", "1212-1212 3434-3434", "44444444", '["1234-5678", "1234-5678"]'] * 3
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, issns string")
    got = {}
    for r in multivalue.split_column(df, "id", "issns", multivalue.CODES, multivalue.issn_value).collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items() if k < 11} == {1: ["1234567X", "87654321"], 2: ["11111111", "22222222"], 3: ["33333333", "44444444"], 4: ["55555555", "66666666"], 8: ["12121212", "34343434"], 10: ["12345678"] * 2}


def test_multivalue_long_values_are_not_torn(spark):
    words = ["birds", "input", "output", "the", "series", "problem"]
    title = lambda n: " ".join(words[i % 6] + ("," if i % 10 == 9 and i < n - 1 else "") for i in range(n))
    # short titles whose commas never part, some packed with slashes; then one of 600 words, two of 2000 in one field
    data = [f"{title(25)} of sample {'abc'[i % 3]}" for i in range(60)] + [f"{title(25)} of sample a / {title(25)} of sample b"] * 10 + [title(600), title(2000) + " of sample a / " + title(1999) + " of sample b"]
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, title string")
    got = {}
    for r in multivalue.split_column(df, "id", "title", multivalue.PROSE).collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    assert set(got) == {*range(60, 70), 71}
    assert [v for _, v in sorted(got[71])] == [title(2000) + " of sample a", title(1999) + " of sample b"]


def test_multivalue_split_is_the_best_split():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "Cd", "x,", "y;", "z"], p=[0.3, 0.3, 0.1, 0.1, 0.05, 0.15]) for _ in range(n)) for n in rng.integers(1, 400, 120)]
    model = multivalue.Segmenter({"a", "b", "x", "y"}, multivalue.PROSE)
    model.learn(model.count(texts))
    for text in texts:
        f = multivalue.read_field(text, model.delimiters)
        kinds, n = [model.kind(w) for w in f.words], len(f.words)
        gain = {n: 0.0}
        for k in range(1, n):
            if f.forms[k] is not None:
                part = model.part.get(f.forms[k], 0.5)
                gain[k] = np.log(part / (1 - part)) + sum(sign * model._score(name, kinds[at]) for sign, name, at in [(1, "end", k - 1), (1, "begin", k), (-1, "left", k - 1), (-1, "right", k)])
        score = lambda cuts: sum(gain[b] + model.length[min(multivalue.MAX_LENGTH, b - a)] for a, b in zip([0, *cuts], cuts))
        best = {0: 0.0}
        for j in sorted(gain):
            best[j] = max(best[i] + model.length[min(multivalue.MAX_LENGTH, j - i)] + gain[j] for i in best)
        cuts = np.cumsum([len(multivalue.read_field(v, model.delimiters).words) for v in model.split(text)]).tolist()
        assert abs(score(cuts) - best[n]) < 1e-6


def test_text_functions(spark):
    cases = [("10.9/A", "10.9/a"), ("10.9/a 10.9/a", "10.9/a"), ("10.9/a b", "10.9/ab"), ("10.9/&amp;lt;x", "10.9/<x"), (None, None)]
    df = spark.createDataFrame(cases, "a string, b string")
    assert all(r.x == r.b and r.y == r.b for r in df.select("b", text.normalized_doi(F.col("a")).alias("x"), F.expr(text.doi_sql("a")).alias("y")).collect())
    pages = spark.createDataFrame([("12-15",), ("p1-3",), ("7",), (None,), ("12a-13",), ("12345678901-12345678903",)], "a string")
    assert [r.x for r in pages.select(text.page_count(F.col("a")).alias("x")).collect()] == [4, 4, None, None, 2, 3]
    numbers = spark.createDataFrame([("12345678901x",), ("-5 a",), ("x",), ("9" * 30,), ("-" + "9" * 30,), (None,)], "a string")
    assert [r.x for r in numbers.select(text.numeric_prefix(F.col("a")).alias("x")).collect()] == [12345678901, -5, 0, 2**63 - 1, -(2**63), None]
    dois = spark.createDataFrame([("see doi: 10.1234/Ab.C.",), ("https://doi.org/10.1234/xy)",), ("doi:https://doi.org/10.1234/yz, z",), ("doi: 11.1/x",), (None,)], "a string")
    assert [r.x for r in dois.select(text.doi_in_text(F.col("a")).alias("x")).collect()] == ["10.1234/ab.c", "10.1234/xy", "10.1234/yz", None, None]


def test_dictionary_match_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abc"), n)): int(i) for i, n in enumerate(rng.integers(1, 6, 40))}
    kept = {w: i for w, i in words.items() if not any(w != o and w in o for o in words)}
    texts = ["".join(rng.choice(list("abcd"), int(rng.integers(0, 15)))) for _ in range(200)]
    want = set()
    for k, t in enumerate(texts):
        found = sorted(((-len(w), t.find(w), w) for w in kept if w in t))
        if found:
            want.add((kept[found[0][2]], k))
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "author_id bigint, name string")
    dictionary = spark.createDataFrame(list(words.items()), "word string, ror_id bigint")
    got = linking.link_affiliations(df, dictionary).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert linking.link_affiliations(df, dictionary.limit(0)).count() == 0
    monkeypatch.setitem(sys.modules, "ahocorasick", None)  # without the library
    assert all(list(linking.occurrences(words)(t)).__len__() == sum(t.startswith(w, i) for w in words for i in range(len(t))) for t in texts)


def test_h_index_and_median(spark, rows):
    data = [("a", x) for x in (10, 8, 5, 4, 3)] + [("b", x) for x in (25, 8, 5, 3, 3)] + [("c", 0), ("d", 1), (None, 9)]
    df = spark.createDataFrame(data, "g string, s bigint")
    assert rows(metrics.h_index(df, "g", "s")) == [("a", 4), ("b", 3), ("d", 1)]
    assert rows(metrics.h_median(df, "g", "s")) == [("a", 4, 6.5), ("b", 3, 8.0), ("d", 1, 1.0)]


def test_centrality_symmetric_and_dense(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 1, 5), (1, 1, 99)], "citing int, cited int, n bigint")
    articles = spark.createDataFrame([(1, 10), (2, 10)], "journal int, n bigint")
    assert {r.journal: round(r.score, 6) for r in metrics.centrality(edges, articles).collect()} == {1: 50.0, 2: 50.0}
    rng = np.random.default_rng(1)
    n = 6
    z = rng.integers(0, 4, (n, n))
    z[3] = 0  # cites none
    edges = spark.createDataFrame([(i, j, int(z[i, j])) for i in range(n) for j in range(n) if z[i, j]], "citing int, cited int, n bigint")
    articles = spark.createDataFrame([(i, i + 1) for i in range(n)], "journal int, n bigint")
    h = z.astype(float).T
    np.fill_diagonal(h, 0)
    sums = h.sum(axis=0)
    dangling = sums == 0
    h = np.divide(h, sums, out=np.zeros_like(h), where=~dangling)
    a, p = np.arange(1, n + 1) / 21, np.full(n, 1 / n)
    for _ in range(200):
        p = 0.85 * h @ p + (0.85 * p[dangling].sum() + 0.15) * a
    want = 100 * (h @ p) / (h @ p).sum()
    got = {r.journal: r.score for r in metrics.centrality(edges, articles).collect()}
    assert all(abs(got.get(i, 0) - want[i]) < 1e-3 for i in range(n))


def test_disruption_hot_path_equals_plain(spark):
    rng = np.random.default_rng(8)
    works = spark.createDataFrame([(i, int(rng.integers(0, 4000))) for i in range(60)], "id bigint, day int")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2)) if a != b} | {(i, 0) for i in range(1, 60)} | {(i, 1) for i in range(2, 60, 2)}
    edges = spark.createDataFrame(sorted(pairs), "citing bigint, cited bigint")
    plain, split = ({r.id: (round(r.cd, 9), r.n) for r in metrics.disruption(works, edges, hot=h).collect()} for h in (10**6, 12))
    assert plain == split and plain


def test_communities_and_soft_assignment(spark):
    clique = lambda xs: [(a, b, 5) for a in xs for b in xs if a < b]
    edges = spark.createDataFrame(clique([1, 2, 3, 4]) + clique([11, 12, 13]) + [(4, 11, 1)], "a int, b int, w bigint")
    found = {r.node: r.community for r in metrics.communities(edges).collect()}
    assert len({found[i] for i in (1, 2, 3, 4)}) == 1 and len({found[i] for i in (11, 12, 13)}) == 1 and found[1] != found[11]
    nodes = spark.createDataFrame([(i,) for i in (1, 4, 99)], "node int")
    soft = metrics.soft_communities(edges, metrics.communities(edges), nodes).collect()
    assert [(r.node, r.weight) for r in soft if r.node == 99] == [(99, 1.0)]
    assert abs(sum(r.weight for r in soft if r.node == 4) - 1) < 1e-9
    journals = spark.createDataFrame([(1, 10, 5, 2.0), (4, 0, 0, None), (99, 3, 3, 4.0)], "node int, citations bigint, publications bigint, density double")
    assert {r.node: r.impact for r in metrics.context_impact(metrics.soft_communities(edges, metrics.communities(edges), nodes), journals).collect()}[99] == 0.25


def test_effect_size(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (1, 5), (2, 9), (1, None)], "g int, v int")
    r = metrics.effect_size(df, "g", "v").first()
    assert abs(r.cliffs_delta - 8 / 9) < 1e-9 and abs(r.cohens_d - 2 / np.sqrt(2 / 3)) < 1e-9 and (r.median_0, r.median_1) == (2.0, 4.0)


def test_shapiro(spark):
    from statistics import NormalDist

    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = metrics.shapiro(spark.createDataFrame([(x,) for x in [*weights, None]], "v int"), "v").first()
    assert r.n == 11 and abs(r.w - 0.78881) < 2e-4 and abs(r.p - 0.0067) < 2e-4  # published
    even = [NormalDist().inv_cdf((i + 0.5) / 400) for i in range(400)]
    r = metrics.shapiro(spark.createDataFrame([(x,) for x in even], "v double"), "v").first()
    assert r.w > 0.999 and r.p > 0.9
    r = metrics.shapiro(spark.createDataFrame([(float(x * x * x),) for x in range(400)], "v double"), "v").first()
    assert r.w < 0.85 and r.p < 1e-6
    for few in ([], [1.0, 2.0, 3.0], [5.0] * 9):
        r = metrics.shapiro(spark.createDataFrame([(x,) for x in few], "v double"), "v").first()
        assert (r.n, r.w, r.p) == (len(few), None, None)
    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.99999]
    got = spark.createDataFrame([(x,) for x in ps], "p double").select(metrics.normal_quantile(F.col("p")).alias("q")).collect()
    assert all(abs(r.q - NormalDist().inv_cdf(x)) < 1e-7 for r, x in zip(got, ps))


def test_streaks_and_clustering(spark, rows):
    df = spark.createDataFrame([("a", y) for y in (1, 2, 3, 7, 8)] + [("a", 2), ("b", 5)], "g string, y int")
    assert rows(metrics.streaks(df, "g", "y", 2)) == [("a", 1, 3), ("a", 7, 2)]
    g = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a int, b int")
    assert rows(metrics.ego_clustering(g)) == [(1, 2, 1.0), (2, 2, 1.0), (3, 3, pytest.approx(1 / 3)), (4, 1, 0.0)]


def test_global_ranks(spark):
    from pyspark.sql import Window

    df = spark.range(103).select((F.col("id") * 37 % 11).alias("a"), "id")
    w = Window.orderBy("a", "id")
    want = {r.id: (r.rn, r.t) for r in df.select("id", F.row_number().over(w).alias("rn"), F.ntile(4).over(w).alias("t")).collect()}
    assert {r.id: r.rn for r in ranking.global_row_number(df, ["a", "id"]).collect()} == {k: v[0] for k, v in want.items()}
    assert {r.id: r.tile for r in ranking.global_ntile(df, ["a", "id"], 4).collect()} == {k: v[1] for k, v in want.items()}
    few = {r.id: r.tile for r in ranking.global_ntile(df.limit(3), ["id"], 5).collect()}
    assert sorted(few.values()) == [1, 2, 3]
    assert ranking.global_ntile(df.limit(0), ["id"], 5).count() == 0
    counts = spark.createDataFrame([("x", 5), ("y", 5), ("z", 9), ("w", 1)], "k string, n bigint")
    assert {r.k: r["rank"] for r in ranking.rank_by_count(counts, "n").collect()} == {"z": 1, "x": 2, "y": 2, "w": 4}


def test_frequent_values_decide(spark):
    """A comma parts where the parts are values of the column, and doesn't where the whole is one."""
    whole = ["Soil and Water, Air"] * 6 + [f"Alpha{chr(97 + i)} beta" for i in range(20)]
    parts = ["Bees of Norland", "Ants of Sudland"] * 8
    packed = [f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2])] + [f"Alpha{chr(97 + i)} beta / Alpha{chr(98 + i)} beta" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(whole + parts + packed)), "id bigint, v string")
    model = multivalue.learn_column(df, "v", multivalue.PROSE)
    assert model.values["Bees of Norland"] > 2 and "Bees of Norland, Ants of Sudland" not in model.values
    assert model.split("Soil and Water, Air") == ["Soil and Water, Air"] and model.split("Bees of Norland / Ants of Sudland") == ["Bees of Norland", "Ants of Sudland"]
    assert model.split("Alphaz beta / Bees of Norland") == ["Alphaz beta", "Bees of Norland"]


def test_frequent_values_beyond_any_number_decide(spark):
    """As above, beside more values that are more frequent, and with values of more than 200 letters."""
    whole = ["Soil and Water, Air"] * 6 + [f"Alpha{chr(97 + i)} beta" for i in range(20)]
    long_ = " ".join(f"Norland{chr(97 + i % 20) * 3}" for i in range(30))
    parts = ["Bees of Norland", "Ants of Sudland", long_] * 8
    packed = [f"{a}, {b}" for a, b in zip(parts[::3], parts[1::3])] + [f"Alpha{chr(97 + i)} beta / Alpha{chr(98 + i)} beta" for i in range(12)]
    of = spark.createDataFrame(list(enumerate(whole + parts + packed)), "id bigint, v string")
    more = spark.range(7 * 50_001).select((F.col("id") + 1000).alias("id"), F.concat(F.lit("a"), (F.col("id") % 50_001).cast("string")).alias("v"))
    model = multivalue.learn_column(of.unionByName(more), "v", multivalue.PROSE)
    assert model.values["Bees of Norland"] > 2 and model.values[long_] > 2 and model.values["a50000"] > 1.9
    assert model.split("Soil and Water, Air") == ["Soil and Water, Air"]


def test_words_count_by_themselves_in_any_number(spark):
    """A word that stands 5 times is told from others of its shape, also if 600 words are more frequent."""
    letters = lambda i: "bcdfghklmn"[i // 100] + "aeioubcdfg"[i // 10 % 10] + "klmnoprstv"[i % 10]
    words = [f"x{letters(i)} y{letters(i)}" for i in range(600) for _ in range(6)]
    rows = words + [f"x{letters(i)} zut" for i in range(5)] + [f"x{letters(i)}, y{letters(i + 1)}" for i in range(50)]
    model = multivalue.learn_column(spark.createDataFrame(list(enumerate(rows)), "id bigint, v string"), "v", multivalue.PROSE)
    kinds = {r.w: r.kind for r in model.words.collect()}
    assert kinds["zut"] == "zut" and all(kinds[w] == w for i in range(600) for w in (f"x{letters(i)}", f"y{letters(i)}"))


def test_learning_in_tables_is_the_same(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "Cd", "x,", "y;", "z"], p=[0.3, 0.3, 0.1, 0.1, 0.05, 0.15]) for _ in range(n)) for n in rng.integers(1, 40, 60)]
    model = multivalue.Segmenter({"a", "b", "x", "y"}, multivalue.PROSE)
    counts = model.count(texts)
    model.learn(counts)
    part, unseen, tables = multivalue._learn_tables(spark, spark.createDataFrame([(*k, n) for k, n in counts.items() if k[0] != "length"], "what string, form string, l string, r string, n bigint"))
    assert part == pytest.approx(model.part)
    for r in tables.collect():
        for w in multivalue.UNSEEN:
            assert r[w] == pytest.approx(model.tables[w][r.kind]) and unseen[w] == pytest.approx(model.tables[w][""])


def test_columns_are_split_alike_in_tables(spark, rows, monkeypatch):
    data = [f"{a} of birds / {b}; the sample, {a}" for a in ("Notes", "Study", "Soil") for b in ("Bees", "Ants")] * 3 + ["Notes of birds", "Study of birds", "Bees", None] * 4
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, v string")
    want = rows(multivalue.split_column(df, "id", "v", multivalue.PROSE))
    monkeypatch.setattr(multivalue, "EM_COUNTS", 0)
    assert want and rows(multivalue.split_column(df, "id", "v", multivalue.PROSE)) == want


def test_long_frequent_values_decide(spark):
    """A value of 70 words that occurs often counts as one of few words does, at its place only."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "x,", "y;", "z"]) for _ in range(n))
    model = multivalue.Segmenter(set(), multivalue.PROSE)
    model.learn(model.count([text(n) for n in rng.integers(1, 100, 60)]))
    for _ in range(20):
        f = multivalue.read_field(text(200), model.delimiters)
        nodes = multivalue._nodes(f)
        gains = {k: float(g) for k, g in zip(nodes[1:-1], rng.normal(-1, 2, len(nodes)))}
        values = {(nodes[i], nodes[j]): int(rng.integers(2, 10**9)) for i, j in rng.integers(0, len(nodes), (60, 2)) if i < j}
        score = lambda a, b: model.length[min(multivalue.MAX_LENGTH, b - a)] + gains.get(b, 0.0) + np.log(values.get((a, b), 1))
        best = {0: 0.0}
        for j in nodes[1:]:
            best[j] = max(best[i] + score(i, j) for i in best)
        assert abs(sum(score(a, b) for a, b in model._cuts(f, gains, values)) - best[nodes[-1]]) < 1e-6
    long_ = " ".join(f"Norland{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(70))
    data = [long_] * 9 + ["Bees of Norland"] * 9 + ["Soil and Water, Air"] * 9 + [f"{long_}, Bees of Norland"]
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, v string")
    learned = multivalue.learn_column(df, "v", multivalue.PROSE)
    assert learned.values[long_] > 2
    told = {"at": 0, "to": -1, "times": 9, "letters": len(long_), "whole": multivalue._md5(long_)}
    of = lambda text: multivalue._counts([told, {"at": 70, "to": 73, "times": 2}], text, model.delimiters)
    assert of(f"{long_}, Bees of Norland") == {(0, 70): 9, (70, 73): 2} and of(f"{long_} Bees, of Norland") == of(f"{long_[:-1]}x, Bees of Norland") == {(70, 73): 2}
    got = {}
    for r in multivalue.split_column(df, "id", "v", multivalue.PROSE).collect():
        got.setdefault(r.id, {})[r.pos] = r.value
    assert got == {27: {0: long_, 1: "Bees of Norland"}}
