import csv
import os

import pytest

import fixtures as fx
from scholion import cli
from scholion.plans import processes
from scholion.sources import all as sources
from scholion.sources import sinks, spec
from scholion.sources.errors import UserError


def test_crossref_tables_and_ids(spark, tmp_path, rows):
    s = sources.Crossref(spark, fx.crossref(tmp_path / "c"))
    assert rows(s.table("works").select("id", "doi", "title", "published_year", "issn_electronic", "update_count")) == [
        (0, "10.9000/a", "One\tTwo", 2020, "8765432X", 1), (1, "10.9000/b<x", None, None, None, None), (16384, "10.9000/c", "Three", 1999, None, None)]
    assert rows(s.table("work_authors").select("id", "work_id", "container_id", "orcid", "authenticated_orcid")) == [(0, 0, 0, "0000-0001", 1), (1, 0, 0, None, None), (268435456, 16384, 1, None, None)]
    assert s.table("author_affiliations").columns == ["author_id", "container_id", "name"]
    assert rows(s.table("author_affiliations")) == [(0, 0, "Alpha"), (0, 0, "Beta")]
    assert rows(s.table("work_references").select("work_id", "key", "doi")) == [(0, "r1", "10.9000/b"), (0, "r2", None)]
    assert rows(s.table("funder_awards")) == [(0, 0, "A-1"), (0, 0, "A-2")]
    assert rows(s.table("work_updates").select("label", "doi", "timestamp")) == [("Correction", "10.9000/z", 5)]
    assert [s.table(t).count() for t in s.table_names()] == [3, 3, 2, 2, 1, 1, 1, 1, 1, 2]


def test_query_plain_partitioned_and_errors(spark, tmp_path, rows):
    with sources.Crossref(spark, fx.crossref(tmp_path / "c")) as s:
        sql = "SELECT count(*) AS n FROM works"
        assert rows(s.query(sql)) == [(3,)]
        assert rows(s.query(sql, partition=True)) == [(1,), (2,)]
        per_work = "SELECT works.doi, count(*) AS n FROM works INNER JOIN work_authors ON works.id = work_authors.work_id GROUP BY works.doi"
        assert rows(s.query(per_work)) == rows(s.query(per_work, partition=True)) == [("10.9000/a", 2), ("10.9000/c", 1)]
        assert s.query_columns(sql) == ["n"]
        with pytest.raises(UserError):
            s.query("SELECT nothing FROM works")
    assert not spark.catalog.tableExists("works")


def test_sampling_keeps_container_ids(spark, tmp_path, rows):
    s = sources.Crossref(spark, fx.crossref(tmp_path / "c"), sample=lambda p: p.endswith("1.json.gz"))
    assert rows(s.table("works").select("id", "container_id")) == [(16384, 1)]


def _read(spark, folder, table):
    return spark.read.parquet(os.path.join(folder, table))


def test_populate_conditions(spark, tmp_path, rows):
    s = sources.Crossref(spark, fx.crossref(tmp_path / "c"))
    db = str(tmp_path / "detail")
    s.populate(db, ["works.doi", "work_authors.*"], "work_authors.family = 'Brown'")
    assert rows(_read(spark, db, "works")) == [("10.9000/a",)]
    assert _read(spark, db, "work_authors").count() == 2  # all authors of the matched work
    assert not os.path.exists(os.path.join(db, "work_references"))
    db = str(tmp_path / "single")
    s.populate(db, ["work_authors.given"], "family = 'Green'")  # one table: its rows are filtered
    assert rows(_read(spark, db, "work_authors")) == [("Ada",), ("Cy",)]
    db = str(tmp_path / "sibling")
    s.populate(db, ["work_funders.name"], "work_authors.family = 'Brown' AND author_affiliations.name = 'Alpha'")
    assert rows(_read(spark, db, "work_funders")) == []
    db = str(tmp_path / "all")
    s.populate(db)
    assert sorted(os.listdir(db)) == sorted(s.table_names())
    for bad in (["works"], ["works."], ["nothing.x"], ["works.nothing"]):
        with pytest.raises(UserError):
            s.populate(str(tmp_path / "bad"), bad)
    with pytest.raises(UserError):
        s.populate(str(tmp_path / "bad"), ["works.doi", "work_authors.id"], "name = 'x'")  # several tables have it


def test_attached_database(spark, tmp_path, rows):
    path = fx.crossref(tmp_path / "c")
    sources.Crossref(spark, path).populate(str(tmp_path / "db"), ["works.doi"], "published_year = 1999")
    s = sources.Crossref(spark, path, attach=[f"kept:{tmp_path}/db"])
    for partition in (False, True):
        assert rows(s.query("SELECT id FROM works WHERE EXISTS (SELECT 1 FROM kept.works k WHERE k.doi = works.doi)", partition)) == [(16384,)]
    s.query("INSERT INTO kept.works SELECT doi FROM works WHERE published_year = 2020")
    assert rows(s.query("SELECT doi FROM kept.works")) == [("10.9000/a",), ("10.9000/c",)]
    with pytest.raises(UserError):
        sources.Crossref(spark, path, attach=["nonsense"])
    spark.sql("DROP DATABASE kept CASCADE")


def test_datacite(spark, tmp_path, rows):
    s = sources.Datacite(spark, fx.datacite(tmp_path / "d.tar.gz"))
    assert rows(s.table("dc_works").select("id", "container_id", "doi", "sizes", "formats")) == [
        (0, 0, "10.9/a", "['1 MB']", "None"), (1, 0, "10.9/b", "None", "None"), (16384, 1, "10.9/c", "None", "None")]
    assert rows(s.table("dc_creator_affiliations")) == [(0, 0, "X")]
    assert rows(s.table("dc_work_geo_locations").select("geo_location_point", "geo_location_box")) == [("[1.5, None]", "[None, None, None, None]")]
    assert rows(s.table("dc_work_contributors").select("id", "work_id")) == [(268435456, 16384)]


def test_pubmed(spark, tmp_path, rows):
    s = sources.Pubmed(spark, fx.pubmed(tmp_path / "p"))
    assert rows(s.table("pubmed_articles").select("id", "pubmed_id", "doi", "title", "journal_volume", "journal_year", "journal_month", "journal_issn_type")) == [
        (0, "1", "10.9/x", "Some ", "12A", 2001, "Jan", "Print"), (1, "2", None, None, None, None, None, None)]
    assert rows(s.table("pubmed_authors").select("id", "article_id", "family", "identifier", "identifier_source")) == [(0, 0, "Green", "0000-1", "ORCID"), (1, 0, "Brown", None, None)]
    assert rows(s.table("pubmed_author_affiliations").select("id", "author_id", "affiliation")) == [(0, 0, "Alpha"), (1, 0, "Beta")]
    assert rows(s.table("pubmed_abstracts").select("label", "text")) == [("B", "Lead "), (None, None)]
    assert rows(s.table("pubmed_reference_articles").select("reference_id", "article_id", "id_type")) == [(0, "7", "pubmed")]
    assert s.table("pubmed_meshs").count() == 0


def test_orcid(spark, tmp_path, rows):
    s = sources.Orcid(spark, fx.orcid(tmp_path / "o.tar.gz"))
    assert rows(s.table("persons").select("id", "orcid", "given_names")) == [(0, "0000-1", "Ada"), (1, "0000-2", None)]
    assert rows(s.table("person_keywords")) == [(0, 0, 0, "bees"), (1, 0, 0, "ants")]
    assert rows(s.table("person_educations").select("organization_name", "organization_city", "department_name", "start_year")) == [("Alpha", "Town", "Bio", "1990")]
    assert rows(s.table("person_works")) == [(1, 0, 0, "10.9/x")]  # the work without a DOI keeps its place
    sampled = sources.Orcid(spark, s.path, sample=lambda orcid: orcid == "0000-2")
    assert rows(sampled.table("persons").select("id", "orcid")) == [(1, "0000-2")]


def test_uspto_and_doi_link(spark, tmp_path, rows):
    s = sources.Uspto(spark, fx.uspto(str(tmp_path / "u")))
    assert rows(s.table("us_patents").select("id", "invention_title", "language")) == [(0, "T1", "EN"), (1, "T2", "EN"), (1048576, "T3", "EN")]
    assert rows(s.table("usp_cpc_classifications").where("patent_id = 0").select("type", "section")) == [("further-cpc", None), ("main-cpc", "A")]
    assert rows(s.table("usp_assignees").where("patent_id = 1").select("org_name", "city")) == [("Flat", None), ("Org", "C")]
    assert rows(s.table("usp_inventors").select("patent_id", "sequence", "last_name")) == [(1, "1", "I")]
    db = str(tmp_path / "db")
    s.populate(db, ["usp_citations.*"])
    processes.link_uspto_doi(spark, db)
    assert rows(_read(spark, db, "usp_nplcit_dois").select("patent_id", "doi")) == [(0, "10.1234/ab.c"), (1, "10.1234/ab.c"), (1048576, "10.1234/ab.c")]


def test_ror_and_affiliation_links(spark, tmp_path, rows):
    db = str(tmp_path / "db")
    s = sources.Ror(spark, fx.ror(tmp_path / "r.zip"))
    assert rows(s.table("research_organizations").select("id", "ror_path", "grid", "address_lat", "address_country_code"))[0] == (0, "o1", "grid.1", 1.5, "AV")
    assert rows(s.table("ror_isnis").where("ror_id = 1")) == [(16384, 1, "i1"), (16385, 1, "i2")]
    assert rows(s.table("ror_relationships").select("ror_id", "type", "ror_path")) == [(1, "Parent", "o1"), (2, "Parent", "o2")]
    s.populate(db)
    texts = [(7, "Dept, Alpha Institute Annex, Town"), (8, "Ministry of Science"), (9, "none"), (10, "ACo3 and Gone"), (11, None)]
    spark.createDataFrame(texts, "author_id bigint, name string").write.parquet(os.path.join(db, "author_affiliations"))
    processes.link_aa_base_ror(spark, db)
    # "Alpha Institute" is left out of the dictionary, as it stands inside another name
    assert rows(_read(spark, db, "work_authors_rors")) == [(0, 8), (2, 10), (2, 7)]
    processes.link_aa_top_ror(spark, db)
    assert rows(_read(spark, db, "work_authors_rors")) == [(0, 10), (0, 7), (0, 8)]
    assert _read(spark, db, "work_authors_direct_rors").count() == 3
    with pytest.raises(UserError):
        processes.link_works_asjcs(spark, db)


def _csv(path, header, lines, delimiter=","):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=delimiter).writerows([header, *lines])
    return str(path)


def test_csv_sources(spark, tmp_path, rows):
    db = str(tmp_path / "db")
    at = _csv(tmp_path / "a.csv", ["Code", "Field", "Area"], [["1000", "General Arts", "Z"], ["1001", "History", "Z"], ["2000", "General Maths", "A"], [], ["2001", "Algebra", "A"]], ";")
    sources.Asjcs(spark, at).populate(db)
    assert rows(_read(spark, db, "asjc_general_fields")) == [(1000, "Arts"), (2000, "Maths")]
    assert rows(_read(spark, db, "asjc_subject_areas")) == [(1, "A"), (2, "Z")]
    assert rows(_read(spark, db, "asjcs")) == [(1000, "General Arts", 2, 1000), (1001, "History", 2, 1000), (2000, "General Maths", 1, 2000), (2001, "Algebra", 1, 2000)]
    spark.createDataFrame([(1, "Algebra"), (2, "x"), (3, "History")], "work_id bigint, name string").write.parquet(os.path.join(db, "work_subjects"))
    processes.link_works_asjcs(spark, db)
    assert rows(_read(spark, db, "works_asjcs")) == [(1, 2001), (3, 1001)]

    at = _csv(tmp_path / "j.csv", list("abcdefgh"), [["T1", "1", "P", "1111-1111", "", "2222-2222; 3333-3333", "", ""], ["T2", "2", "P", "", "4444-4444", "", "", ""]])
    j = sources.JournalNames(spark, at)
    j.populate(db)
    want = [(0, "11111111", "P"), (0, "22222222", "A"), (0, "33333333", "A"), (1, "44444444", "E")]
    assert rows(_read(spark, db, "journals_issns")) == want == rows(j.table("journals_issns"))

    f = sources.FunderNames(spark, _csv(tmp_path / "f.csv", ["u", "n", "r"], [["u1", "N1", ""], ["u2", "N2", "u1"]]))
    assert rows(f.table("funder_names")) == [(0, "u1", "N1", None), (1, "u2", "N2", "u1")]
    f.populate(db, None, "replaced IS NOT NULL")
    assert rows(_read(spark, db, "funder_names").select("id")) == [(1,)]

    d = sources.Doaj(spark, _csv(tmp_path / "d.csv", ["x"] * 54, [["N"] + [""] * 4 + ["1234-5678"] + [""] * 18 + ["12", "Yes"] + [""] * 28]))
    d.populate(db)
    assert rows(_read(spark, db, "open_access_journals").select("name", "url", "issn_print", "review_process", "apc")) == [("N", None, "12345678", None, None)]
    s = sources.IssnSubjectCodes(spark, _csv(tmp_path / "s.csv", ["issn", "code"], [["11111111", "12"], ["2", "x"]]))
    assert rows(s.table("issn_subject_codes").select("issn", "subject_code")) == [("11111111", 12), ("2", None)]
    with pytest.raises(UserError):
        sources.Crossref(spark, str(tmp_path)).download()
    spark.createDataFrame([("11111111", None), (None, "33333333")], "issn_print string, issn_electronic string").write.parquet(os.path.join(db, "works"))
    target = str(tmp_path / "s.csv")
    assert s.download(db, target, lambda issn: [1, 2]) == 2  # one ISSN is already there


def test_spec_helpers():
    t = sources.Crossref.tables
    assert spec.closure_to_root(t, ["funder_awards"], "works") == {"works", "work_funders", "funder_awards"}
    assert spec.parents_first(t, {"funder_awards", "works", "work_funders", "work_authors"}) == ["works", "work_authors", "work_funders", "funder_awards"]
    assert spec.chosen_columns(t, ["works.title", "works.doi"]) == {"works": ["doi", "title"]}
    assert sum(len(c.tables) for c in sources.SOURCES.values()) == 90
    names = [x.name for c in sources.SOURCES.values() for x in c.tables]
    assert len(names) == len(set(names))


def test_command_line(spark, tmp_path, capsys):
    path = fx.crossref(tmp_path / "c")
    out = str(tmp_path / "out.csv")
    assert cli.main(["query", "crossref", path, "-q", "SELECT doi, published_year FROM works ORDER BY doi", "-H", "-F", "|", "-o", out]) == 0
    assert open(out).read().splitlines() == ["doi|published_year", "10.9000/a|2020", "10.9000/b<x|", "10.9000/c|1999"]
    assert cli.main(["populate", "crossref", path, "-d", str(tmp_path / "db"), "-c", "works.doi", "-r", "published_year = 2020", "-s", "'.gz' in data"]) == 0
    assert spark.read.parquet(str(tmp_path / "db" / "works")).count() == 1
    assert cli.main(["import", out, "years", "-d", str(tmp_path / "db"), "-F", "|", "--schema", "doi string, year int"]) == 0
    assert spark.read.parquet(str(tmp_path / "db" / "years")).agg({"year": "sum"}).first()[0] == 2020 + 1999
    sinks.write_parts(spark.read.parquet(str(tmp_path / "db" / "years")), str(tmp_path / "parts"))
    sinks.import_table(spark, str(tmp_path / "parts"), str(tmp_path / "db"), "again")
    assert spark.read.parquet(str(tmp_path / "db" / "again")).dtypes == [("doi", "string"), ("year", "string")]
    assert cli.main(["query", "nothing", path, "-q", "SELECT 1"]) == 1
    assert cli.main(["process", "nothing", "-d", path]) == 1
    for listing in (["list-sources"], ["list-processes"], ["list-source-schema", "ror"], ["list-process-schema", "link-uspto-doi"], ["list-complete-schema"], ["version"]):
        assert cli.main(listing) == 0
    assert "CREATE TABLE works(" in capsys.readouterr().out
    with pytest.raises(UserError):
        cli.sampler("data.__class__")
    for bad in ("(lambda: [c for c in ().__class__.__base__.__subclasses__()])()", "().__class__", "[x for x in data]", "random.seed(1)", "open(data)", "9 ** 9 ** 9", "data.format(1)", "f'{data}'", "1 +"):
        with pytest.raises(UserError):
            cli.sampler(bad)
    assert cli.sampler("random.random() < 2 and '0.' in data and data[-3:] == '.gz' and not data.endswith('x')")("0.json.gz") is True
    assert cli.main(["-d", "sql,time,files", "query", "crossref", path, "-q", "SELECT doi FROM works", "-o", out]) == 0
    assert cli.main(["-d", "nothing", "list-sources"]) == 1
    said = capsys.readouterr().err
    assert "[sql] SELECT doi FROM works" in said and "[time] query" in said and "0.json.gz" in said


def test_lists_longer_than_their_bits(spark, tmp_path, rows):
    import gzip
    import json

    authors = [{"family": f"F{i}", "affiliation": [{"name": f"{i}.{j}"} for j in range(200 if i == 0 else 1)]} for i in range(3)]
    (tmp_path / "c").mkdir()
    with gzip.open(tmp_path / "c" / "0.json.gz", "wt") as f:
        f.write(json.dumps({"DOI": "10.9/a", "author": authors}) + "\n")
    s = sources.Crossref(spark, str(tmp_path / "c"))
    joined = s.query("SELECT work_authors.family, count(*) AS n FROM work_authors JOIN author_affiliations ON author_affiliations.author_id = work_authors.id GROUP BY 1")
    assert rows(joined) == [("F0", 200), ("F1", 1), ("F2", 1)]
    from scholion.operators.nested import packed_id

    ids = [packed_id(p, i, 4) for p in range(40) for i in range(40)]
    assert len(set(ids)) == 1600
    with pytest.raises(ValueError):
        packed_id(-3, 99, 4)


def test_partition_mode_reads_only_its_file(spark, tmp_path, rows):
    path = fx.crossref(tmp_path / "c")
    s = sources.Crossref(spark, path)
    assert s.container_ids() == [0, 1] and rows(s.read_container(1).select("container_id", "item")) == [(1, 0)]
    got = s.query("SELECT count(*) AS n FROM works", partition=True)
    assert [sorted({f.rsplit("/", 1)[-1] for f in [r.member for r in s.read_container(c).select("member").collect()]}) for c in (0, 1)] == [["0.json.gz"], ["1.json.gz"]] and rows(got) == [(1,), (2,)]


def test_records_as_a_data_source(spark, tmp_path, rows):
    from scholion.sources import plugin

    path = fx.crossref(tmp_path / "c")
    with open(os.path.join(path, "x.lines"), "w") as f:
        f.write("one\ntwo\n")

    def lines(container, file):
        for i, line in enumerate(open(file)):
            yield container, i, "lines", line.strip()

    plugin.add_format("lines", r"\.lines$", lines)
    plugin.register(spark)
    assert rows(spark.read.format("scholion_records").option("source", "crossref").option("path", path).load().select("container_id", "item")) == [(0, 0), (0, 1), (1, 0)]
    assert rows(spark.read.format("scholion_records").option("source", "lines").option("path", path).load()) == [(0, 0, "lines", "one"), (0, 1, "lines", "two")]


def test_records_are_not_taken_for_as_small_as_their_paths(spark, tmp_path, rows):
    import gzip
    import json

    (tmp_path / "c").mkdir()
    for k in range(2):
        with gzip.open(tmp_path / "c" / f"{k}.json.gz", "wt") as f:
            for i in range(500):
                f.write(json.dumps({"DOI": f"10.9/{k}.{i}", "type": "t", "reference": [{"key": f"r{j}", "DOI": f"10.9/{j}.{i}"} for j in range(4)]}) + "\n")
    s = sources.Crossref(spark, str(tmp_path / "c"))
    assert s.read_records().rdd.getNumPartitions() == 2
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # the paths have less, each side of the join more
    try:
        got = s.query("SELECT type, count(*) AS n, count(DISTINCT work_references.doi) AS dois FROM works JOIN work_references ON works.id = work_references.work_id GROUP BY type")
        assert rows(got) == [("t", 4000, 2000)]
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_containers_written_in_batches(spark, tmp_path):
    import gzip

    from pyspark.sql import functions as F

    from scholion.plans.sourced import write_containers

    bodies = spark.range(2500, 0, -1, 7).select((F.col("id") % 3).alias("file"), F.col("id").alias("place"), F.concat(F.lit("b"), "id").alias("body"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        write_containers(bodies, str(tmp_path), "{}.gz", "head\n", "tail")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    for k in range(3):
        with gzip.open(tmp_path / f"{k}.gz", "rt") as f:
            assert f.read() == "head\n" + "".join(f"b{i}\n" for i in range(1, 2501) if i % 3 == k) + "tail"


def test_subject_links_take_little_space(spark, tmp_path):
    from pyspark.sql import functions as F

    db = str(tmp_path / "db")
    spark.range(20000).select(F.col("id").cast("int"), F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(20))).alias("field")).write.parquet(os.path.join(db, "asjcs"))
    spark.range(2000).select((F.col("id") * 7919).alias("work_id"), F.concat(F.lit("f"), F.col("id") % 21).alias("name")).write.parquet(os.path.join(db, "work_subjects"))
    processes.link_works_asjcs(spark, db)
    got, works, codes = _read(spark, db, "works_asjcs"), _read(spark, db, "work_subjects"), _read(spark, db, "asjcs")
    want = works.join(codes, F.col("name") == F.col("field")).select("work_id", F.col("id").alias("asjc_id"))
    n = want.count()
    assert n > 1_500_000 and got.count() == n and got.exceptAll(want).isEmpty()
    held = sum(p.stat().st_size for p in (tmp_path / "db" / "works_asjcs").glob("*.parquet"))
    assert held < n / 4, held


def test_codes_that_are_missing_or_occur_twice_are_linked(spark, rows):
    from scholion.operators import linking

    codes = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (1 << 30, "a"), (2, None), (3, "c")], "id int, field string")
    works = spark.createDataFrame([(7, "a"), (8, None), (9, "b"), (10, "c")], "work_id bigint, name string")
    assert rows(linking.link_subjects(works, codes)) == [(10, 3), (7, 1), (7, 1), (7, 1 << 30), (7, None), (7, None)]
