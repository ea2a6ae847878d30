"""Matching affiliations to organisations without keys: probabilistic record linkage.

Texts are read once into the words and kinds of their parts. Blocking runs in three passes: the organisation's rarest
name word as written, the same word with one typing error (pairs of q-grams), and the GRID id. Candidates are compared
attribute by attribute into agreement levels, in the JVM. Expectation-maximisation over the counts of the level
patterns learns how often attributes agree in matches, how often in others, and the share of matches; the posterior of a
pattern is the confidence of its links, shared among candidates that a text doesn't tell apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.folding import plain
from scholion.llm.grams import index_grams, let, one_error, probe_grams
from scholion.session import cut

# Words for kinds of organisations, in the languages and short forms people use.
KINDS: dict[str, tuple[str, ...]] = {
    "university hospital": ("university hospital", "university medical center", "university medical centre", "univ hosp", "univ hospital", "universitatsklinikum", "universitatsklinik", "hopital universitaire", "centre hospitalier universitaire", "hospital universitario", "ospedale universitario"),
    "general hospital": ("general hospital", "gen hosp", "gen hospital", "hopital general", "hospital general", "allgemeines krankenhaus", "ospedale generale"),
    "research council": ("research council", "res council", "forschungsrat", "conseil de recherche", "conseil de recherches", "consejo de investigacion", "consejo de investigaciones"),
    "research centre": ("research centre", "research center", "res centre", "res center", "res ctr", "centre de recherche", "centre de recherches", "forschungszentrum", "centro de investigacion", "centro de investigaciones"),
    "national laboratory": ("national laboratory", "national lab", "natl lab", "nat lab", "natl laboratory", "laboratoire national", "laboratorio nacional", "nationallabor"),
    "medical centre": ("medical centre", "medical center", "med centre", "med center", "med ctr", "centro medico", "centre medical", "medizinisches zentrum"),
    "academy": ("academy of sciences", "academy of science", "acad of sci", "acad sci", "academia de ciencias", "academie des sciences", "akademie der wissenschaften"),
    "polytechnic": ("polytechnic", "polytech", "politecnico", "polytechnique", "polytechnikum"),
    "foundation": ("foundation", "fdn", "found", "fondation", "fundacion", "stiftung"),
    "university": ("university", "univ", "universidad", "universite", "universitat", "universita", "universidade"),
    "institute": ("institute", "inst", "institut", "instituto", "istituto"),
    "hospital": ("hospital", "hosp", "hopital", "krankenhaus", "klinikum"),
    "college": ("college", "coll"),
}
GENERIC = {"institute", "hospital", "college"}
LINKING = {"of", "de", "the", "for", "and", "des", "der", "du", "la", "from", "d", "und", "et", "y"}
_KIND = re.compile(r"\b(?:" + "|".join(f"(?P<k{i}>{'|'.join(sorted(v, key=len, reverse=True))})" for i, v in enumerate(KINDS.values())) + r")\b")
_NAMES = list(KINDS)
_KIND_WORDS = {w for v in KINDS.values() for p in v for w in p.split()} | LINKING
_PARTS = re.compile(r"[,;:()\[\]/|\n]+|\s[-–—]\s|\.\s+and\s|\band\s+(?=(?:dept|department|faculty|section)\b)")
_AND = re.compile(r"\s(?:and|und|et|y|&)\s")
_MAIL = re.compile(r"\S+@\S+")
_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"^(?:from )?(?:the )?(?:department|dept|faculty|section|division|school|fac)\b")
_GRID = re.compile(r"grid\.\d{4,8}\.[0-9a-f]{1,2}")


def kind_of(words: list[str]) -> tuple[str | None, list[str]]:
    """The kind of organisation a phrase states, and its remaining words."""
    text = " ".join(words)
    m = _KIND.search(text)
    if not m:
        return None, [w for w in words if w not in LINKING]
    kind = _NAMES[int(next(k for k, v in m.groupdict().items() if v)[1:])]
    rest = (text[: m.start()] + " " + text[m.end() :]).split()
    return kind, [w for w in rest if w not in LINKING]


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows of ``f(*columns)`` for each row of df, over Arrow batches."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    names, types = fields.fieldNames(), [to_arrow_type(x.dataType) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in f(*row)]
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return df.mapInArrow(run, schema)


def _names(word: str) -> bool:
    """Whether organisations are found by a word: one rule for their names and for the texts."""
    return word not in _KIND_WORDS and len(word) > 2


def _organisation(id_: int, name: str | None, city: str | None, grid: str | None):
    words = _WORD.findall(plain(name or ""))
    kind, rest = kind_of(words)
    for at, w in enumerate(words):
        if _names(w):
            yield id_, w, 0 if at in (0, len(words) - 1) else 1, kind, [x for x in rest if x != w], " ".join(_WORD.findall(plain(city or ""))), (grid or "").strip().lower()


def organisation_features(organizations: DataFrame) -> DataFrame:
    """ror_id, word, kind, field, city, grid: one row per distinct name of each organisation, with its rarest word."""
    rows = _map(
        organizations.select("id", "name", "address_city", "grid").where("id is not null").distinct(),
        _organisation,
        "ror_id bigint, word string, edge int, kind string, field array<string>, city string, grid string",
    )
    frequency = rows.groupBy("word").agg(F.countDistinct("ror_id").alias("df"))
    choice = F.struct("df", "edge", "word", "kind", "field", "city", "grid")
    best = rows.join(frequency.hint("merge"), "word").groupBy("ror_id", "city", "grid").agg(F.min(choice).alias("c"))
    return best.select("ror_id", "c.word", "c.kind", "c.field", "c.city", "c.grid").distinct()


#: A text as read: all its words, and its parts. A part is read whole and as what stands between its "and" (place), which may
#: stand in a name or between two; ``inner`` are the words of the latter, kind and rest are of the reading.
READ = "unit bigint, stated string, words array<string>, parts array<struct<place:string,inner:array<string>,kind:string,rest:array<string>>>"


def read_text(text: str) -> tuple[set[str], list[tuple[str, set[str], str | None, list[str]]]]:
    """The words of a text, and (place, inner, kind, rest) of every reading of its parts."""
    words: set[str] = set()
    parts = []
    for k, whole in enumerate(_PARTS.split(_MAIL.sub(" ", plain(text)))):
        every = _WORD.findall(whole)
        words.update(every)
        for j, piece in enumerate(_AND.split(whole)):
            inner = _WORD.findall(piece)
            if any(map(_names, inner)):
                for reading in [every] if inner == every else [every, inner]:
                    parts.append((f"{k}.{j}", set(inner), *kind_of(reading)))
    return words, parts


def read_texts(units: DataFrame) -> DataFrame:
    """READ of (unit, affiliation, stated); texts without a word to find an organisation by are left out."""
    import pyarrow as pa

    def lists(values: list) -> pa.ListArray:
        offsets = [0]
        for v in values:
            offsets.append(offsets[-1] + len(v))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for v in values for x in v], pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, s, *read_text(t)) for u, t, s in zip(*(c.to_pylist() for c in b.columns))]
            rows = [r for r in rows if r[3]]
            flat = [p for r in rows for p in r[3]]
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r[3]))
            parts = pa.StructArray.from_arrays(
                [pa.array([p[0] for p in flat], pa.string()), lists([p[1] for p in flat]), pa.array([p[2] for p in flat], pa.string()), lists([p[3] for p in flat])], names=["place", "inner", "kind", "rest"]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), lists([r[2] for r in rows]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)],
                names=["unit", "stated", "words", "parts"],
            )

    return units.select("unit", "affiliation", "stated").mapInArrow(run, READ)


def typed_words(words: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """(seen, word): words not in ``known``, and no numbers, that turn into a known word by one typing error.

    The joins on grams are told to shuffle: Spark takes a side for as small as the words it comes from, and would broadcast its grams,
    which are many times that, through the driver.
    """
    unknown = words.where((F.length("word") >= least) & ~F.col("word").rlike(r"^\p{Nd}+$")).select("word").distinct().join(known, "word", "left_anti").select(F.col("word").alias("seen"))
    able = known.where(F.length("word") >= least)
    side = lambda df, of, w: df.select(w, F.explode(of(F.lit(""), F.col(w))).alias("gram"))
    longer = side(unknown, probe_grams, "seen").join(side(able, index_grams, "word").hint("merge"), "gram")
    shorter = side(unknown, index_grams, "seen").join(side(able, probe_grams, "word").hint("merge"), "gram")
    met = longer.unionByName(shorter).select("seen", "word").distinct()
    return met.where(one_error(F.col("seen"), F.col("word"), least))


def _agreement(kind: Column, rest: Column, org_kind: Column, org_field: Column) -> tuple[Column, Column]:
    """The agreement levels of kind and field of a reading with an organisation."""
    alone = F.size(rest) == 0
    kinds = F.when(kind.eqNullSafe(org_kind), 2).when(kind.isNull() & alone, 1).otherwise(0)
    meets = (F.size(org_field) > 0) & F.forall(rest, lambda w: F.exists(org_field, lambda f: F.startswith(f, w)))
    return kinds, F.when(alone, 1).when(meets, 2).otherwise(0)


def _by_place(parts: Column, f) -> Column:
    """``f`` of the structs of each place, in an array."""
    return let(parts, lambda of: F.transform(F.array_distinct(F.transform(of, lambda x: x["place"])), lambda q: f(F.filter(of, lambda x: x["place"] == q))))


def patterns(of: str) -> Column:
    """An array of (place, bare, pattern, readings), one for each part of a text that holds the word seen, or one for the text where none was seen.

    Columns: words, parts, stated of the text; the organisation's word, kind, field, city, grid are in the struct ``of``. The
    pattern has the agreement levels (2 agree, 1 not stated, 0 differ) of name, kind, field, city and grid. Of the readings of
    a part the one with more agreement counts. A part is bare if it says no more than the word seen. Its readings are the distinct
    (kind, words beside the one seen), in order.
    """
    org, seen = F.col(of), F.col("seen")
    city = F.when(F.size(org["city"]) == 0, "1").when(F.size(F.array_except(org["city"], F.col("words"))) == 0, "2").otherwise("0")
    grid = F.when(F.col("stated").isNull() | (org["grid"] == ""), "1").when(F.col("stated") == org["grid"], "2").otherwise("0")
    name = F.when(seen == org["word"], "2").otherwise("1")

    def level(p: Column) -> Column:
        rest = F.filter(p["rest"], lambda w: w != seen)
        kinds, fields = _agreement(p["kind"], rest, org["kind"], org["field"])
        bare = ~F.exists(p["inner"], lambda w: (w != seen) & ~w.isin(sorted(LINKING)) & ~w.rlike(r"^\p{Nd}+$"))
        return F.struct(p["place"].alias("place"), (kinds + fields).alias("sum"), bare.alias("bare"), F.concat(name, kinds.cast("string"), fields.cast("string"), city, grid).alias("pattern"), F.struct(p["kind"].alias("kind"), F.array_sort(F.array_distinct(rest)).alias("rest")).alias("reading"))

    levels = F.transform(F.filter("parts", lambda p: F.array_contains(p["inner"], seen)), level)
    best = lambda of: let(F.array_max(of), lambda x: F.struct(x["place"].alias("place"), x["bare"].alias("bare"), x["pattern"].alias("pattern"), F.array_sort(F.array_distinct(F.transform(of, lambda y: y["reading"]))).alias("readings")))
    none = F.array(F.struct(F.lit("").alias("place"), F.lit(False).alias("bare"), F.concat(F.lit("011"), city, grid).alias("pattern"), F.lit(None).cast(READINGS).alias("readings")))
    return F.when(seen.isNull(), none).otherwise(_by_place(levels, best))


#: The distinct readings of a part.
READINGS = "array<struct<kind:string,rest:array<string>>>"
#: The attributes of a pattern of which chance pairs teach how often others agree: kind and field.
DRAWN = (1, 2)


def chance_counts(parts: DataFrame, orgs: DataFrame) -> dict[tuple[int, int], int]:
    """How many pairs of a part (``readings``) with an organisation (``kind``, ``field``), each with each, have which levels of kind and field.

    All pairs are counted, none is made that needn't be: without agreement of the field the levels of a part depend on the kind
    alone, of which there are few; the pairs that agree in a field meet by the rarest word of the reading, and are moved from the one
    count to the other.
    """
    parts = cut(parts.where("readings is not null").groupBy("readings").agg(F.count("*").alias("n")))
    orgs = cut(orgs.select("kind", F.array_sort(F.array_distinct("field")).alias("field")).groupBy("kind", "field").agg(F.count("*").alias("of")))

    def best(kind: Column, field: Column) -> Column:
        def level(x: Column) -> Column:
            kinds, fields = _agreement(x["kind"], x["rest"], kind, field)
            return F.struct((kinds + fields).alias("sum"), kinds.alias("kinds"), fields.alias("fields"))

        return F.array_max(F.transform("readings", level))

    none = F.array().cast("array<string>")
    kinds = [(r.kind, r.of) for r in orgs.groupBy("kind").agg(F.sum("of").alias("of")).collect()]  # the stated kinds, and none
    plain_ = F.array(*(F.struct(best(F.lit(k).cast("string"), none).alias("level"), F.lit(n).cast("bigint").alias("of")) for k, n in kinds)) if kinds else F.lit(None).cast("array<struct<level:struct<sum:int,kinds:int,fields:int>,of:bigint>>")
    every = parts.select("n", F.inline(plain_)).select("level.kinds", "level.fields", (F.col("n") * F.col("of")).alias("n"))

    # pairs that agree in the field
    readings = parts.select(F.explode("readings").alias("r")).select("r.rest").where(F.size("rest") > 0).distinct()
    words = readings.select("rest", F.explode("rest").alias("w"))
    stems = orgs.select(F.explode("field").alias("f")).distinct().select("f", F.explode(F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.substring("f", F.lit(1), i))).alias("w"))
    stems = stems.join(words.select("w").distinct().hint("merge"), "w", "left_semi")
    holds = cut(orgs.select("kind", "field", "of", F.explode("field").alias("f")).join(stems.hint("merge"), "f").select("w", "kind", "field", "of").distinct())
    rarest = words.join(holds.groupBy("w").agg(F.count("*").alias("df")).hint("merge"), "w").groupBy("rest").agg(F.count("*").alias("found"), F.min(F.struct("df", "w")).alias("rare")).where("found = size(rest)")
    by_word = parts.select("readings", "n", F.explode("readings").alias("r")).select("readings", "n", "r.rest").distinct().join(rarest.select("rest", "rare.w").hint("merge"), "rest")
    meet = by_word.join(holds.hint("merge"), "w").where(_agreement(F.lit(None).cast("string"), F.col("rest"), F.col("kind"), F.col("field"))[1] == 2)
    meet = meet.select("readings", "n", "kind", "field", "of").distinct()
    pairs = F.col("n") * F.col("of")
    moved = meet.select(F.inline(F.array(F.struct(best(F.col("kind"), F.col("field")).alias("level"), pairs.alias("n")), F.struct(best(F.col("kind"), none).alias("level"), (-pairs).alias("n"))))).select("level.kinds", "level.fields", "n")
    return {(r.kinds, r.fields): r.n for r in every.unionByName(moved).groupBy("kinds", "fields").agg(F.sum("n").alias("n")).collect()}


def fit(counts: dict[str, int], chance: dict[str, int], others: tuple[str, ...] = (), rounds: int = 100) -> dict[str, float]:
    """Log odds of a match for each pattern, and for ``others``: EM over the patterns' counts.

    EM learns the share of matches, and for both matches and others how often each attribute has each level. Pairs of a text
    with each organisation but the candidate are surely no matches; for kind and field they count among the others, with the weight of
    all candidates, so that the two classes can't trade places where nearly all candidates match. Chance says nothing of the
    name, by which candidates are found, nor of the town, which organisations that share a word often share too. More agreement
    never counts less.
    """
    n = sum(counts.values())
    if not n:
        return {}
    attributes = len(next(iter(counts)))
    first, last = [0.1, 0.3, 0.6], [0.6, 0.3, 0.1]
    total = sum(chance.values())
    drawn = [[n / total * sum(c for p, c in chance.items() if p[i] == str(level)) if total and i in DRAWN else 0.0 for level in range(3)] for i in range(attributes)]

    def shares(i: int, of, more: list[float], start: list[float]) -> list[float]:
        got = [sum(of(p) * c for p, c in counts.items() if p[i] == str(level)) + more[level] for level in range(3)]
        return [(x + f) / (sum(got) + 1) for x, f in zip(got, start)]

    m, u, prior = [first] * attributes, [last] * attributes, 0.5
    for _ in range(rounds):
        post = {}
        for p in counts:
            o = log(prior / (1 - prior)) + sum(log(m[i][int(x)] / u[i][int(x)]) for i, x in enumerate(p))
            post[p] = 1 / (1 + exp(-max(-60.0, min(60.0, o))))
        prior = min(0.99, max(0.01, sum(post[p] * c for p, c in counts.items()) / n))
        m = [shares(i, post.__getitem__, [0.0] * 3, first) for i in range(attributes)]
        u = [shares(i, lambda p: 1 - post[p], drawn[i], [1 / 3] * 3) for i in range(attributes)]
    evidence = []
    for i in range(attributes):
        levels = [log(x / y) for x, y in zip(m[i], u[i])]
        evidence.append([max(levels[: k + 1]) for k in range(3)])
    return {p: log(prior / (1 - prior)) + sum(evidence[i][int(x)] for i, x in enumerate(p)) for p in {**counts, **dict.fromkeys(others)}}


def affiliation_links(affiliations: DataFrame, organizations: DataFrame, threshold: float = 0.1) -> DataFrame:
    """affiliation_id, ror_id, confidence: the organisations each affiliation names.

    Affiliations of equal text and identifier are compared once. Null, blank and useless texts name none;
    an affiliation may name several organisations. Of the candidates for one word in one part of a text the likeliest is taken;
    equally likely ones (equal names and no town to decide) share the confidence, which then is one half at most. A bare word beside a
    fuller part is a town, unless an organisation is called just that and no candidate lies in a town of that name.
    Repeated rows give their links once; empty tables give none.
    """
    grid = F.regexp_extract(F.lower(F.coalesce("identifier", F.lit(""))), r"(grid\.[0-9]{4,8}\.[0-9a-f]{1,2})", 1)
    rows = affiliations.where(F.col("id").isNotNull() & (F.length(F.trim("affiliation")) > 0)).select("id", "affiliation", F.nullif(grid, F.lit("")).alias("stated"))
    unit = F.xxhash64("affiliation", F.coalesce("stated", F.lit("")))
    rows = rows.select(unit.alias("unit"), "id", "affiliation", "stated")
    units = rows.groupBy("unit").agg(F.first("affiliation").alias("affiliation"), F.first("stated").alias("stated"))
    orgs = cut(organisation_features(organizations).withColumn("city", F.array_compact(F.split(F.nullif("city", F.lit("")), " "))).withColumn("city", F.coalesce("city", F.array().cast("array<string>"))))
    texts = cut(read_texts(units))

    words = texts.select("unit", F.explode("words").alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(sorted(_KIND_WORDS)))
    known = orgs.select("word").distinct()
    typos = typed_words(words, known)
    by_word = known.select("word", F.col("word").alias("seen")).unionByName(typos.select("word", "seen"))
    keyed = orgs.join(by_word, "word")
    # words and parts of texts are many times what Spark takes them for, so these joins shuffle as well
    named = words.withColumnRenamed("word", "seen").join(keyed.hint("merge"), "seen")
    by_grid = texts.where("stated is not null").select("unit", F.col("stated").alias("grid")).join(orgs.where("grid <> ''"), "grid").select("unit", *orgs.columns)
    only_grid = by_grid.join(named.select("unit", "ror_id").distinct(), ["unit", "ror_id"], "left_anti").withColumn("seen", F.lit(None).cast("string"))
    candidates = named.select("unit", "seen", *orgs.columns).unionByName(only_grid.select("unit", "seen", *orgs.columns))
    own = F.struct(*orgs.columns[1:]).alias("own")
    full = candidates.select("unit", "seen", "ror_id", own).join(texts.select("unit", "words", "parts", "stated").hint("merge"), "unit")
    seen_in = full.withColumn("found", patterns("own")).withColumn("fuller", F.exists("found", lambda x: ~x["bare"]))
    tagged = F.transform("found", lambda x: F.struct(x["place"].alias("place"), (x["bare"] & F.col("fuller")).alias("bare"), x["pattern"].alias("pattern"), x["readings"].alias("readings")))
    more, town = F.col("own.kind").isNotNull() | (F.size("own.field") > 0), F.array_contains("own.city", F.col("own.word"))
    both = cut(seen_in.select("unit", "ror_id", "seen", more.alias("more"), town.alias("town"), F.inline(tagged)))

    counts: dict[str, int] = {}
    # pairs by chance are those of each candidate's part with all organisations, without the candidate itself
    chance = chance_counts(both.where(~F.col("bare")).select("readings"), orgs)
    every = set()
    for r in both.groupBy("pattern", "bare", F.col("readings").isNotNull().alias("placed")).agg(F.count("*").alias("n")).collect():  # at most 4 * 3**5 rows
        every.add(r.pattern)
        if not r.bare:
            counts[r.pattern] = counts.get(r.pattern, 0) + r.n
            if r.placed:
                chance[int(r.pattern[1]), int(r.pattern[2])] -= r.n
    odds = fit(counts, {f"2{k}{f}11": n for (k, f), n in chance.items()}, tuple(sorted(every)))
    if not odds:
        return rows.select(F.col("id").alias("affiliation_id"), F.lit(0).cast("bigint").alias("ror_id"), F.lit(0.0).alias("confidence")).limit(0)
    of = F.element_at(F.create_map(*(x for p, v in odds.items() for x in (F.lit(p), F.lit(v)))), F.col("pattern"))
    agreement = F.aggregate(F.split("pattern", ""), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0)))
    level = F.struct(of.alias("odds"), agreement.alias("agreement"))
    # all candidates of a text are in one partition from here on
    mine = both.drop("readings").repartition("unit").withColumn("level", F.when(~F.col("bare") | ~F.col("more"), level))
    each = mine.groupBy("unit", "seen", "place", "ror_id").agg(F.max("level").alias("level"), F.bool_or("bare").alias("bare"), F.bool_or("town").alias("town"))
    mention = Window.partitionBy("unit", "seen", "place")
    top = each.withColumns({"best": F.max("level").over(mention), "in_town": F.bool_or("town").over(mention)}).where("level = best and not (bare and in_town)")
    confidence = 1 / (1 + F.exp(-F.col("level.odds"))) / F.count("*").over(mention)
    links = top.withColumn("confidence", confidence).where(F.col("confidence") >= threshold).groupBy("unit", "ror_id").agg(F.max("confidence").alias("confidence"))
    gathered = links.groupBy("unit").agg(F.collect_list(F.struct("ror_id", "confidence")).alias("links"))
    found = rows.select("unit", "id").join(gathered.hint("merge"), "unit").select(F.col("id").alias("affiliation_id"), F.inline("links"))
    return found.groupBy("affiliation_id", "ror_id").agg(F.max("confidence").alias("confidence"))


def named_organisations(links: DataFrame) -> DataFrame:
    """affiliation_id, ror_id: the links more likely than not."""
    return links.where("confidence > 0.5").select("affiliation_id", "ror_id")
