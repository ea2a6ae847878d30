"""Variant spellings of personal names: prefix-filtered q-gram join of tokens, soft weighted token similarity of names.

Spellings are read into a family word and given words; names that read alike form one node. All words of the
corpus, families and given words, are sets of positional q-grams. One self-join by a prefix of them (see ``grams``) finds
the words that differ by one error, another the long families that differ by two beside near given words. Short forms
come from the list given and from given words that stand for each other under one identifier.

A name then meets others by (family word, first given word): by its own words and by the *more frequent* words near
them, so that rare misspellings go to the usual spelling and never the other way. Initials meet given words of one
family by their letter. Where names meet, soft token similarity is computed in place, with weights by rarity. Every
node points at the fuller, better supported spelling it varies, and the roots of these pointers are the persons.

Nodes and spellings are known by 64-bit hashes, with less than one expected collision in 10**9 names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.folding import plain
from scholion.llm.grams import exchanged_and_one_error, index_grams, index_two, letter_bags, letter_counts, letters_allow, one_error, probe_grams, probe_two, two_errors
from scholion.llm.linkage import _map
from scholion.session import cut

#: Families and given words of at least this length may differ by an error.
SHORT_WORD, SHORT_GIVEN = 5, 3
#: Families of at least this length may differ by two errors, if the first given words agree.
LONG_WORD = 9
#: Beginnings of up to so many letters are listed; longer ones are found by their first letters and compared.
HEAD = 40

# Words before a family name, and words after a name that are no part of it.
PARTICLES = {"von", "van", "der", "den", "de", "da", "di", "del", "della", "dos", "do", "du", "des", "la", "le", "el", "al", "bin", "ibn", "ben", "abu", "ter", "ten", "zu", "zur", "af", "av", "st", "san", "vande"}
TITLES = {"md", "phd", "jr", "sr", "ii", "iii", "iv", "2nd", "3rd", "4th", "dr", "prof", "msc", "bsc", "ba", "ma", "mph", "dds", "rn", "esq", "mbbs", "mba", "junior", "senior"}
# Letters of equal sound, replaced in this order.
SOUNDS = (("ph", "f"), ("ck", "k"), ("th", "t"), ("y", "i"), ("c", "k"), ("w", "v"), ("q", "k"), ("z", "s"))

_SPLIT = re.compile(r"[^\w'’-]+")


def _tokens(text: str | None) -> list[str]:
    return [t for t in (w.strip("-'’_") for w in _SPLIT.split(plain(text or ""))) if t]


def _family(tokens: list[str]) -> str:
    """The family word: particles and titles dropped, the rest written together."""
    parts = [p for t in tokens for p in re.split(r"[-'’]", t) if p]
    while len(parts) > 1 and parts[-1] in TITLES:
        parts.pop()
    while len(parts) > 1 and parts[0] in PARTICLES:
        parts.pop(0)
    return "".join(parts)


def _given(tokens: list[str]) -> list[str]:
    out = [t.replace("'", "").replace("’", "") for t in tokens if t not in TITLES or len(tokens) == 1]
    return [t for t in out if t]


def read_name(given: str | None, family: str | None, initials: str | None) -> list[tuple[str, list[str]]]:
    """The ways to read a spelling, likeliest first: (family word, given words).

    Handles families that hold the whole name (``Family, Given``), given fields that hold it
    (``Given Family``), titles, particles and exchanged fields. Empty when no family word can be told.
    """
    g, f = _tokens(given), _tokens(family)
    if family and "," in family:
        head, _, tail = plain(family).partition(",")
        f, rest = _tokens(head), [t for t in _tokens(tail) if t not in TITLES]
        g = g or rest
    if not f and len(g) > 1:
        while len(g) > 2 and g[-1] in TITLES:
            g.pop()
        at = next((i for i, t in enumerate(g) if i and t in PARTICLES), len(g) - 1)
        g, f = g[:at], g[at:]
    elif not g and len(f) > 1 and f[0] not in PARTICLES:
        g, f = f[:-1], f[-1:]
    if not g and initials:
        g = [c for c in plain(initials) if c.isalpha()]
    g = _given(g)
    ways = [(_family(f), g)] if f else []
    # exchanged fields: the given field is one (particled) word of a family's length, the other holds given words
    if given and family and "," not in family and g and len(_family(g)) > 3 and len([t for t in g if t not in PARTICLES]) <= 1:
        ways.append((_family(g), _given(f)))
    return [(a, b) for a, b in ways if a and b]


def sound(word: Column) -> Column:
    """A word with letters of equal sound made equal."""
    for a, b in SOUNDS:
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


# ---- words ----


def near_words(words: DataFrame) -> DataFrame:
    """(kind, small, big): pairs of words (kind ``f`` or ``g``, word, df) that differ by one error; ``big`` is the more frequent."""
    k, w = F.col("kind"), F.col("word")
    able = words.where(F.length(w) >= F.when(k == "f", SHORT_WORD).otherwise(SHORT_GIVEN))
    index = able.select("kind", "word", "df", F.explode(index_grams(k, w)).alias("gram"))
    probe = able.select(F.col("word").alias("word_b"), F.col("df").alias("df_b"), F.explode(probe_grams(k, w)).alias("gram"))  # a gram tells its kind
    a, b = F.col("word"), F.col("word_b")
    met = index.join(probe, "gram").where(a != b).select("kind", "word", "df", "word_b", "df_b").distinct()
    return _ordered(met.where(one_error(a, b, SHORT_GIVEN)))


def near_families(beside: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, small, big): long families two errors apart, of which an exchange of neighbours is one, that stand beside a common
    given word: pairs (family, given)."""
    dated = beside.where(F.length("family") >= LONG_WORD).withColumn("letters", letter_counts(F.col("family")))
    index = dated.select("family", "letters", F.explode(index_two(F.col("given"), F.col("family"))).alias("gram"))
    probe = dated.select(F.col("family").alias("family_b"), F.col("letters").alias("letters_b"), F.explode(probe_two(F.col("given"), F.col("family"), LONG_WORD)).alias("gram"))
    met = index.join(probe, "gram").where((F.col("family") != F.col("family_b")) & letters_allow(F.col("letters"), F.col("letters_b"), 2))
    edited = met.where(F.levenshtein("family", "family_b", 2) == 2).select(F.least("family", "family_b").alias("family"), F.greatest("family", "family_b").alias("family_b"))
    # one of the errors exchanges letters, which the letters a word is made of don't show
    bags = beside.where(F.length("family") >= LONG_WORD).select("family", F.explode(letter_bags(F.col("given"), F.col("family"))).alias("gram"))
    mixed = bags.join(bags.withColumnRenamed("family", "family_b"), "gram").where((F.col("family") < F.col("family_b")) & exchanged_and_one_error(F.col("family"), F.col("family_b")))
    near = edited.unionByName(mixed.select("family", "family_b")).distinct()
    df = words.where("kind = 'f'").select("word", "df")
    return _ordered(near.join(df.withColumnRenamed("word", "family"), "family").join(df.select(F.col("word").alias("family_b"), F.col("df").alias("df_b")), "family_b").select(F.lit("f").alias("kind"), F.col("family").alias("word"), "df", F.col("family_b").alias("word_b"), "df_b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    up = F.struct("df", "word") < F.struct("df_b", "word_b")
    return pairs.select("kind", F.when(up, F.col("word")).otherwise(F.col("word_b")).alias("small"), F.when(up, F.col("word_b")).otherwise(F.col("word")).alias("big"))


def short_forms(nicknames: DataFrame, rows: DataFrame, families: int = 2) -> DataFrame:
    """(short, full): the list given, and what the identifiers teach.

    Learned are two given words (neither initials) that are the only ones under one identifier and family, in
    ``families`` families or more; the shorter counts as the short form. Misspellings hardly repeat in another family.
    ``rows`` has oid, fam, g1.
    """
    fold = lambda c: F.lower(F.trim(c))
    listed = nicknames.select(fold("nickname").alias("short"), fold("given").alias("full"))
    told = rows.where("oid is not null and length(g1) > 1").groupBy("oid", "fam").agg(F.min("g1").alias("x"), F.max("g1").alias("y"), F.count_distinct("g1").alias("k")).where("k = 2")
    shorter = F.struct(F.length("x"), F.col("x")) < F.struct(F.length("y"), F.col("y"))
    pairs = told.select("fam", F.when(shorter, F.col("x")).otherwise(F.col("y")).alias("short"), F.when(shorter, F.col("y")).otherwise(F.col("x")).alias("full"))
    learned = pairs.groupBy("short", "full").agg(F.count_distinct("fam").alias("n")).where((F.col("n") >= families) & ~one_error(F.col("short"), F.col("full"), 1))
    return listed.unionByName(learned.select("short", "full")).where("length(short) > 1 and length(full) > 1 and short <> full").distinct()


def word_table(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """kind, word, df, bigs (the more frequent words near it, and itself), forms (what a given word may be short for)."""
    of = F.array_distinct(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("word")) for kind, c in (("f", "sound"), ("g", "first"), ("g", "whole")))))
    words = cut(nodes.select(F.inline(of)).groupBy("kind", "word").agg(F.count("*").alias("df")))
    given = words.where("kind = 'g'").select("word", "df")
    other = given.select(F.col("word").alias("word_b"), F.col("df").alias("df_b"))
    g = F.lit("g").alias("kind")
    # what a word begins with, and what it is a short form of
    lengths = F.sequence(F.lit(3), F.least(F.lit(HEAD), F.length("word") - 2))
    begins = given.where(F.length("word") > 4).select(F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("word_b"), "word", "df")
    long = given.where(F.length("word") > HEAD + 2).withColumn("head", F.substring("word", 1, HEAD)).join(other.where(F.length("word_b") > HEAD).withColumn("head", F.substring("word_b", 1, HEAD)), "head")
    long = long.where(F.startswith("word", "word_b") & (F.length("word") - F.length("word_b") >= 2))
    begun = begins.join(other, "word_b").select(g, "word", "df", "word_b", "df_b").unionByName(long.select(g, "word", "df", "word_b", "df_b"))
    short = given.join(forms, F.col("word") == F.col("short")).join(other, F.col("full") == F.col("word_b")).select(g, "word", "df", "word_b", "df_b")
    # two short forms of one full form, of which the full form itself may not occur
    two = forms.join(forms.select(F.col("short").alias("word_b"), "full"), "full").where("short < word_b")
    both = two.join(given, F.col("word") == F.col("short")).join(other, "word_b").select(g, "word", "df", "word_b", "df_b")
    near = cut(near_words(words).unionByName(_ordered(begun.unionByName(short).unionByName(both))).distinct())

    # a given word stands beside a family as written, and as the more frequent words near it
    written = nodes.where(F.length("first") > 1).select(F.col("sound").alias("family"), F.col("first").alias("given")).distinct()
    bigger = near.where("kind = 'g'").select(F.col("small").alias("given"), "big")
    beside = written.unionByName(written.join(bigger, "given").select("family", F.col("big").alias("given")))
    ups = near.unionByName(near_families(beside, words)).groupBy("kind", F.col("small").alias("word")).agg(F.collect_set("big").alias("bigs"))
    full = forms.groupBy(F.col("short").alias("word")).agg(F.collect_set("full").alias("forms")).withColumn("kind", F.lit("g"))
    found = words.join(ups, ["kind", "word"], "left").join(full, ["kind", "word"], "left")
    return cut(found.select("kind", "word", "df", F.array_append(F.coalesce("bigs", F.array().cast("array<string>")), F.col("word")).alias("bigs"), "forms"))


# ---- names ----


def _bare(word: Column) -> Column:
    return F.replace(word, F.lit("-"), F.lit(""))


def name_nodes(authors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id and spelling of every row, spelling and node, nodes): each node with family, given words and support.

    Where a spelling can be read in two ways, the way whose words are used so elsewhere in the corpus wins.
    """
    sid = F.xxhash64(F.to_json(F.struct("given", "family", "initials"))).alias("sid")
    rows = authors.where("id is not null and (given is not null or family is not null)").select("id", "given", "family", "initials").distinct().select("id", "given", "family", "initials", sid)
    spelled = rows.groupBy("sid", "given", "family", "initials").agg(F.count("*").alias("n"))

    def ways(sid, given, family, initials, n):
        for k, (f, g) in enumerate(read_name(given, family, initials)):
            yield sid, k, f, g, n

    read = cut(_map(spelled, ways, "sid bigint, way int, fam string, giv array<string>, n bigint"))
    # particles stand with either name and tell nothing
    used = F.array_append(F.transform(F.filter("giv", lambda w: ~w.isin(sorted(PARTICLES))), lambda w: F.struct(w.alias("w"), F.lit(0).alias("is_family"))), F.struct(F.col("fam").alias("w"), F.lit(1).alias("is_family")))
    use = read.where("way = 0").select(F.inline(used)).groupBy("w").agg(F.sum("is_family").alias("nf"), F.sum(1 - F.col("is_family")).alias("ng"))
    several = read.where("way = 1").select("sid").distinct()
    parts = read.join(several, "sid", "left_semi").select("*", F.inline(used)).join(use, "w", "left").fillna(0, ["nf", "ng"])
    # a spelling's own words are among the counts, in their roles of way 0, so one is taken off there
    family = F.col("is_family") == 1
    counted_as_family = family == (F.col("way") == 0)
    nf = F.greatest(F.lit(0), F.col("nf") - counted_as_family.cast("int"))
    ng = F.greatest(F.lit(0), F.col("ng") - (~counted_as_family).cast("int"))
    odds = F.log((nf + 0.5) / (ng + 0.5))
    scored = parts.repartition("sid").groupBy("sid", "way").agg(
        (F.avg(F.when(family, odds)) + F.avg(F.when(~family, -odds))).alias("score"), F.first("fam").alias("fam"), F.first("giv").alias("giv"), F.first("n").alias("n")
    )
    best = scored.groupBy("sid").agg(F.max_by(F.struct("fam", "giv", "n"), F.struct("score", -F.col("way"))).alias("b")).select("sid", "b.*")
    chosen = read.join(several, "sid", "left_anti").select("sid", "fam", "giv", "n").unionByName(best)
    spellings = cut(chosen.withColumn("node", F.xxhash64("fam", F.array_join("giv", " "))))
    nodes = spellings.groupBy("node", "fam", "giv").agg(F.sum("n").alias("support"))
    return rows.select("id", "sid"), spellings.select("sid", "node"), nodes


def information(given: Column) -> Column:
    """How much a spelling tells of the given names: full words count for more than initials."""
    return F.aggregate(given, F.lit(0), lambda n, w: n + F.when(F.length(w) > 1, 10).otherwise(1))


def _initials(given: Column) -> Column:
    return F.array_join(F.transform(given, lambda w: F.regexp_replace(w, r"-?([^-])[^-]*", "$1")), "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def similar_names(pairs: DataFrame) -> DataFrame:
    """The pairs of names _a and _b that may be one person's, with their similarity by family and by given names.

    Columns fam, giv, forms with _a and _b. A family is equal (1), sounds equal (0.97), or has one (0.9) or two errors
    (0.8). Given words are aligned in order; later words may be left out, words be initials (0.6), short forms or
    beginnings (0.95), have an error (0.9), or names be written apart (0.9).
    """
    read = _once(pairs, sa=sound(F.col("fam_a")), sb=sound(F.col("fam_b")))
    sa, sb = F.col("sa"), F.col("sb")
    long = F.least(F.length(sa), F.length(sb)) >= LONG_WORD
    family = F.when(F.col("fam_a") == F.col("fam_b"), 1.0).when(sa == sb, 0.97).when(one_error(sa, sb, SHORT_WORD), 0.9).when(two_errors(sa, sb, LONG_WORD) | (long & exchanged_and_one_error(sa, sb)), 0.8)
    near = _once(read, family=family).where("family is not null")

    ga, gb = F.col("giv_a"), F.col("giv_b")
    whole = lambda g: _bare(F.array_join(g, ""))
    told = _once(near, wa=whole(ga), wb=whole(gb), ia=_initials(ga), ib=_initials(gb), ha=_bare(F.element_at(ga, 1)), hb=_bare(F.element_at(gb, 1)), words=F.least(F.size(ga), F.size(gb)))
    whole_a, whole_b, ia, ib, first_a, first_b, n = (F.col(c) for c in ("wa", "wb", "ia", "ib", "ha", "hb", "words"))
    only = F.forall(ga, lambda w: F.length(w) == 1) | F.forall(gb, lambda w: F.length(w) == 1)
    none = F.array().cast("array<string>")
    forms_a, forms_b = F.coalesce("forms_a", none), F.coalesce("forms_b", none)
    nick = F.array_contains(forms_a, first_b) | F.array_contains(forms_b, first_a) | F.arrays_overlap(forms_a, forms_b)

    def word(x: Column, y: Column) -> Column:
        short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        begins = (short >= 3) & (long - short >= 2) & (F.startswith(x, y) | F.startswith(y, x))
        return (
            F.when(x == y, 1.0)
            .when((short == 1) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)), 0.6)
            .when(short == 1, 0.0)
            .when((x == first_a) & (y == first_b) & nick, 0.95)
            .when(begins, 0.95)
            .when(one_error(x, y, SHORT_GIVEN), 0.9)
            .otherwise(0.0)
        )

    bare = lambda g: F.transform(F.slice(g, F.lit(1), n), _bare)
    aligned = _once(told, sims=F.zip_with(bare(ga), bare(gb), word))
    apart = lambda g, all_, h: (F.size(g) > 1) & (F.length(F.element_at(g, 1)) < 3) & (F.length(h) > 2) & F.startswith(all_, h)
    given = (
        F.when(only, F.when(F.startswith(ia, ib) | F.startswith(ib, ia), 0.6))
        .when(F.array_min("sims") > 0, F.aggregate("sims", F.lit(0.0), lambda t, x: t + x) / n)
        .when(one_error(whole_a, whole_b, SHORT_GIVEN) | apart(ga, whole_a, first_b) | apart(gb, whole_b, first_a), 0.9)
    )
    # two errors in the family need given names that agree word by word
    agree = (F.col("given") >= 0.9) & ((F.size(ga) == F.size(gb)) | (whole_a == whole_b))
    return _once(aligned, given=given).where(F.col("given").isNotNull() & ((F.col("family") >= 0.9) | agree)).drop("sa", "sb", "wa", "wb", "ia", "ib", "ha", "hb", "words", "sims")


def name_links(nodes: DataFrame, forms: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, score, ia, ib, sa, sb, ua, ub) both ways: nodes that may name one person, what they tell, their support, and how usual their words are."""
    base = nodes.withColumns({"sound": sound(F.col("fam")), "first": _bare(F.element_at("giv", 1)), "whole": _bare(F.array_join("giv", ""))})
    words = word_table(base, forms)
    total = F.lit(float(max(2, nodes.count())))
    none = F.array().cast("array<string>")
    fams = words.where("kind = 'f'").select(F.col("word").alias("sound"), F.log(total / F.col("df") + 1).alias("wf"), F.col("bigs").alias("fs"))
    given = words.where("kind = 'g'")
    firsts = given.select(F.col("word").alias("first"), F.log(total / F.col("df") + 1).alias("wg"), F.col("bigs").alias("gs"), "forms")
    known = base.join(fams, "sound").join(firsts, "first")
    one = known.where("first = whole").withColumn("ws", none)
    more = known.where("first <> whole").join(given.select(F.col("word").alias("whole"), F.col("bigs").alias("ws")), "whole")
    heavy = cut(one.unionByName(more).select("node", "fam", "giv", "support", "wf", "wg", "forms", "fs", "first", F.array_distinct(F.concat("gs", "ws")).alias("gs")))

    single = F.length("first") == 1
    letter = F.substring("first", 1, 1)
    by_word = F.when(single, F.filter("gs", lambda g: F.length(g) > 1)).otherwise(F.col("gs"))
    tagged = lambda tag, x: F.concat(F.lit(tag), x)
    left_keys = F.concat(F.transform(by_word, lambda g: tagged("T", g)), F.when(single, F.array(tagged("F", letter), tagged("I", letter))).otherwise(none))
    right_keys = F.concat(F.transform(by_word, lambda g: tagged("T", g)), F.when(single, F.array(tagged("I", letter))).otherwise(F.array(tagged("F", letter))))

    def side(keys: Column, x: str) -> DataFrame:
        each = F.flatten(F.transform("fs", lambda f: F.transform(keys, lambda k: F.struct(F.xxhash64(f, k).alias("key"), F.startswith(k, F.lit("F")).alias("fuller")))))
        rows = heavy.select("node", "fam", "giv", "support", "wf", "wg", "forms", F.inline(F.array_distinct(each)))
        return rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "fam", "giv", "support", "wf", "wg", "forms", "fuller")))

    left, right = side(left_keys, "a"), side(right_keys, "b")
    met = left.join(right, "key").where("fuller_a = fuller_b and (fuller_a and node_a <> node_b or node_a < node_b)")
    verified = similar_names(met)
    wf, wg = F.least("wf_a", "wf_b"), F.least("wg_a", "wg_b")
    verified = verified.withColumns({f"usual_{x}": -F.col(f"wf_{x}") - F.col(f"wg_{x}") for x in "ab"})
    scored = verified.withColumn("score", ((wf * F.col("family") + wg * F.col("given")) / (wf + wg) * 1000).cast("int")).where(F.col("score") >= int(threshold * 1000))
    ways = F.array(*(F.struct(*(F.col(f"{c}_{x}").alias(n + y) for x, y in zip(order, "ab") for c, n in (("node", ""), ("support", "s"), ("usual", "u"))), *(information(F.col(f"giv_{x}")).alias("i" + y) for x, y in zip(order, "ab"))) for order in ("ab", "ba")))
    return cut(scored.select("score", F.inline(ways)).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("score", "ia", "ib", "sa", "sb", "ua", "ub"))))


def persons(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, person): each node points at its best link of more information, support or usual words; the pointers' roots are the persons.

    A spelling that tells less than its partners (initials, no middle name) follows them only if they
    agree with each other: all must be linked to the best supported of them. Otherwise it stays apart.
    """
    rank = F.struct("sb", "ub", "score", "b")
    fuller = F.col("ib") > F.col("ia")
    peer = (F.col("ib") == F.col("ia")) & (F.struct("sb", "ub", "b") > F.struct("sa", "ua", "a"))
    best = links.groupBy("a").agg(F.max_by("b", F.when(fuller, rank)).alias("hub"), F.count_if(fuller).alias("k"), F.max_by("b", F.when(peer, rank)).alias("peer"))
    others = links.where(fuller).select("a", "b").join(best.where("k > 1").select("a", "hub"), "a").where("b <> hub")
    agreeing = others.join(links.select(F.col("a").alias("b"), F.col("b").alias("hub")), ["b", "hub"], "left_semi").groupBy("a").agg(F.count("*").alias("ok"))
    clear = F.coalesce("ok", F.lit(0)) == F.col("k") - 1
    up = best.join(agreeing, "a", "left").select("a", F.coalesce(F.when(clear, F.col("hub")), "peer", "a").alias("top")).where("a <> top")
    state = cut(up)
    while not state.isEmpty():  # the pointers rise strictly, so their jumps double and end
        jump = state.select(F.col("a").alias("top"), F.col("top").alias("next"))
        new = cut(state.join(jump, "top", "left").select("a", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")))
        state = new.select("a", "top")
        if new.where("moved").isEmpty():
            break
    return nodes.select("node").join(state.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("top", "node").alias("person"))


def author_persons(authors: DataFrame, nicknames: DataFrame) -> DataFrame:
    """id, sid, person: every author row with a readable name, its spelling and the person it names.

    ``nicknames`` is a list (given, nickname) of short forms. ``identifier`` only teaches short forms; it neither makes nor
    forbids a link. Rows without any name, groups that have only a collective name, and names without a family word are
    in no class. Repeated rows count once.
    """
    keyed, spellings, nodes = name_nodes(authors)
    nodes = cut(nodes)
    oid = F.regexp_extract(F.coalesce("identifier", F.lit("")), r"([0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{3}[0-9Xx])", 1)
    sid = F.xxhash64(F.to_json(F.struct("given", "family", "initials"))).alias("sid")
    told = authors.where("identifier is not null").select(F.upper(F.regexp_replace(F.nullif(oid, F.lit("")), "-", "")).alias("oid"), sid).where("oid is not null").distinct()
    rows = told.join(spellings, "sid").join(nodes, "node").select("oid", "fam", F.element_at("giv", 1).alias("g1"))
    links = name_links(nodes, cut(short_forms(nicknames, rows)))
    people = spellings.join(persons(nodes, links), "node").select("sid", "person")
    return keyed.join(people, "sid").select("id", "sid", "person")


def variant_pairs(members: DataFrame) -> DataFrame:
    """author_id_a, author_id_b (a < b): rows of one person whose spellings differ; rows of equal spelling are no pair."""
    members = cut(members)
    spelled = members.select("sid", "person").distinct()
    meets = spelled.join(spelled.withColumnRenamed("sid", "sid_b"), "person").where("sid < sid_b").select("sid", "sid_b")
    left = members.select("sid", F.col("id").alias("x")).join(meets, "sid")
    right = members.select(F.col("sid").alias("sid_b"), F.col("id").alias("y"))
    pairs = left.join(right, "sid_b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("author_id_a"), F.greatest("x", "y").alias("author_id_b")).distinct()
