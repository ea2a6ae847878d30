"""Visually identical text with different characters: one consistent form, made by DuckDB inside Arrow partitions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import cut

# Characters of other scripts, and signs, whose usual shape is that of a Latin letter or an ASCII sign. Letters that
# are only alike (Greek alpha and a, minus and hyphen) are left as they are: a reader can tell them apart.
LOOKALIKES = {
    "аеорсухіѕјһԁԛԝӏ": "aeopcyxisjhdqwl",
    "АВЕКМНОРСТХІЅЈУԌԚԜ": "ABEKMHOPCTXISJYGQW",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳͿρν": "ABEZHIKMNOPTYXocjJpv",
    "օսհոՕՏ": "ouhnOS",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHGZRWSVSLCPKB",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    "ⲟⲣⲥⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ": "opcHIKMNOPCTYX",
    "ᴄᴏꜱᴜᴠᴡᴢ": "cosuvwz",
    "ɡɑ∶‐‑∕⁄∣∗ǃ": "ga:--//|*!",
}
# Ranges of characters without a mark of their own.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0d\ufeff\uffa0\ufff9-\ufffb"
# Scripts whose letters join differently beside a joiner, so that it shows there.
SHAPING = ("Arabic", "Bengali", "Devanagari", "Gujarati", "Gurmukhi", "Kannada", "Khmer", "Malayalam", "Mongolian", "Myanmar", "Oriya", "Sinhala", "Syriac", "Tamil", "Telugu", "Tibetan")
LOOKS_EQUAL = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}


@cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate``, and the characters that fold to several, derived from the Unicode data.

    Folded are compatibility forms that look like their plain form: full and half width, ligatures,
    letters used as numerals, presentation forms. Super- and subscripts, circled, styled and square forms
    look different and stay. Letters composed of a look-alike and accents fold to the composed plain letter.
    """
    base = {a: b for keys, values in LOOKALIKES.items() for a, b in zip(keys, values)}
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or unicodedata.normalize("NFC", c) != c:
            continue  # canonical equivalents are left to nfc_normalize
        kind, _, _ = unicodedata.decomposition(c).partition("> ")
        text = c
        if unicodedata.category(c) == "Zs":
            text = " "
        elif kind + ">" in LOOKS_EQUAL:
            text = unicodedata.normalize("NFKC", c)
            if text.startswith(" "):
                continue  # spacing accents
        text = unicodedata.normalize("NFC", "".join(base.get(x, x) for x in unicodedata.normalize("NFD", text)))
        if text == c:
            continue
        if len(text) == 1:
            one[c] = text
        elif unicodedata.category(c) in ("Ll", "Lu", "Lt", "Nl") or c in "\u2025\u2026":
            several[c] = text
    return "".join(one), "".join(one.values()), several


def fold_sql(relation: str, key: str = "doc_id", column: str = "text") -> str:
    """DuckDB SQL that gives (key, form) of a relation: the consistent form of its text.

    Line ends become line feeds, invisible characters go, spaces of every width become the ordinary
    space, compatibility forms and look-alikes become plain letters, and accents are composed. The number
    of spaces and lines, case, accents, digits and words stay. Null stays null.
    """

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def sub(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"

    source, target, several = fold_tables()
    shaped = "".join(rf"\p{{{s}}}" for s in SHAPING)
    clean = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    clean = sub(clean, f"[{INVISIBLE}]+", "")
    clean = sub(clean, "(^|[^\\p{So}\\p{Sk}0-9#*])[\ufe0e\ufe0f]+", r"\1")
    # joiners that show are set aside as private characters, applied twice as matches may not overlap
    for _ in range(2):
        clean = sub(clean, "([\\p{So}\\p{Sk}\ufe0f])\u200d([\\p{So}])", "\\1\ue000\\2")
        clean = sub(clean, f"([{shaped}])\u200d([{shaped}])", "\\1\ue000\\2")
        clean = sub(clean, f"([{shaped}])\u200c([{shaped}])", "\\1\ue001\\2")
    clean = sub(clean, "[\u200c\u200d]+", "")
    clean = f"translate({clean}, '\ue000\ue001', '\u200d\u200c')"
    wide = "y"
    for a, b in several.items():
        wide = f"replace({wide}, {quote(a)}, {quote(b)})"
    plain = f"not regexp_matches({{}}, {quote('[^\\x00-\\x7f]')})"
    return f"""
        select {key}, case when {plain.format('z')} then z else nfc_normalize(translate(nfc_normalize(z), {quote(source)}, {quote(target)})) end as form from (
        select {key}, case when regexp_matches(y, {quote('[' + ''.join(several) + ']')}) then {wide} else y end as z from (
        select {key}, case when {plain.format(column)} then replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) else {clean} end as y from {relation}))"""


def consistent_form(documents: DataFrame, batch_rows: int = 2_000) -> DataFrame:
    """doc_id, text, form of every document; null texts have a null form. DuckDB runs on the Arrow batches of each partition."""
    import pyarrow as pa

    sql = fold_sql("batch", "n") + " order by n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            for at in range(0, b.num_rows, batch_rows):
                part = b.slice(at, batch_rows)
                batch = pa.table({"n": pa.array(range(part.num_rows), pa.int64()), "text": part.column(1)})
                con.register("batch", batch)
                forms = con.sql(sql).to_arrow_table().column("form").combine_chunks()
                con.unregister("batch")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), forms.cast(pa.string())], names=["doc_id", "text", "form"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, form string")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b (a < b): texts that look the same but are not equal code point by code point.

    Null, empty and blank texts are in no pair. A repeated row of equal id and text counts once. Pairs of
    equal texts are never made: the distinct texts of a form meet first, and only the members of two
    different texts are joined; the rows shuffled are ids and hashes, and a text that many documents share
    is split by the adaptive skew join.
    """
    visible = F.length(F.regexp_replace("form", r"[\s\p{Cc}]+", "")) > 0
    hashed = consistent_form(documents).where(visible).select("doc_id", F.md5("form").alias("form"), F.md5("text").alias("variant"))
    members = cut(hashed.distinct())
    variants = members.groupBy("form", "variant").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    texts = variants.join(several, "form", "left_semi").select("form", "variant")
    other = texts.select("form", F.col("variant").alias("variant_b"))
    meets = texts.join(other, "form").where("variant < variant_b")
    left = members.join(meets, ["form", "variant"]).select(F.col("doc_id").alias("x"), "form", "variant_b")
    right = members.select(F.col("doc_id").alias("y"), "form", F.col("variant").alias("variant_b"))
    pairs = left.join(right, ["form", "variant_b"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, links: every document with a visible text, the smallest id that looks like it, and how many look alike but differ.

    Copies count each in ``links`` of the others; documents of equal text are no links. A document that nothing looks like is its
    own class with 0 links.
    """
    visible = F.length(F.regexp_replace("form", r"[\s\p{Cc}]+", "")) > 0
    members = cut(consistent_form(documents).where(visible).select("doc_id", F.md5("form").alias("form"), F.md5("text").alias("variant")).distinct())
    variants = members.groupBy("form", "variant").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first"))
    forms = variants.groupBy("form").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"))
    of = variants.join(forms, "form").select("form", "variant", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return members.join(of, ["form", "variant"]).select("doc_id", "class_id", "links")
