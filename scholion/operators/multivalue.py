"""Several values packed in one field: expectation-maximisation segmentation with Viterbi decoding.

A field is a sequence of words parted by blanks and by *candidate* delimiters. Whether a candidate parts
two values is hidden. The column itself tells how values begin and end: the first and last word of every
field are a sure begin and end, words parted by a plain blank are surely inside. From these counts, taken
over the whole column, EM learns for each written form of a delimiter how often it parts, and how values
begin, end and go on around candidates. Each field is then a lattice over its candidates, and Viterbi takes
the likeliest split, in which a model of value lengths joins the choices. The values of these splits are counted over
the whole column, and in the next round a span that is a frequent value is the likelier for it, whole or as a part (EM in
its hard form). Quoted spans are atomic words.

Words and values are not limited in number: what the column tells of them stays in tables, which are joined to the candidates and
spans of the fields. The driver holds the counts of EM only while they are few (EM_COUNTS); more stay in tables as well.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.session import cut

#: Candidates in prose: tabs, bars, slashes, semicolons, commas, spaced dashes. In codes also plain blanks.
PROSE = r"\s*(?:[\t;|,/]\s*)+|\s+[-–—·•]\s+"
CODES = r"\s*(?:[\t;|,/]\s*)+|\s+"
MAX_LENGTH = 64
QUOTED = "<quoted>"

_ENTITY = re.compile(r"&#?\w{1,31};")
_SPAN = re.compile(r'"((?:[^"\\]|""|\\.)*)"')


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word)
    s = re.sub(r"\d+", "9", s)
    return "~" + re.sub(r"(.)\1+", r"\1", s)[:8]


def _form(delimiter: str) -> str:
    """The written form of a delimiter: its distinct marks and whether blanks stand around it."""
    marks = "".join(dict.fromkeys(re.sub(r"[^\S\t]", "", delimiter)))
    if not marks:
        return " "
    return (" " if delimiter[0] in "  " else "") + marks + (" " if delimiter[-1] in "  " else "")


@dataclass
class Field:
    """The words of a field, the form of the delimiter before each (None: a plain blank), and the raw text they cover."""

    words: list[str] = field(default_factory=list)
    forms: list[str | None] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    text: str = ""
    brackets: bool = False


def read_field(text: str, delimiters: re.Pattern) -> Field:
    text = text.strip()
    out = Field(text=text)
    if text.startswith("[") and text.endswith("]"):
        out.brackets, text = True, text[1:-1].strip()
        out.text = text
    hidden = _ENTITY.sub(lambda m: m[0][:-1] + "\0", text)  # the semicolon of an entity is no delimiter
    at, form, n = 0, None, len(text)
    if m := delimiters.match(hidden):
        at = m.end()
    slot_start = True
    while at < n:
        if slot_start and hidden[at] == '"' and (q := _SPAN.match(hidden, at)):
            rest = delimiters.match(hidden, q.end())
            if q.end() == n or (rest and _form(rest[0]) != " ") or (rest and rest.end() == n):
                out.words.append(QUOTED)
                out.forms.append(form)
                out.spans.append((at, q.end()))
                at, form = (rest.end(), _form(rest[0])) if rest else (n, None)
                continue
        d = delimiters.search(hidden, at)
        end = d.start() if d else n
        if end > at:
            first = True
            for w in re.finditer(r"\S+", hidden[at:end]):
                out.words.append(w[0])
                out.forms.append(form if first else None)
                out.spans.append((at + w.start(), at + w.end()))
                first = False
        if not d:
            break
        at, form, slot_start = d.end(), _form(d[0]), True
    if out.forms:
        out.forms[0] = None
    return out


def _nodes(f: Field) -> list[int]:
    """The words before which a value may begin, and the end."""
    n = len(f.words)
    return [0, *(k for k in range(1, n) if f.forms[k] is not None), n]


def _text(f: Field, a: int, b: int) -> str:
    return f.text[f.spans[a][0] : f.spans[b - 1][1]]


#: What a kind of word counts that was not seen so.
UNSEEN = {"begin": 0.01, "end": 0.01, "left": 0.5, "right": 0.5}


class Segmenter:
    """EM over the counts of kinds of words, then Viterbi for each field. What is known of the words and of frequent values is held here, or
    given with the field."""

    def __init__(self, vocabulary: set[str], delimiters: str):
        self.vocabulary, self.delimiters = vocabulary, re.compile(delimiters)
        self.part: dict[str, float] = {}
        self.tables: dict[str, dict[str, float]] = {}
        self.length: list[float] = [0.0] * (MAX_LENGTH + 1)
        self.values: dict[str, float] = {}

    def kind(self, word: str) -> str:
        return word if word == QUOTED or word in self.vocabulary else _shape(word)

    def count(self, texts: list[str | None], kind=None) -> Counter:
        """Sufficient statistics: begins, ends, insides, lengths, and candidates by (form, left kind, right kind)."""
        kind = kind or self.kind
        got: Counter = Counter()
        for t in texts:
            f = read_field(t or "", self.delimiters)
            if not f.words:
                continue
            kinds = [kind(w) for w in f.words]
            got["begin", "", "", kinds[0]] += 1
            got["end", "", kinds[-1], ""] += 1
            for k in range(1, len(kinds)):
                if f.forms[k] is None:
                    got["right", "", "", kinds[k]] += 1
                    got["left", "", kinds[k - 1], ""] += 1
                else:
                    got["candidate", f.forms[k], kinds[k - 1], kinds[k]] += 1
            if not any(f.forms):
                got["length", str(min(MAX_LENGTH, len(kinds))), "", ""] += 1
        return got

    def learn(self, counts: dict[tuple[str, str, str, str], int], rounds: int = 30) -> Segmenter:
        sure = {name: Counter() for name in ("begin", "end", "left", "right")}
        candidates, kinds = [], {QUOTED}
        for (what, form, left, right), n in sorted(counts.items()):
            if what == "candidate":
                candidates.append((form, left, right, n))
                kinds |= {left, right}
            elif what == "length":
                self.length[int(form)] += n
            else:
                sure[what][left or right] += n
                kinds.add(left or right)
        self._lengths()
        words = sum(sum(v.values()) for v in sure.values()) + 2 * sum(n for *_, n in candidates) + 1

        def probabilities(counts: dict[str, Counter]) -> dict[str, dict[str, float]]:
            out = {}
            for name, c in counts.items():
                base = sum(c.values()) if name in ("begin", "end") else words
                out[name] = {k: (c.get(k, 0) + UNSEEN[name]) / (base + 1) for k in ("", *kinds)}
            return out

        # how values begin and end is told by the fields' own ends, which EM must not talk itself out of;
        # the forms of the delimiters, and what stands around those that do not part, are learned
        part = {form: 0.5 for form, *_ in candidates}
        p = probabilities(sure)
        for _ in range(rounds):
            inside = {k: Counter(v) for k, v in sure.items()}
            hits, all_ = Counter(), Counter()
            for form, left, right, n in candidates:
                yes = part[form] * p["end"][left] * p["begin"][right]
                no = (1 - part[form]) * p["left"][left] * p["right"][right]
                g = yes / (yes + no)
                hits[form] += g * n
                all_[form] += n
                inside["left"][left] += (1 - g) * n
                inside["right"][right] += (1 - g) * n
            part = {form: (hits[form] + 0.5) / (all_[form] + 1) for form in part}
            p = probabilities(inside)
        self.part = part
        self.tables = {name: {k: log(x) for k, x in t.items()} for name, t in p.items()}
        return self

    def _lengths(self) -> None:
        total = sum(self.length)
        self.length = [log((x + 0.5) / (total + 0.5 * len(self.length))) for x in self.length]

    def _score(self, name: str, kind: str) -> float:
        t = self.tables[name]
        return t.get(kind, t[""])

    def learn_values(self, counts: dict[str, int]) -> Segmenter:
        """Takes how often values occur in the column's likeliest splits; a span's own occurrence says nothing of it."""
        self.values = {v: log(n) for v, n in counts.items() if n > 1}
        return self

    def _gain(self, f: Field, k: int) -> float:
        """What the model of words gives a cut before word k."""
        part, left, right = self.part.get(f.forms[k], 0.5), self.kind(f.words[k - 1]), self.kind(f.words[k])
        return log(part) - log(1 - part) + self._score("end", left) + self._score("begin", right) - self._score("left", left) - self._score("right", right)

    def _cuts(self, f: Field, gains: dict[int, float] | None = None, values: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int]]:
        """The words of each value in the likeliest split of a field. ``gains`` of cuts and counts of frequent ``values`` by their words
        are taken in place of the model's own."""
        n = len(f.words)
        nodes = _nodes(f)
        gain = [0.0, *(self._gain(f, k) if gains is None else gains[k] for k in nodes[1:-1]), 0.0]
        best, back = [0.0] + [float("-inf")] * (len(nodes) - 1), [0] * len(nodes)
        starts, ends = [f.spans[k][0] for k in nodes[:-1]], [0, *(f.spans[k - 1][1] for k in nodes[1:])]
        frequent = self.values.get if self.values else None
        given = {at: log(c) for at, c in values.items()} if values else None
        long_: dict[int, list[tuple[int, float]]] = {}  # by their end, the frequent values of MAX_LENGTH words or more
        for (at, to), c in (values or {}).items():
            if to - at >= MAX_LENGTH:
                long_.setdefault(to, []).append((bisect_left(nodes, at), log(c)))
        far, reach = 0, 0  # the best of the nodes before reach, from which a value to j has MAX_LENGTH words or more
        for j in range(1, len(nodes)):
            while nodes[j] - nodes[reach] >= MAX_LENGTH:
                if best[reach] >= best[far]:
                    far = reach
                reach += 1
            for i in range(j - 1, reach - 1, -1):
                s = best[i] + self.length[nodes[j] - nodes[i]] + gain[j]
                if frequent:
                    s += frequent(f.text[starts[i] : ends[j]], 0.0)
                if given:
                    s += given.get((nodes[i], nodes[j]), 0.0)
                if s > best[j]:
                    best[j], back[j] = s, i
            if reach:  # values of MAX_LENGTH words and more all have the same score
                s = best[far] + self.length[MAX_LENGTH] + gain[j]
                if s > best[j]:
                    best[j], back[j] = s, far
            more = [(i, c) for i in range(reach) if (c := frequent(f.text[starts[i] : ends[j]]))] if frequent else []
            for i, c in [*long_.get(nodes[j], ()), *more]:
                s = best[i] + self.length[MAX_LENGTH] + gain[j] + c
                if s > best[j]:
                    best[j], back[j] = s, i
        cuts, j = [], len(nodes) - 1
        while j:
            cuts.append((nodes[back[j]], nodes[j]))
            j = back[j]
        return cuts[::-1]

    def spans(self, text: str | None, gains: dict[int, float] | None = None) -> list[str]:
        """The values of the likeliest split as they stand in the field."""
        f = read_field(text or "", self.delimiters)
        return [_text(f, a, b) for a, b in self._cuts(f, gains)] if f.words else []

    def split(self, text: str | None, gains: dict[int, float] | None = None, values: dict[tuple[int, int], int] | None = None) -> list[str]:
        """The values of a field, in order, without quoting and outer blanks."""
        f = read_field(text or "", self.delimiters)
        return [v for a, b in self._cuts(f, gains, values) if (v := self._value(f, a, b))] if f.words else []

    @staticmethod
    def _value(f: Field, a: int, b: int) -> str:
        raw = f.text[f.spans[a][0] : f.spans[b - 1][1]].strip()
        if b - a == 1 and f.words[a] == QUOTED:
            if f.brackets:
                try:
                    return str(json.loads(raw)).strip()
                except ValueError:
                    pass
            return raw[1:-1].replace('""', '"').replace('\\"', '"').strip()
        return raw


#: So many counts of kinds of words go to the driver for EM; more are kept in tables, with the same result.
EM_COUNTS = 100_000
#: The letters that a value of MAX_LENGTH words has at least.
LONG = 2 * MAX_LENGTH - 1
#: Counts that a task gathers before it gives them on.
HELD = 500_000


def may_part(column: str, delimiters: str) -> Column:
    """Whether a field holds a candidate delimiter; one that holds none is one value."""
    return F.col(column).rlike("(?U)" + delimiters)


def _learn_tables(spark, counts: DataFrame, rounds: int = 30) -> tuple[dict[str, float], dict[str, float], DataFrame]:
    """``Segmenter.learn`` in tables: part by form, and (kind, begin, end, left, right) as logs; before these, what a kind has that was not seen."""
    sure = counts.where(F.col("what").isin(*UNSEEN)).select(F.concat("l", "r").alias("kind"), "what", "n")
    seen = counts.where("what = 'candidate'").select("form", "l", "r", "n")
    of = seen.select(F.col("l").alias("kind")).unionByName(seen.select(F.col("r").alias("kind"))).withColumns({"what": F.lit("none"), "n": F.lit(0)})
    kinds = cut(sure.unionByName(of).groupBy("kind").agg(*(F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).cast("double").alias(w) for w in UNSEEN)))
    totals = kinds.agg(*(F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in UNSEEN)).first()
    words = sum(totals) + 2 * (seen.agg(F.sum("n")).first()[0] or 0) + 1
    base = {w: (totals[w] if w in ("begin", "end") else words) + 1 for w in UNSEEN}
    p = {w: (F.col(w) + UNSEEN[w]) / base[w] for w in UNSEEN}
    left = kinds.select(F.col("kind").alias("l"), p["end"].alias("end"), F.col("left").alias("sure_l"))
    right = kinds.select(F.col("kind").alias("r"), p["begin"].alias("begin"), F.col("right").alias("sure_r"))
    step = cut(seen.join(left, "l").join(right, "r").withColumn("stays", F.lit(0.0)))
    part: dict[str, float] = {}
    for _ in range(rounds):
        share = F.element_at(F.create_map(*(F.lit(x) for fp in part.items() for x in fp)), F.col("form")) if part else F.lit(0.5)
        yes = share * F.col("end") * F.col("begin")
        inside = lambda k: (F.col("sure_" + k) + F.sum("stays").over(Window.partitionBy(k)) + 0.5) / (words + 1)
        no = (1 - share) * inside("l") * inside("r")
        step = cut(step.withColumn("stays", F.col("n") * no / (yes + no)))
        part = {r.form: (r.all - r.stays + 0.5) / (r.all + 1) for r in step.groupBy("form").agg(F.sum("n").alias("all"), F.sum("stays").alias("stays")).collect()}
    stay = lambda k, w: step.groupBy(F.col(k).alias("kind")).agg(F.sum("stays").alias("more_" + w))
    got = kinds.join(stay("l", "left"), "kind", "left").join(stay("r", "right"), "kind", "left")
    got = got.withColumns({w: F.col(w) + F.coalesce("more_" + w, F.lit(0.0)) for w in ("left", "right")})
    return part, {w: log(UNSEEN[w] / base[w]) for w in UNSEEN}, cut(got.select("kind", *(F.log(x).alias(w) for w, x in p.items())))


class _Lookup:
    """The logs of the counts of a column's frequent values, by value."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def of(self, values: list[str]) -> dict[str, float]:
        return {r.v: log(r.n) for r in self.frame.where(F.col("v").isin(*values)).collect()} if values else {}

    def __contains__(self, value: str) -> bool:
        return value in self.of([value])

    def __getitem__(self, value: str) -> float:
        return self.of([value])[value]


@dataclass
class ColumnModel:
    """What a column tells of words and values. ``words``: (w, kind, begin, end, left, right) of its words; ``fields``: (id, v, n, gains) of
    its distinct fields with a candidate; ``spans``: (id, at, to, h) of theirs, with to -1 and the h of its first LONG letters for what may
    begin a value of MAX_LENGTH words or more; ``frequent``: (v, n) of all values that occur twice or more."""

    delimiters: str
    part: dict[str, float]
    unseen: dict[str, float]
    length: list[float]
    words: DataFrame
    fields: DataFrame
    spans: DataFrame
    frequent: DataFrame

    @property
    def values(self) -> _Lookup:
        return _Lookup(self.frequent)

    def split(self, text: str | None) -> list[str]:
        """The values of any field."""
        f = read_field(text or "", re.compile(self.delimiters))
        if not f.words:
            return []
        known = {r.w: r for r in self.words.where(F.col("w").isin(*f.words)).collect()}
        nodes = _nodes(f)
        model = Segmenter({w for w, r in known.items() if r.kind == w}, self.delimiters)
        kinds = {model.kind(w) for w in f.words}
        tables = self.words.where(F.col("kind").isin(*kinds)).select("kind", *UNSEEN).distinct().collect()
        model.part, model.length = self.part, self.length
        model.tables = {w: {"": self.unseen[w], **{r.kind: r[w] for r in tables}} for w in UNSEEN}
        model.values = self.values.of([_text(f, nodes[i], nodes[j]) for j in range(len(nodes)) for i in range(j)])
        return model.split(text)


def learn_column(df: DataFrame, column: str, delimiters: str) -> ColumnModel:
    """Learns from every row of a column; words count by themselves if they occur five times or more, else by their shape.

    Fields without a delimiter are counted as they are, in the JVM. Fields and spans are told by their md5.
    """
    import pyarrow as pa

    spark = df.sparkSession
    values = df.select(F.col(column).alias("v")).where("v is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(total: Counter) -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([total[k] for k in keys], pa.int64())], names=["what", "form", "l", "r", "n"])

        seg, total = Segmenter(set(), delimiters), Counter()
        for b in batches:
            total.update(seg.count(b.column(0).to_pylist(), lambda w: w))
            if len(total) > HELD:
                yield give(total)
                total = Counter()
        yield give(total)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w if w == QUOTED else _shape(w) for w in words], pa.string()), pa.array([any(c.isdigit() for c in w) for w in words], pa.bool_())], names=["w", "shape", "digits"])

    counts = cut(values.mapInArrow(count, "what string, form string, l string, r string, n long").groupBy("what", "form", "l", "r").agg(F.sum("n").alias("n")))
    often = values.select(F.explode(F.split("v", r"\s+")).alias("w")).groupBy("w").count().where("count > 4").select("w", F.lit(True).alias("often"))
    words = counts.select(F.explode(F.array("l", "r")).alias("w")).where("w <> ''").distinct().mapInArrow(shapes, "w string, shape string, digits boolean")
    kinds = cut(words.join(often.hint("merge"), "w", "left").select("w", F.when(F.col("often") & ~F.col("digits"), F.col("w")).otherwise(F.col("shape")).alias("kind")))

    side = lambda k: kinds.select(F.col("w").alias(k), F.col("kind").alias("kind_" + k)).hint("merge")
    by_kind = counts.where("what <> 'length'").join(side("l"), "l", "left").join(side("r"), "r", "left").groupBy("what", "form", F.coalesce("kind_l", F.lit("")).alias("l"), F.coalesce("kind_r", F.lit("")).alias("r")).agg(F.sum("n").alias("n"))
    by_kind = cut(by_kind)
    model = Segmenter(set(), delimiters)
    if by_kind.count() <= EM_COUNTS:
        model.learn({(r.what, r.form, r.l, r.r): r.n for r in by_kind.collect()})
        part, unseen = model.part, {w: model.tables[w][""] for w in UNSEEN}
        rows = [(k, *(model.tables[w][k] for w in UNSEEN)) for k in model.tables["begin"] if k]
        tables = spark.createDataFrame(rows, "kind string, " + ", ".join(f"`{w}` double" for w in UNSEEN))
        model.length = [0.0] * (MAX_LENGTH + 1)
    else:
        part, unseen, tables = _learn_tables(spark, by_kind)
    for r in counts.where("what = 'length'").collect():  # at most MAX_LENGTH rows
        model.length[int(r.form)] += r.n
    model._lengths()
    model.part, model.tables = part, {}
    told = cut(kinds.join(tables.hint("merge"), "kind").select("w", "kind", *UNSEEN))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["id", "at", "to", "form", "l", "r", "h"])

        types, pattern = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()], re.compile(delimiters)
        for b in batches:
            out: list[tuple] = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = read_field(text, pattern)
                nodes = _nodes(f) if f.words else []
                out += [(id_, k, None, f.forms[k], f.words[k - 1], f.words[k], None) for k in nodes[1:-1]]
                out += [(id_, k, -1, None, None, None, _md5(f.text[f.spans[k][0] :][:LONG])) for k in nodes[:-1] if nodes[-1] - k >= MAX_LENGTH]
                reach = 0
                for j in range(1, len(nodes)):
                    while nodes[j] - nodes[reach] >= MAX_LENGTH:
                        reach += 1
                    out += [(id_, nodes[i], nodes[j], None, None, None, _md5(_text(f, nodes[i], nodes[j]))) for i in range(reach, j)]
                    if len(out) > HELD:
                        yield give()
                        out = []
            yield give()

    marked = may_part("v", delimiters)
    fields = cut(values.where(marked).groupBy("v").agg(F.count("*").alias("n")).select(F.unhex(F.md5("v")).alias("id"), "v", "n"))
    lattice = cut(fields.select("id", "v").mapInArrow(candidates, "id binary, at int, to int, form string, l string, r string, h binary"))
    log_odds = F.element_at(F.create_map(*(F.lit(x) for form, y in part.items() for x in (form, log(y) - log(1 - y)))), F.col("form")) if part else F.lit(0.0)
    scores = lambda k, *of: told.select(F.col("w").alias(k), *(F.col(w).alias(f"{w}_{k}") for w in of)).hint("merge")
    gains = counts.where("what = 'candidate'").join(scores("l", "end", "left"), "l").join(scores("r", "begin", "right"), "r")
    gains = gains.select("form", "l", "r", (log_odds + F.col("end_l") + F.col("begin_r") - F.col("left_l") - F.col("right_r")).alias("gain"))
    gained = lattice.where("to is null").join(gains.hint("merge"), ["form", "l", "r"]).groupBy("id").agg(F.collect_list(F.struct("at", "gain")).alias("gains"))
    fields = cut(fields.join(gained.hint("merge"), "id", "left"))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(v, n) for t, n, g in zip(*(c.to_pylist() for c in b.columns)) for v in model.spans(t, _gains(g))]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["v", "n"])

    whole = values.where(~marked).select(F.trim("v").alias("v"), F.lit(1).cast("bigint").alias("n"))
    found = whole.unionByName(fields.select("v", "n", "gains").mapInArrow(segment, "v string, n long")).groupBy("v").agg(F.sum("n").alias("n"))
    frequent = cut(found.where((F.col("n") > 1) & (F.length("v") > 0)))
    return ColumnModel(delimiters, part, unseen, model.length, told, fields, lattice.where("to is not null").select("id", "at", "to", "h"), frequent)


def _md5(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _counts(of: list | None, text: str, delimiters: re.Pattern) -> dict[tuple[int, int], int]:
    """The counts of a field's frequent values by their words; long ones are told by their beginning and verified here."""
    got = {(x["at"], x["to"]): x["times"] for x in of or () if x["to"] > 0}
    if of and len(got) < len(of):
        f = read_field(text, delimiters)
        ends = {f.spans[k - 1][1]: k for k in _nodes(f)[1:]}
        for x in of:
            begin = f.spans[x["at"]][0]
            to = ends.get(begin + x["letters"], 0) if x["to"] < 0 else 0
            if to - x["at"] >= MAX_LENGTH and _md5(_text(f, x["at"], to)) == x["whole"]:
                got[x["at"], to] = x["times"]
    return got


def _gains(of: list | None) -> dict[int, float]:
    return {g["at"]: g["gain"] for g in of or ()}


def split_column(df: DataFrame, key: str, column: str, delimiters: str, clean=None) -> DataFrame:
    """key, pos, value: one row per value of every field of ``column`` that holds two or more.

    Positions count from 0 in the order written; empty slots do not count, repeated values stay.
    ``clean`` maps a value to its final form or to None to drop it. Null and blank fields give no row;
    repeated rows give their values once; fields of any length are split whole.
    """
    import pyarrow as pa

    learned = learn_column(df, column, delimiters)
    model = Segmenter(set(), delimiters)
    model.length = learned.length
    counted = learned.frequent.select(F.unhex(F.md5("v")).alias("h"), F.col("n").alias("times"))
    short = learned.spans.where("to > 0").join(counted.hint("merge"), "h").select("id", "at", "to", "times", F.lit(None).cast("int").alias("letters"), F.lit(None).cast("binary").alias("whole"))
    long_ = learned.frequent.where(F.length("v") >= LONG).select(F.unhex(F.md5(F.substring("v", 1, LONG))).alias("h"), F.col("n").alias("times"), F.length("v").alias("letters"), F.unhex(F.md5("v")).alias("whole"))
    long_ = learned.spans.where("to < 0").join(long_.hint("merge"), "h").select(*short.columns)
    bonus = short.unionByName(long_).groupBy("id").agg(F.collect_list(F.struct(*short.columns[1:])).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for id_, text, gains, values in zip(*(c.to_pylist() for c in b.columns)):
                got = model.split(text, _gains(gains), _counts(values, text, model.delimiters))
                if clean is not None:
                    got = [c for v in got if (c := clean(v))]
                if len(got) > 1:
                    ids.append(id_)
                    out.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.list_(pa.string()))], names=["id", "values"])

    pieces = learned.fields.join(bonus.hint("merge"), "id", "left").select("id", "v", "gains", "values").mapInArrow(run, "id binary, values array<string>")
    packed = df.select(F.col(key).alias("_key"), F.unhex(F.md5(column)).alias("id")).where(may_part(column, delimiters)).distinct()
    return packed.join(pieces.hint("merge"), "id").select(F.col("_key").cast("bigint").alias(key), F.posexplode("values").alias("pos", "value")).distinct()


_ISSN = re.compile(r"^(\d{4})-?(\d{3}[\dXx])$")


def issn_value(text: str) -> str | None:
    """An ISSN as eight characters with an upper-case X, without the note after it; None for anything else."""
    m = _ISSN.match(re.sub(r"\([^)]*\)|[\"'\[\]]", "", text).strip())
    return (m[1] + m[2]).upper() if m else None
