"""Filling fixed-capacity containers with documents sized in tokens."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.tokenize import DEFAULT_FOLDER, VOCABULARIES, MergeReplay, frequent_words
from scholion.operators.ranking import global_row_number
from scholion.session import cut


def token_counts(documents: DataFrame, tokenizers: list[str], folder: str = DEFAULT_FOLDER) -> DataFrame:
    """doc_id, tokenizer, tokens for each document and tokenizer; null and empty texts have 0 tokens."""
    import pyarrow as pa

    known = {name: frequent_words(documents, folder, name) for name in tokenizers if name in VOCABULARIES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {}
        for name in tokenizers:
            if name in VOCABULARIES:
                counters[name] = MergeReplay(folder, name, known[name].value).count_batch
            elif name.startswith("piece"):
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
                counters[name] = lambda texts, m=model: [len(x) for x in m.encode([t or "" for t in texts], num_threads=1)]
            else:
                from tokenizers import Tokenizer

                words = Tokenizer.from_file(f"{folder}/{name}.json")
                words.encode_special_tokens = True
                counters[name] = lambda texts, w=words: [len(x.ids) for x in w.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for b in batches:
            texts = b.column(1).to_pylist()
            for name, count in counters.items():
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([name] * len(texts), pa.string()), pa.array(count(texts), pa.int64())], names=["doc_id", "tokenizer", "tokens"]
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokenizer string, tokens long")


class Stock:
    """Items by length, with the lengths in stock as the bits of one number: finding the longest that fits, or two that
    close a gap exactly, is a shift and a look at the highest bit, over all lengths."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            self.items.setdefault(lengths[i], []).append(i)
        self.held = sum(1 << s for s in self.items)
        self.mirror = sum(1 << capacity - s for s in self.items)

    def take(self, size: int) -> int:
        """The item of a length that comes first."""
        i = self.items[size].pop()
        if not self.items[size]:
            del self.items[size]
            self.held ^= 1 << size
            self.mirror ^= 1 << self.capacity - size
        return i

    def longest(self, most: int) -> int:
        """The longest length of at most ``most`` in stock, or 0."""
        return (self.held & (2 << most) - 1).bit_length() - 1 if self.held & (2 << most) - 1 else 0

    def fill(self, gap: int, most: int) -> Iterator[tuple[int, int]]:
        """Takes (item, length) into a gap until none of at most ``most`` fits: two that close it exactly, or else the longest."""
        while gap and (size := self.longest(min(gap, most))):
            if size < gap:
                pairs = self.held & (2 << min(gap, most)) - 1 & self.mirror >> self.capacity - gap
                if gap > most:
                    pairs = pairs >> gap - most << gap - most
                if gap % 2 == 0 and len(self.items.get(gap // 2, ())) == 1:
                    pairs &= ~(1 << gap // 2)
                if pairs:
                    size = pairs.bit_length() - 1
            yield self.take(size), size
            gap -= size


def tier_of(size: int, capacity: int, tiers: int) -> int:
    """The tier of shortest window that holds an item: windows of tier t have capacity / 2**t."""
    t = 0
    while t < tiers - 1 and size <= capacity >> t + 1:
        t += 1
    return t


def pack_lengths(lengths: list[int], capacity: int, tiers: int = 4) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs items (all 1..capacity long) into containers: (tier, [(item, window)]) each.

    Items are routed to tiers of context windows of capacity / 2**t, each to the shortest window that holds it. Tiers are
    packed from the longest windows to the shortest, 2**t windows of tier t to a container. A window opens with its
    tier's longest item, and its gap is filled from shorter tiers only. What all windows of a container leave
    over is then one gap, filled with the longest items left of its tier or shorter ones; these have the window 2**t.
    So no two containers could be one. Equal lengths are taken in index order, and the work grows with the items.
    """
    tiers = max(1, min(tiers, capacity.bit_length()))
    stock = Stock(lengths, capacity)
    out = []
    for t in range(tiers):
        window, shorter = capacity >> t, (capacity >> t + 1 if t < tiers - 1 else capacity >> t)
        least = shorter if t < tiers - 1 else 0
        while stock.longest(window) > least:
            items, left = [], capacity
            for w in range(1 << t):
                first = stock.longest(window)
                if first <= least:
                    break
                items.append((stock.take(first), w))
                left -= first
                for i, size in stock.fill(window - first, shorter):
                    items.append((i, w))
                    left -= size
            items += [(i, 1 << t) for i, _ in stock.fill(left, window)]
            out.append((t, items))
    return out


#: A container as packed: its pieces in one row, until the step groups are known.
CONTAINER = "capacity_id int, container long, tier int, cost long, pieces array<struct<slot:int,doc_id:long,piece:int,tokens:long,window:int>>"


def pack_documents(documents: DataFrame, capacities: DataFrame, folder: str = DEFAULT_FOLDER, shard_docs: int = 20_000, step: int = 8, tiers: int = 4) -> DataFrame:
    """One row per piece of each document and capacity: capacity_id, container, slot, doc_id, piece, tokens, window, tier, step_group.

    A document longer than the capacity is split into full pieces and a rest, others stay whole. Null
    and empty texts take no space: one row with null container, slot, window, tier and step_group and 0 tokens.
    Documents are spread by hash over shards of about ``shard_docs`` rows, which are packed on their own;
    so a task is bounded at every size, and only the last containers of each shard are left underfull.
    A step group holds ``step`` containers of one capacity, of all shards: containers are ranked by their cost of attention
    (the squares of their pieces' lengths) and dealt back and forth, so the groups' costs are nearly equal.
    ``capacities`` is the parameter table (capacity_id, tokenizer, capacity): its few rows are read by
    the driver; rows with nulls or a capacity below 1 are left out. Repeated rows of either table count once
    for capacities and each for documents. Equal input gives equal containers.
    """
    import numpy as np
    import pyarrow as pa

    plan = sorted({(r.capacity_id, r.tokenizer, r.capacity) for r in capacities.select("capacity_id", "tokenizer", "capacity").dropna().collect() if r.capacity > 0})
    shards = max(1, -(-documents.count() // shard_docs))
    counts = token_counts(documents, sorted({t for _, t, _ in plan}), folder)
    inner = pa.struct([("slot", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64()), ("window", pa.int32())])
    schema = pa.schema([("capacity_id", pa.int32()), ("container", pa.int64()), ("tier", pa.int32()), ("cost", pa.int64()), ("pieces", pa.list_(inner))])

    def pack(key, rows):
        name, shard = key[0].as_py(), key[1].as_py()
        pairs = sorted(zip(rows["doc_id"].to_pylist(), rows["tokens"].to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out: list[list] = [[] for _ in range(4)]
        offsets, flat = [0], [[] for _ in range(5)]
        for capacity_id, tokenizer, capacity in plan:
            if tokenizer != name:
                continue
            docs, pieces, lengths = [], [], []
            for d, n in pairs:
                for p in range(-(-n // capacity)):
                    docs.append(d)
                    pieces.append(p)
                    lengths.append(min(capacity, n - p * capacity))
            packed = [(shard << 32 | c, t, [(s, docs[i], pieces[i], lengths[i], w) for s, (i, w) in enumerate(items)]) for c, (t, items) in enumerate(pack_lengths(lengths, capacity, tiers))]
            empty = [(None, d, 0, 0, None) for d, n in pairs if n == 0]
            for container, tier, items in packed + ([(None, None, empty)] if empty else []):
                cost = None if container is None else sum(x[3] ** 2 for x in items)
                for column, x in zip(out, (capacity_id, container, tier, cost)):
                    column.append(x)
                for column, values in zip(flat, zip(*items)):
                    column.extend(values)
                offsets.append(len(flat[0]))
        structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, inner)], fields=list(inner))
        lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype="int32")), structs, type=schema.field("pieces").type)
        return pa.Table.from_arrays([*(pa.array(v, f.type) for v, f in zip(out, schema)), lists], schema=schema)

    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    containers = sharded.groupBy("tokenizer", "shard").applyInArrow(pack, CONTAINER)
    ranked = cut(global_row_number(containers, ["capacity_id", "cost", "container"]))
    of = ranked.where("container is not null").groupBy("capacity_id").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    place = ranked.join(F.broadcast(of), "capacity_id", "left")  # one row a capacity
    groups = F.ceil(F.col("n") / step)
    rank = F.col("rn") - F.col("first")
    at = rank % groups
    dealt = F.when(F.floor(rank / groups) % 2 == 0, at).otherwise(groups - 1 - at)
    grouped = place.withColumn("step_group", F.when(F.col("container").isNotNull(), dealt.cast("long")))
    return grouped.select("capacity_id", "container", "tier", "step_group", F.inline("pieces")).select("capacity_id", "container", "slot", "doc_id", "piece", "tokens", "window", "tier", "step_group")


def packing_check(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: documents, rows without a container, containers over the capacity, windows over their tier's length,
    documents split though they fit, pieces that are not full though not last, and whether the least and greatest step group
    differ by more than one container. All but the first two are 0 when the packing is right."""
    cap = capacities.select("capacity_id", F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct()
    held = packed.where("container is not null")
    count = lambda cond: F.count_if(cond)
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("container").alias("k"), F.max("tokens").alias("longest")).join(F.broadcast(cap), "capacity_id")
    whole = docs.groupBy("capacity_id").agg(
        F.count("*").alias("documents"), count(F.col("k") == 0).alias("without_space"), count((F.col("t") <= F.col("capacity")) & (F.col("k") > 1)).alias("split_though_fitting"),
        count((F.col("t") > F.col("capacity")) & (F.col("k") != F.ceil(F.col("t") / F.col("capacity")))).alias("pieces_not_full"),
    )
    loads = held.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t"), F.max("step_group").alias("step_group")).join(F.broadcast(cap), "capacity_id")
    over = loads.groupBy("capacity_id").agg(count(F.col("t") > F.col("capacity")).alias("over_capacity"))
    windows = held.where(F.col("window") < F.pow(F.lit(2), F.col("tier"))).groupBy("capacity_id", "container", "window", "tier").agg(F.sum("tokens").alias("t")).join(F.broadcast(cap), "capacity_id")
    wide = windows.groupBy("capacity_id").agg(count(F.col("t") > F.floor(F.col("capacity") / F.pow(F.lit(2), F.col("tier")))).alias("over_window"))
    groups = loads.groupBy("capacity_id", "step_group").agg(F.count("*").alias("k")).groupBy("capacity_id").agg((F.max("k") - F.min("k") > 1).cast("int").alias("uneven_steps"))
    return whole.join(over, "capacity_id").join(wide, "capacity_id").join(groups, "capacity_id")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of space used."""
    used = packed.where("container is not null").groupBy("capacity_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = capacities.select("capacity_id", F.col("capacity").cast("long").alias("capacity")).distinct()
    return used.join(cap, "capacity_id").select("capacity_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("fill"))
