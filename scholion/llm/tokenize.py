"""Encoding of a corpus with a public byte-level BPE vocabulary by corpus-level merge replay."""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARIES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeReplay:
    """Encodes words by replaying the vocabulary's merges over all of them at once.

    The words' symbols lie in one linked sequence. An inverted index leads from each pair of adjacent
    symbols to its positions; pairs are taken in rank order, and a merge changes the index only for the
    touched neighbours. ``known`` holds words encoded before for the whole corpus; others are replayed when they
    are met, and kept.
    """

    def __init__(self, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k", known: dict[str, bytes] | None = None, kept_words: int = 1_000_000):
        import regex

        with open(os.path.join(folder, VOCABULARIES[name]), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.symbols = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.known = known or {}
        self.words = dict(self.known)
        self.kept_words = kept_words + len(self.words)

    def rank(self, pair: tuple[int, int]) -> int | None:
        try:
            return self.pairs[pair]
        except KeyError:
            r = self.pairs[pair] = self.ranks.get(self.symbols[pair[0]] + self.symbols[pair[1]])
            return r

    def replay(self, words: list[str]) -> None:
        """Encodes words into ``self.words``: the bytes of their ids, four each."""
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend(self.single[b] for b in w.encode("utf-8", "surrogatepass"))
            sym.append(-1)  # parts the words
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        heap: list[tuple[int, tuple[int, int]]] = []
        rank = self.rank

        def enter(pair: tuple[int, int], at: int) -> None:
            got = index.get(pair)
            if got is not None:
                got.append(at)
            elif (r := rank(pair)) is not None:
                index[pair] = [at]
                heapq.heappush(heap, (r, pair))

        for i in range(n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0:
                enter((sym[i], sym[i + 1]), i)
        while heap:
            r, pair = heapq.heappop(heap)
            a, b = pair
            # positions run from left to right, as a run of one symbol is merged from its left end
            for i in sorted(index.pop(pair)):
                if sym[i] != a:
                    continue
                j = after[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = r, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if sym[k] >= 0:
                        enter((r, sym[k]), i)
                h = before[i]
                if h >= 0 and sym[h] >= 0:
                    enter((sym[h], r), h)
        for w, i in zip(words, starts):
            ids = []
            while sym[i] != -1:
                ids.append(sym[i])
                i = after[i]
            self.words[w] = array("i", ids).tobytes()

    def _split(self, texts: Iterable[str | None]) -> list[list[str]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > self.kept_words:
            self.words = dict(self.known)
        new = set().union(*split).difference(self.words)
        if new:
            self.replay(list(new))
        return split

    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes, four each; none for empty and null texts. Strings of special tokens are ordinary text."""
        split = self._split(texts)
        of = self.words.__getitem__
        return [b"".join(map(of, ws)) for ws in split]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; the empty list for empty and null texts."""
        return [array("i", x).tolist() for x in self.encode_texts(texts)]

    def count_batch(self, texts: Iterable[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [len(x) // 4 for x in self.encode_texts(texts)]


def frequent_words(documents: DataFrame, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k", most: int = 200_000, letters: int = 32):
    """A broadcast of word to ids for the words that the corpus repeats, each replayed once for the whole corpus.

    Words are counted in the JVM before any shuffle. Sent are the ``most`` most frequent ones of at most ``letters``
    letters, so the broadcast is bounded (some 10 MB) at every size; the others are replayed where they are met.
    How words are parted here only decides what is sent: what the tokenizer doesn't find, it replays.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for b in batches for w in b.column(0).to_pylist()]
        coder = MergeReplay(folder, name)
        coder.replay(words)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([coder.words[w] for w in words], pa.binary())], names=["word", "ids"])

    spark = documents.sparkSession
    words = documents.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("(?U)" + PATTERN), F.lit(0))).alias("word"))
    repeated = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.length("word").between(1, letters))
    top = repeated.orderBy(F.desc("n"), "word").limit(most).select("word").repartition(spark.sparkContext.defaultParallelism, "word")
    return spark.sparkContext.broadcast({r.word: bytes(r.ids) for r in top.mapInArrow(run, "word string, ids binary").collect()})


def encode(documents: DataFrame, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids (array of int) of every document; other columns are ignored.

    The words the corpus repeats are encoded once and joined back by a bounded broadcast; texts are never shuffled.
    Null and empty texts have the empty list; repeated rows are encoded each. Texts of any length are
    encoded whole.
    """
    import numpy as np
    import pyarrow as pa

    known = frequent_words(documents, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeReplay(folder, name, known.value)
        for b in batches:
            ids = coder.encode_texts(b.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, dtype="int32")
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, text of every row of ids; the empty text for the empty list."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = MergeReplay(folder, name).symbols
        for b in batches:
            texts = [b"".join(map(symbols.__getitem__, ids)).decode("utf-8", "surrogatepass") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
