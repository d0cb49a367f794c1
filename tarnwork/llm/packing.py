"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing depends on the pieces' lengths only.  So the pieces are counted by
length (a table of at most ``size`` rows, whatever the corpus), and the plan is made on
that histogram: lengths in descending order, for each the tightest open capacity, found
by descending a segment tree over remaining capacities, in time logarithmic in
``size``.  Pieces of one length go into bins of one remaining capacity as a run.  The
outcome is what best-fit decreasing over all single pieces gives.  Each piece then finds
its run by its rank among the pieces of its length; ranks are counted within
(length, salt) groups and shifted by the counts of lower salts.  A length has as many salts
as its counted pieces need, so no length's pieces meet in one task.

Defined cases: null text is empty, and a document of no tokens still has the closing id;
equal and repeated rows are separate documents; a null doc_id is kept; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_table

#: The word pattern of this kind of tokenizer and its parts for ASCII texts; white space
#: and letters as its regular expressions have them.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_END = "</w>"
#: Words that are kept, and bytes of them and their ids.
_CACHE_MOST, _CACHE_BYTES = 600_000, 128 << 20
#: Pieces of one (length, salt) at least, and the number of such groups that the driver holds at most, besides one a length.
_GROUP, _GROUPS = 20_000, 100_000
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts by a lower-casing tokenizer with word ends: each distinct word is
    encoded once and kept.  Texts for which words alone don't decide go to the tokenizer whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = token.endswith(_END)
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def _keep(self, word: str, raw: bytes) -> None:
        self.kept[word] = raw
        self.size += len(word) + len(raw)

    def _learn(self, words: list[str]) -> None:
        """Encode words joined by spaces; word ends part the ids."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):
            for word in words:
                self._keep(word, array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes())
            return
        raw, at = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist(), strict=True):
            self._keep(word, raw[at:stop])
            at = stop

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        kept = self.kept
        for at in range(0, len(texts), 256):
            if len(kept) > _CACHE_MOST or self.size > _CACHE_BYTES:
                kept.clear()
                self.size = 0
            block: list[list[str] | str] = []
            for text in texts[at : at + 256]:
                if "<|" in text or "\u03a3" in text:  # a special token; a letter whose lower case depends on its place
                    block.append(text)
                elif text.isascii():
                    block.append(_ASCII.findall(text.lower()))
                else:
                    block.append(_ANY.findall(unicodedata.normalize("NFC", text).lower()))
            new = list(set().union(*(words for words in block if isinstance(words, list))).difference(kept))
            for k in range(0, len(new), 20_000):
                self._learn(new[k : k + 20_000])
            for words in block:
                if isinstance(words, str):
                    yield np.array(self.tokenizer.encode(words, add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield np.frombuffer(b"".join(map(kept.__getitem__, words)), dtype=np.uint32)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.append(ids, np.uint32(closing)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class CapacityTree:
    """Segment tree over capacities 0..size: finds the smallest capacity >= c that has open bins."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, capacity: int) -> int | None:
        at = capacity + self.leaves
        while not self.some[at]:
            while at & 1:  # the right child: what lies further right is under an ancestor
                at //= 2
                if at <= 1:
                    return None
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs (length, first rank, bin, pieces per bin, offset) of best-fit decreasing for so many pieces of each length."""
    tree, free, bins, runs = CapacityTree(size), {}, 0, []

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            if not free.get(capacity):
                free[capacity] = []
                tree.set(capacity, True)
            free[capacity].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, number = size, bins, -(-left // (size // length))
                bins += number
            else:
                first, number = free[capacity].pop()
                if not free[capacity]:
                    tree.set(capacity, False)
            each = capacity // length  # a bin stays the tightest while it still takes this length
            full, over = min(number, left // each), 0
            if full < number and left % each:
                over = left - full * each
            runs.append((length, rank, first, each, size - capacity))
            put(capacity - each * length, first, full)
            if over:
                put(capacity - over * length, first + full, 1)
            put(capacity, first + full + (over > 0), number - full - (over > 0))
            rank += full * each + over
            left -= full * each + over
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def _place(runs: np.ndarray, ranks: dict[tuple[int, int], int]):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = runs[:, 0] << 44 | runs[:, 1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            length = rows["length"].to_numpy()
            rank = rows["rank"].to_numpy() + np.array([ranks[x] for x in zip(length, rows["salt"], strict=True)], dtype=np.int64)
            found = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            place = rank - found[:, 1]
            rows["sequence_id"] = found[:, 2] + place // np.maximum(found[:, 3], 1)
            rows["offset"] = found[:, 4] + place % np.maximum(found[:, 3], 1) * length
            yield rows.drop(columns=["salt", "rank"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, closing: int = 0) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every document's ids,
    closed by the id ``closing``, in pieces of at most ``size`` ids, and each piece's place.

    ``tokenizer`` is the path of a tokenizers file whose kind drops white space.  The driver sees one count
    per length, and per salt of the lengths that have several: at most ``size`` + 2 * ``_GROUPS`` numbers.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = shared_table(base.mapInArrow(_pieces(tokenizer, size, closing), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    total = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    group = max(_GROUP, -(-sum(total.values()) // _GROUPS))
    salts = {length: -(-n // group) for length, n in total.items() if n > group}
    ranks = {(length, 0): 0 for length in total}
    if salts:
        several = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), F.col("length")), F.lit(1))
        pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), several).cast("int"))
        at: dict[int, int] = {}
        counted = pieces.where(F.col("length").isin(list(salts))).groupBy("length", "salt").agg(F.count("*").alias("n")).collect()
        for length, salt, n in sorted(counted):
            ranks[length, salt] = at.get(length, 0)
            at[length] = ranks[length, salt] + n
    else:
        pieces = pieces.withColumn("salt", F.lit(0))
    runs = best_fit_plan(total, size)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    return ranked.mapInPandas(_place(runs, ranks), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
