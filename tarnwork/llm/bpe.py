"""Byte-level BPE encoding with a pair occurrence index, and decoding.

The texts of a batch are cut into pre-tokens; the distinct ones not seen before are laid
out as one long array of symbols.  An index maps each merge rank to all positions at
which its pair stands; a heap holds the active ranks.  The smallest active rank is
applied at all its positions at once, and the lists of the pairs that this makes are
updated, until no rank is active.  Known pre-tokens are kept per worker (bounded), so a
text costs one look-up per pre-token.

Defined cases: null text is empty and has no tokens; strings of special tokens inside a
text are encoded as the tokenizers library does by default, as those tokens; repeated
rows give repeated rows; an empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that are kept, and characters and ids of them.
_CACHE_MOST, _CACHE_SIZE = 600_000, 20_000_000
#: The pre-token pattern of this kind of tokenizer, with Unicode's white space, and the
#: printable characters that stand for themselves in its vocabulary.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_codecs: dict[str, ByteBPE] = {}


def _byte_letters() -> dict[str, int]:
    """The letter of each byte: itself if printable, else the next one from U+0100 on."""
    other = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(other)}


class PairIndex:
    """Positions of every mergeable pair in one array of symbols, by merge rank."""

    def __init__(self, symbols: np.ndarray, words: np.ndarray, codec: ByteBPE) -> None:
        n = len(symbols)
        self.codec, self.symbols, self.word = codec, symbols, words
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.note(np.flatnonzero(words[1:] == words[:-1]))

    def note(self, left: np.ndarray) -> None:
        """Enter the pairs that start at ``left``."""
        ranks = self.codec.rank(self.symbols[left], self.symbols[self.after[left]])
        known = ranks >= 0
        if not known.any():
            return
        left, ranks = left[known], ranks[known]
        if len(left) > 1:
            order = np.argsort(ranks, kind="stable")
            left, ranks = left[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part, rank in zip(np.split(left, cuts), ranks[np.append(0, cuts)].tolist(), strict=True):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(part)

    def merge_all(self) -> None:
        symbols, after, before, word, n = self.symbols, self.after, self.before, self.word, len(self.symbols)
        while self.active:
            rank = heapq.heappop(self.active)
            found = self.lists.pop(rank)
            first, second, merged = self.codec.merges[rank]
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            right = after[at]
            inside = right < n
            at, right = at[inside], right[inside]
            good = (symbols[at] == first) & (symbols[right] == second) & (word[at] == word[right])
            at, right = at[good], right[good]
            if first == second and len(at) > 1:  # of overlapping pairs take every other from the left
                run = np.concatenate(([True], at[1:] != right[:-1]))
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                odd = (np.arange(len(at)) - start) % 2 == 0
                at, right = at[odd], right[odd]
            if rank in self.codec.unsafe and len(at) > 1:  # a merge of lower rank may arise: one place a word, then look again
                fresh = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                if not fresh.all():
                    self.lists[rank] = [at[~fresh]]
                    heapq.heappush(self.active, rank)
                    at, right = at[fresh], right[fresh]
            if not len(at):
                continue
            symbols[at] = merged
            symbols[right] = -1
            beyond = after[right]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            follows = at[inner]
            follows = follows[word[follows] == word[beyond[inner]]]
            previous = before[at]
            leads = previous[previous >= 0]
            leads = leads[word[leads] == word[after[leads]]]
            self.note(np.unique(np.concatenate((leads, follows))))


class ByteBPE:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.bytes: dict[int, bytes] = {n: bytes(letters[c] for c in t) for t, n in vocab.items()}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.merges], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        least: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            least.setdefault(a, rank)
            least.setdefault(b, rank)
        self.unsafe = {rank for rank, (_, _, m) in enumerate(self.merges) if least.get(m, rank) < rank}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes |= {n: t.encode() for t, n in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kept: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def _learn(self, new: list[str]) -> None:
        raws = [t.encode("utf-8", "surrogatepass") for t in new]
        sizes = np.array([len(r) for r in raws])
        symbols = self.byte_id[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        words = np.repeat(np.arange(len(raws)), sizes)
        PairIndex(symbols, words, self).merge_all()
        live = symbols >= 0
        flat, counts = symbols[live].tolist(), np.bincount(words[live], minlength=len(raws)).tolist()
        at = 0
        for token, count in zip(new, counts, strict=True):
            self.kept[token] = tuple(flat[at : at + count])
            self.size += len(token) + count
            at += count

    def _parts(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return _SPLIT.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*_SPLIT.findall(text[at : m.start()]), "\0" + m[0]]
            at = m.end()
        return out + _SPLIT.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 2000):
            if len(self.kept) > _CACHE_MOST or self.size > _CACHE_SIZE:
                self.kept.clear()
                self.size = 0
            kept = self.kept
            for s, n in self.special.items():  # a pre-token never starts with NUL and goes on with a special token's string
                kept["\0" + s] = (n,)
            block = [self._parts(t) for t in texts[at : at + 2000]]
            new = list({p for parts in block for p in parts if p not in kept})
            if new:
                self._learn(new)
            for parts in block:
                ids: list[int] = []
                for p in map(kept.__getitem__, parts):
                    ids += p
                yield ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    if path not in _codecs:
        _codecs[path] = ByteBPE(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(codec(path).encode_batch([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows ``(doc_id, ids)`` for the rows of ``docs(doc_id, text)``; ``vocabulary`` is a path."""
    return _base(docs).mapInArrow(_encode(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Rows ``(doc_id, text)`` for the rows of ``encoded(doc_id, ids)``; null ids give null text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(vocabulary), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoded, digested and decoded in one pass."""
    return _base(docs).mapInArrow(_round_trip(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
