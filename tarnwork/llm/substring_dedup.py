"""Substring deduplication with suffix automata of reference shards.

A window is ``words`` consecutive words of one document; a word goes if a window that
covers it also starts earlier (smaller doc_id, or earlier in the document).

Windows are first grouped without loss: the smallest 4-gram hash of a window (its
minimizer) is a function of its words, so equal windows have equal minimizers.
Successive windows of one minimizer form a unit.  Only units whose minimizer occurs
again can hold a repeated window; for most documents none is left.  The units of one
minimizer meet in one place, in order of their starts.  Units of equal words are one
content, known by its earliest unit: every later unit of that content goes whole.
Different contents of one minimizer are the reference shard: they make one suffix
automaton whose states know where they first ended, and each content is streamed
through it; a matching statistic of at least ``words`` that first ended elsewhere marks
its window.  Contents are the words themselves, so what goes was compared word by word
(a word of more than 64 bytes by 256 bits of digest).  The automata are built where the
units are, by a shuffle on the minimizer, and not broadcast: a broadcast reference would
grow with the corpus and every document would have to pass every shard (README has
figures).  A minimizer that occurs more than ``shard`` times (one passage in very many
documents) is split further, window by window: the first place of each window, by 128
bits of digest of its words, is a minimum, aggregated before the shuffle, so that no task
holds an unbounded group.

Defined cases: null text has no words; a document shorter than a window loses nothing;
rows of equal doc_id and text are one document and fare alike; rows of one doc_id and
different texts are different documents, in an order of their own; rows without a doc_id
come before all others and are one document only if their texts are equal; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import partitions, shared_table
from ._words import ngram_hashes, word_places

GRAM = 4
#: Rows without a doc_id have numbers of their texts' hashes here and up to a quarter of the range.
_NULL = -(1 << 63)
#: Longer words are known by a digest.
_LONG = 64
_PLACE = np.uint64((1 << 20) - 1)


def units(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimizers of a document's units."""
    gram = min(GRAM, words)
    grams = ngram_hashes(hashes, gram)
    span = words - gram + 1
    if len(grams) < span:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    # Of equal grams the first counts: the place is in the low bits of what is compared.
    least, width = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE), 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.arange(len(least))
    place = at + (((least & _PLACE).astype(np.int64) - at) & int(_PLACE))
    start = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    return start, np.diff(np.append(start, len(place))), grams[place[start]]


def _raw(texts: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes as they lie; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def _find_units(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, raw in enumerate(_raw(batch.column(2))):
                _, _, key = units(word_places(raw)[0], words)
                if len(key):
                    rows.append(np.full(len(key), row))
                    keys.append(key)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["mh", "doc_id", "alt"])

    return run


def _hits(raw: bytes, keys: pa.Scalar, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A text, its words' first and past bytes, and its units whose minimizer is in ``keys``."""
    if not len(wanted := keys.values.to_numpy(zero_copy_only=False) if keys.is_valid else ()):
        return None
    hashes, first, past = word_places(raw)
    start, count, key = units(hashes, words)
    hit = np.isin(key.view(np.int64), wanted)
    return raw, first, past, start[hit], count[hit], key[hit].view(np.int64)


def _plain(raw: bytes) -> list[bytes]:
    """The words of some bytes; bytes split at the same characters as texts do."""
    found = raw.split()
    return found if len(raw) <= _LONG else [w if len(w) <= _LONG else b"\0" + hashlib.sha256(w).digest().hex().encode() for w in found]


#: Distinct contents, and bytes of them, that a task holds back, so that copies in its documents are sent once.
_HELD, _HELD_BYTES = 50_000, 64 << 20


def _earliest(words: int, column: str, names: list[str], found: Callable[..., Iterator[tuple[tuple[int, bytes], int]]], out: list[str]):
    """A pass over candidate documents that yields the keys of ``found`` with their earliest places."""
    doc, alt, text, keys = (names.index(n) for n in ("doc_id", "alt", "text", column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        held = 0

        def told() -> pa.RecordBatch:
            minimizers, contents = zip(*best, strict=True)
            ids, alts, starts = zip(*best.values(), strict=True)
            columns = [pa.array(minimizers, pa.int64()), pa.array(contents, pa.binary()), pa.array(ids, pa.int64()), pa.array(alts, pa.int32()), pa.array(starts, pa.int64())]
            best.clear()
            return pa.RecordBatch.from_arrays(columns, names=out)

        for batch in batches:
            for row, raw in enumerate(_raw(batch.column(text))):
                if not (hits := _hits(raw, batch.column(keys)[row], words)):
                    continue
                name = batch.column(doc)[row].as_py(), batch.column(alt)[row].as_py()
                for key, at in found(*hits):
                    place = (*name, at)
                    if key not in best:
                        best[key], held = place, held + len(key[1])
                    elif place < best[key]:
                        best[key] = place
                if len(best) > _HELD or held > _HELD_BYTES:
                    yield told()
                    held = 0
        if best:
            yield told()

    return run


def _contents(words: int, names: list[str]):
    """Distinct contents of candidate units."""

    def found(raw: bytes, first: np.ndarray, past: np.ndarray, starts: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[tuple[int, bytes], int]]:
        lows, highs = first[starts].tolist(), past[starts + counts + words - 2].tolist()
        for low, high, start, key in zip(lows, highs, starts.tolist(), keys.tolist(), strict=True):
            yield (key, b" ".join(_plain(raw[low:high]))), start

    return _earliest(words, "again", names, found, ["mh", "words", "doc_id", "alt", "start"])


def _windows(words: int, names: list[str]):
    """Windows of hot units, by a digest of their words."""

    def found(raw: bytes, first: np.ndarray, past: np.ndarray, starts: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[tuple[int, bytes], int]]:
        for start, count, key in zip(starts.tolist(), counts.tolist(), keys.tolist(), strict=True):
            part = _plain(raw[first[start] : past[start + count + words - 2]])
            for at in range(count):
                yield (key, xxhash.xxh3_128_digest(b" ".join(part[at : at + words]))), start + at

    return _earliest(words, "hot", names, found, ["mh", "window", "doc_id", "alt", "start"])


class SuffixAutomaton:
    """Suffix automaton of several sequences; each state knows where it first ended."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def _state(self, length: int, step: dict[int, int], link: int, first: tuple[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], self.first[q])
        self.link[q] = clone
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for at, c in enumerate(sequence):
            q = self.step[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0, (name, at))
            p = last
            while p != -1 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            if p != -1:
                q = self.step[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = new

    def statistics(self, sequence: list[int], least: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Ends at which the longest match is at least ``least`` long, with the place where that
        suffix of ``least`` symbols first ended."""
        state = length = 0
        for at, c in enumerate(sequence):
            while state and c not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.step[state]:
                state, length = self.step[state][c], length + 1
            if length >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                    length = self.length[state]
                yield at, self.first[state]


def repeated_windows(contents: list[list[int]], words: int) -> list[int]:
    """Bit masks of the windows of each content that start earlier in it or in one before it."""
    shard = SuffixAutomaton()
    for name, sequence in enumerate(contents):
        shard.add(sequence, name)
    return [sum(1 << (at - words + 1) for at, first in shard.statistics(sequence, words) if first != (name, at)) for name, sequence in enumerate(contents)]


def _symbols(contents: list[bytes]) -> list[list[int]]:
    """Contents as numbers of their words."""
    table: dict[bytes, int] = {}
    return [[table.setdefault(w, len(table)) for w in raw.split(b" ")] for raw in contents]


def _judge(words: int):
    """Rows sorted by minimizer and place; a minimizer's contents are one reference shard."""
    size = 8 * (words // 64 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, {}
        out: list[tuple[int, int, int, bytes]] = []

        def judge() -> None:
            # A content of one window that meets no other can't repeat.
            single = len(first) < 2 and all(raw.count(b" ") < words for raw in first)
            masks = [0] * len(first) if single else repeated_windows(_symbols(list(first)), words)
            out.extend((*place, mask.to_bytes(size, "little")) for place, mask in zip(first.values(), masks, strict=True))

        def batch_of() -> pa.RecordBatch:
            ids, alts, starts, masks = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(alts, pa.int32()), pa.array(starts, pa.int64()), pa.array(masks, pa.binary())], names=["doc_id", "alt", "start", "mask"])

        for batch in batches:
            for mh, doc_id, alt, start, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if mh != now:
                    judge()
                    now, first = mh, {}
                    if len(out) > 10_000:
                        yield batch_of()
                first.setdefault(raw, (doc_id, alt, start))
        judge()
        if out:
            yield batch_of()

    return run


def _strip(words: int, emit: Callable[[list[bytes], np.ndarray | None, bytes], tuple], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone: dict[int, np.ndarray] = {}
            texts = _raw(batch.column(1))
            for column in (2, 3):
                for k, raw in enumerate(texts):
                    if not (hits := _hits(raw, batch.column(column)[k], words)):
                        continue
                    _, places, _, starts, counts, _ = hits
                    first = batch.column(4)[k]
                    judged = {x["start"]: x["mask"] for x in first.as_py()} if first.is_valid else {}
                    marks = gone.setdefault(k, np.zeros(len(places) + 1, dtype=np.int64))
                    for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
                        if column == 3:  # hot: all windows go but those that are first
                            old = [i for i in range(start, start + count) if i not in judged]
                        elif start not in judged:  # a later unit of a known content
                            marks[start] += 1
                            marks[start + count - 1 + words] -= 1
                            continue
                        else:
                            mask = int.from_bytes(judged[start], "little")
                            old = [start + i for i in range(count) if mask >> i & 1] if mask else []
                        for i in old:
                            marks[i] += 1
                            marks[i + words] -= 1
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                tokens = texts[k].split()
                marks = np.cumsum(gone[k][:-1]) > 0 if k in gone else None
                rows.append((doc_id, *emit(tokens, marks if marks is not None and marks.any() else None, texts[k])))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            made = [pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[5:]], names=[*schema.names, *batch.schema.names[5:]])

    return run


def _digest(tokens: list[bytes], gone: np.ndarray | None, raw: bytes) -> tuple:
    kept = tokens if gone is None else compress(tokens, ~gone)
    return len(tokens), 0 if gone is None else int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _text(tokens: list[bytes], gone: np.ndarray | None, raw: bytes) -> tuple:
    """The text itself where nothing goes, else the kept words joined by one space, and the spans that went."""
    if gone is None:
        return raw.decode(), len(tokens), 0, []
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    return b" ".join(compress(tokens, ~gone)).decode(), len(tokens), int(gone.sum()), [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = {
    True: (_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])),
    False: (_text, "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>", pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPAN)])),
}


def remove_repeats(docs: DataFrame, words: int = 20, shard: int = 5000, digest: bool = False, keep: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the text without its repeated windows, the numbers of
    words and removed words, and the removed word spans (end exclusive); with ``digest`` the kept words'
    SHA-256 in place of text and spans; with ``keep`` the columns of ``docs`` with the new text, and no others.
    Null text gives an empty text (with ``keep`` it stays null)."""
    spark = docs.sparkSession
    number = F.lit(_NULL) + F.xxhash64("text", F.lit(3)).bitwiseAND(F.lit((1 << 62) - 1))
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null")).alias("rest")] if keep else []
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    # ``alt`` tells rows of one doc_id and different texts apart.
    alt = F.shiftright(F.xxhash64("text"), 32).cast("int").alias("alt")
    base = plain.select(F.coalesce("doc_id", number).alias("doc_id"), alt, "text", F.col("doc_id").isNull().alias("nameless"), *(["rest"] if keep else []))
    name = ["doc_id", "alt"]
    found = shared_table(base.select(*name, "text").mapInArrow(_find_units(words), "mh long, doc_id long, alt int"), "units")
    # A table, so that the join below is between two plain exchanges and a hot minimizer can be split.
    again = shared_table(found.groupBy("mh").agg(F.count("*").alias("k")).where("k > 1"), "repeated")
    hits = found.join(again.hint("merge"), "mh").groupBy(*name)
    hits = hits.agg(F.collect_set(F.when(F.col("k") <= shard, F.col("mh"))).alias("again"), F.collect_set(F.when(F.col("k") > shard, F.col("mh"))).alias("hot"))
    # One exchange of the documents serves all three uses.
    joined = base.join(hits.hint("merge"), name, "left")

    # The minimizers left here occur at most ``shard`` times.
    contents = joined.where("size(again) > 0").mapInArrow(_contents(words, joined.columns), "mh long, words binary, doc_id long, alt int, start long")
    contents = contents.repartition(partitions(spark), "mh").sortWithinPartitions("mh", *name, "start").select("mh", *name, "start", "words")
    judged = contents.mapInArrow(_judge(words), "doc_id long, alt int, start long, mask binary")
    first = joined.where("size(hot) > 0").mapInArrow(_windows(words, joined.columns), "mh long, window binary, doc_id long, alt int, start long")
    first = first.groupBy("mh", "window").agg(F.min(F.struct(*name, "start")).alias("first")).select("first.*", F.lit(b"").alias("mask"))
    judged = judged.union(first).groupBy(*name).agg(F.collect_list(F.struct("start", "mask")).alias("judged"))
    emit, schema, arrow = _OUT[digest]
    full = joined.join(judged.hint("merge"), name, "left")
    full = full.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "text", "again", "hot", "judged", *(["rest"] if keep else []))
    if keep:
        out = full.mapInArrow(_strip(words, emit, arrow), T.StructType([*T._parse_datatype_string(schema).fields, full.schema["rest"]]))
        return out.select(*[F.when(~F.col("rest.__null"), F.col("text")).alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
    return full.mapInArrow(_strip(words, emit, arrow), schema)
