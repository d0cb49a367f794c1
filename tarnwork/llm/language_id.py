"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to 4 letters (hashed; presence, not
counts).  The blended-spectrum presence kernel of two texts is the size of the meet of
their sets, normalised.  Nyström landmarks, drawn from the labelled sample, turn the
kernel into features, and one-versus-rest kernel ridge regression is fitted on these.
A batch of texts is scored as a product of its presence matrix with the landmarks' and
then with the weights.

The model is fitted on at most ``per_language`` labelled texts of each of the
``most_languages`` most frequent languages: one text (the smallest) of each of the doc_ids of
smallest hash.  The driver receives their presence bits (4 KB each), never texts, and one
count per language.

Defined cases: null text and text without a letter give ``und`` with score 0, as does
any text where nothing could be learned; ties go to the language that sorts first;
equal texts get equal answers; rows with null lang or null doc_id are not learned from;
repeated rows and rows of one doc_id count once per language; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BITS = 15
LONGEST = 4
_LETTER = regex.compile(r"\p{L}")
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_BLOCK = 1 << 20


def presence(text: str, out: np.ndarray) -> None:
    """Set ``out[h]`` for the hashed n-grams of the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(points), _BLOCK):
        part = points[at : at + _BLOCK + LONGEST - 1]
        grams = part.copy()
        out[(grams * _SPREAD) >> np.uint32(32 - BITS)] = 1
        for n in range(1, LONGEST):
            if len(part) <= n:
                break
            grams = grams[:-1] * _STEP + part[n:] + np.uint32(n)
            out[(grams * _SPREAD) >> np.uint32(32 - BITS)] = 1


@dataclass(frozen=True)
class KernelModel:
    """Landmarks (packed presence bits), their norms, and one column of weights per language."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(bits: np.ndarray, labels: list[str], landmarks: int = 128, ridge: float = 1e-3) -> KernelModel:
        """``bits``: packed presence of each labelled text."""
        languages = tuple(sorted(set(labels)))
        if not languages:
            return KernelModel((), np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0), np.float32))
        by = {c: [i for i, x in enumerate(labels) if x == c] for c in languages}
        each = max(1, landmarks // len(languages))
        chosen = [i for c in languages for i in by[c][:each]]
        x = np.unpackbits(bits, axis=1).astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
        kernel = (x @ x[chosen].T) / norm[:, None] / norm[chosen]
        value, vector = np.linalg.eigh(kernel[chosen].astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        z = kernel @ root
        y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
        return KernelModel(languages, bits[chosen], (root @ w / norm[chosen][:, None]).astype(np.float32))

    def scores(self, x: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decision values of each language, and the kernel's value with the nearest landmark."""
        kernel = (x @ landmarks) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        return kernel @ self.weights, (kernel / np.sqrt(np.maximum(landmarks.sum(axis=0), 1))).max(axis=1)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            row = np.zeros(1 << BITS, dtype=np.uint8)
            presence(text, row)
            out.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "bits"])


def _sample(docs: DataFrame, learnable: Column, per_language: int, most_languages: int) -> DataFrame | None:
    """``(lang, doc_id, text)`` of at most ``per_language`` ids of each of ``most_languages`` languages; None without any."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keyed = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("key"))
    # Hashes far beyond the wanted number can't be chosen: few ids of a language, however frequent, are ranked.
    counts = keyed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    cuts = {r.lang: min(1.0, (3.0 * per_language + 100) / max(1, r.n)) * 2.0**64 - 2.0**63 for r in counts}
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    near = keyed.where(F.col("key").cast("double") <= F.element_at(cut, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = near.select("lang", "doc_id", "key").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    # At most per_language ids of most_languages languages: small enough to broadcast.
    return near.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, learnable: Column, per_language: int = 300, landmarks: int = 128, most_languages: int = 200) -> KernelModel:
    """Fit on the rows of ``docs(doc_id, text, lang)`` for which ``learnable`` holds."""
    sample = _sample(docs, learnable, per_language, most_languages)
    if sample is None:
        return KernelModel.fit(np.zeros((0, (1 << BITS) // 8), np.uint8), [], landmarks)
    found = sample.select("lang", "text").mapInArrow(_bits, "lang string, bits binary").collect()
    found = sorted((r.lang, bytes(r.bits)) for r in found)
    bits = np.frombuffer(b"".join(b for _, b in found), dtype=np.uint8).reshape(len(found), -1 if found else (1 << BITS) // 8)
    order_by = np.random.default_rng(7).permutation(len(found))
    return KernelModel.fit(bits[order_by], [found[i][0] for i in order_by], landmarks)


#: Places of the table of known letter sequences: half a megabyte whatever the sample.
_SLOTS = 22
_RUNS_BLOCK = 1 << 20


@functools.cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _runs(text: str) -> Iterator[np.ndarray]:
    """Table places of the runs of two and three letters of a lower-cased text, block by block."""
    for at in range(0, len(text), _RUNS_BLOCK):
        code = np.frombuffer(text[at : at + _RUNS_BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        letter = _alphabetic()[code]
        key, whole = np.zeros(len(code), dtype=np.uint64), np.ones(len(code), dtype=bool)
        for n in range(min(3, len(code))):
            size = len(code) - n
            key, whole = key[:size] << np.uint64(21) | code[n:], whole[:size] & letter[n:]
            if n:
                yield ((key[whole] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << _SLOTS, dtype=bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for places in _runs(text):
                seen[places] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["place"])


def known_runs(docs: DataFrame, learnable: Column, per_language: int = 300, most_languages: int = 200) -> bytes:
    """A table of the letter runs of the rows that ``fit`` learns from: 2^22 bits, whatever these are."""
    seen = np.zeros(1 << _SLOTS, dtype=bool)
    sample = _sample(docs, learnable, per_language, most_languages)
    if sample is not None:
        rows = sample.select("text").mapInArrow(_places, "place long").distinct().toPandas()  # at most 2^22 numbers
        seen[rows["place"].to_numpy()] = True
    return np.packbits(seen).tobytes()


def strange(text: str, known: np.ndarray, share: float = 0.5, chance: float = 0.001) -> bool:
    """Whether fewer than ``share`` of a text's letter runs are known, beyond what a text with that share would show with
    ``chance`` (Hoeffding's bound); a text of few letters is too short to tell.  A text's size moves nothing else."""
    n = hits = 0
    for places in _runs(text):
        n, hits = n + len(places), hits + int(known[places].sum())
    return n > 0 and hits / n < share - math.sqrt(math.log(1 / chance) / (2 * n))


def _predict(model: KernelModel, block: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = np.ascontiguousarray(np.unpackbits(model.landmarks, axis=1).astype(np.float32).T)
        x = np.empty((block, 1 << BITS), dtype=np.float32)
        for batch in batches:
            texts = batch.column(1)
            names: list[str] = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            todo = [i for i in range(len(texts)) if model.languages and _LETTER.search(texts[i].as_py() or "")]
            for at in range(0, len(todo), block):
                part = todo[at : at + block]
                x[: len(part)] = 0
                for k, i in enumerate(part):
                    presence(texts[i].as_py(), x[k])
                f, _ = model.scores(x[: len(part)], landmarks)
                best = f.argmax(axis=1)
                told = np.clip((1 + f[np.arange(len(part)), best]) / 2, 0, 1)
                for k, i in enumerate(part):
                    names[i], scores[i] = model.languages[best[k]], told[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """Rows ``(doc_id, lang_pred, score)`` for the rows of ``docs(doc_id, text)``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def tag(docs: DataFrame, model: KernelModel, column: str, known: bytes | None = None) -> DataFrame:
    """``docs`` as they are, with the prediction for ``text`` in one more column (which must be a new name); with a table of
    ``known_runs``, texts strange to it are of none of the learned languages: ``und``."""
    if column in docs.columns:
        raise ValueError(f"{column} is taken")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if known is None else np.unpackbits(np.frombuffer(known, dtype=np.uint8)).view(bool)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], names=["doc_id", "text"])
            found = next(_predict(model)(iter([texts]))).column(1)
            if table is not None:
                found = pa.array([UNKNOWN if t and strange(t, table) else n for t, n in zip(batch.column(place).to_pylist(), found.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.StringType())]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))
