"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each document becomes a set of word shingles, a set hash and a MinHash signature.
   Documents of equal sets collapse to one class (smallest doc_id), so no later step
   sees a group of copies.
2. Bands of the signatures are hashed to buckets; buckets of equal members are one.  Inside
   a bucket the stored signatures are compared batch after batch: a pair is dropped once the
   posterior chance of its similarity being at least the threshold falls under ``miss``.
   Only a spanning forest of the survivors leaves a bucket, never all its pairs.  The
   components of these edges are the candidate groups: two classes that share a band and
   survive are in one group, and classes that only share bands by chance are in none.
3. The texts of the groups' members are fetched, and of these alone.  Inside a group pairs
   that share a band and survive are confirmed on full sets; pairs already joined need no
   comparison.
4. Components of the confirmed links are the result.

Buckets, and groups, above ``chunk`` members are cut into pieces (with common leaders); what
these leave unjoined is then compared with every piece, so no task holds an unbounded group
and no link is lost.  Before that step fetches a text, signatures tell which members have a
survivor in another part at all.

Defined cases: null or blank text has an empty set and is linked with nothing;
a text of fewer words than a shingle is one shingle; rows of one doc_id are one document,
linked with all that any of them is linked with (one output row per input row); a null
doc_id gets a null component and is kept; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import partitions, shared_table
from ._words import shingle_set

HASHES = 128
ROWS = 4
BANDS = 28
BATCH = 16
#: Members that a task takes together from small groups, and the most shuffle partitions, which bound the driver's part.
_BUNDLE, _PARTITIONS = 400, 20_000
_rng = np.random.default_rng(0x5EED)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values, 16 bits each."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 4096):
        part = folded[at : at + 4096]
        for k in range(0, HASHES, 16):
            x = part[:, None] * _MULTIPLY[k : k + 16] + _ADD[k : k + 16]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(least[k : k + 16], x.min(axis=0), out=least[k : k + 16])
    least ^= least >> np.uint32(16)
    return (least * np.uint32(0x45D9F3B) >> np.uint32(16)).astype(np.uint16)


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """Per batch end n the fewest matches among n hashes at which P(similarity >= threshold) >= miss,
    under a uniform prior: that posterior is the chance that Bin(n + 1, threshold) <= matches."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), words)
                counts.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "alt", "n_shingles", "set_key", "sig"],
            )

    return run


def _survivors(sigs: np.ndarray, sizes: np.ndarray, i: int, live: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Those of the rows ``live`` that may be as similar to row ``i`` as wanted, the most similar first."""
    small, large = np.minimum(sizes[live], sizes[i]), np.maximum(sizes[live], sizes[i])
    live = live[100 * small >= percent * large]
    matches, done = np.zeros(len(live), dtype=np.int64), 0
    for n, least in least_matches(percent / 100, miss):
        if not len(live):
            break
        matches += (sigs[live, done:n] == sigs[i, done:n]).sum(axis=1)
        keep = matches >= least
        live, matches, done = live[keep], matches[keep], n
    return live[np.argsort(-matches, kind="stable")]


def _cross(rows: pd.DataFrame, percent: int, miss: float):
    """Per row with other parts' rows before it (or, of probes, among the others): its survivors there, with the
    parts as ``label``, which the caller joins in place."""
    sigs = np.stack([np.frombuffer(s, dtype=np.uint16) for s in rows["sig"]])
    bands = np.ascontiguousarray(sigs[:, : ROWS * BANDS]).view(np.uint64)
    sizes, label, probes = rows["n"].to_numpy(), rows["had"].to_numpy().copy(), rows["probe"].to_numpy()
    rest = np.flatnonzero(~probes)
    asked = np.flatnonzero(probes) if probes.any() else range(1, len(rows))

    def run():
        for i in asked:
            live = rest if probes.any() else np.arange(i)
            live = live[label[live] != label[i]]
            if len(live) and len(live := live[(bands[live] == bands[i]).any(axis=1)]):
                yield i, _survivors(sigs, sizes, i, live, percent, miss)

    return label, run()


def _groups(rows: pd.DataFrame):
    rows = rows.drop_duplicates(["grp", "doc_id", "alt", "probe"]).sort_values(["grp", "doc_id", "alt"], kind="stable")
    for _, group in rows.groupby("grp", sort=False):
        yield group.reset_index(drop=True)


def _linked(words: int | None, percent: int, miss: float):
    """Links that join the parts of each group: survivors, if ``words`` is null, else those whose sets agree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for group in _groups(rows):
            ids = group["doc_id"].to_numpy()
            sets = [shingle_set(t, words) for t in group["text"]] if words else None
            label, found = _cross(group, percent, miss)
            for i, others in found:
                for j in others:
                    if label[j] == label[i]:
                        continue
                    if sets:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both < percent * (len(sets[i]) + len(sets[j]) - both):
                            continue
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[i]] = label[j]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _needed(percent: int, miss: float):
    """The rows of each group that have a survivor in another part, or are one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group in _groups(rows):
            hit = np.zeros(len(group), dtype=bool)
            for i, others in _cross(group, percent, miss)[1]:
                hit[others] = True
                hit[i] |= len(others) > 0
            out.append(group.loc[hit, ["doc_id", "alt", "grp", "task", "probe", "had"]])
        return pd.concat(out)

    return run


def _joining(groups: DataFrame, signed: DataFrame, texts: DataFrame | None, words: int | None, percent: int, miss: float, chunk: int, leaders: int) -> DataFrame:
    """Links ``(a, b)`` that join the members of ``groups(grp, doc_id, alt)`` as the relation has it; ``signed``
    has the members' sizes and signatures, ``texts`` their texts where sets are to be confirmed."""
    spark = groups.sparkSession
    name = ["doc_id", "alt"]
    sized = shared_table(groups.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    tasks = math.ceil(max(1, groups.count()) / _BUNDLE)
    parts = min(_PARTITIONS, max(partitions(spark), tasks))
    # A member's piece: by hash, so that the pieces of a group are about as large.
    members = groups.join(sized, "grp").withColumn("pieces", F.ceil(F.col("size") / F.lit(chunk)).cast("long"))
    members = members.withColumn("piece", F.pmod(F.xxhash64(*name, F.lit(7)), F.col("pieces")))
    members = shared_table(members, "pieces")  # once: a large group's members are read several times below
    all_pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
    small = members.where("pieces = 1").select(*name, "grp", F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("string")).alias("task"))
    large = members.where("pieces > 1")
    key = F.concat_ws(":", F.lit("l"), F.col("grp").cast("string"), F.col("piece").cast("string"))
    led = _first(large, leaders).select(*name, "grp", all_pieces)
    placed = small.union(large.select(*name, "grp", "piece").union(led).distinct().select(*name, "grp", key.alias("task")))
    placed = placed.withColumns({"probe": F.lit(False), "had": F.col("doc_id")})
    holding = signed if texts is None else signed.join(texts.hint("merge"), name)

    def confirm(rows: DataFrame, label: str) -> DataFrame:
        # The members grow with the corpus: always a merge join, never a broadcast.
        full = holding.join(rows.hint("merge"), name).repartition(parts, "task")
        return shared_table(full.groupBy("task").applyInPandas(_linked(words, percent, miss), "a long, b long"), label)

    links = confirm(placed, "links")
    if large.isEmpty():
        return links
    mid = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("joined"))
    state = large.join(mid, "doc_id", "left").withColumn("joined", F.coalesce("joined", "doc_id"))
    counts = state.groupBy("grp", "joined").agg(F.count("*").alias("n"))
    main = counts.groupBy("grp").agg(F.max_by("joined", F.struct("n", F.col("joined"))).alias("main"), F.count("*").alias("k")).where("k > 1")
    state = shared_table(state.join(main.select("grp", "main"), "grp"), "unjoined")
    if state.isEmpty():
        return links
    # Every pair of unjoined parts has a member outside its group's main part: these probe all pieces, in blocks.
    probes = state.where("joined <> main")
    blocks = probes.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("blocks"))
    probes = probes.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64(*name, F.lit(8)), F.col("blocks"))).drop("piece").select("*", all_pieces)
    rest = state.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.concat_ws(":", F.lit("p"), F.col("grp").cast("string"), F.col("piece").cast("string"), F.col("block").cast("string"))
    rows = [x.select(*name, "grp", pair.alias("task"), F.lit(probe).alias("probe"), F.col("joined").alias("had")) for x, probe in ((probes, True), (rest, False))]
    rows = rows[0].union(rows[1])
    if texts is not None:
        full = signed.join(rows.hint("merge"), name).repartition(parts, "task")
        schema = "doc_id long, alt long, grp long, task string, probe boolean, had long"
        rows = shared_table(full.groupBy("task").applyInPandas(_needed(percent, miss), schema), "needed")
    return links.union(confirm(rows, "more-links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-7, chunk: int = 1000, leaders: int = 32) -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``.

    ``percent``: documents are linked if 100 * |A and B| >= percent * |A or B| on sets of
    ``words``-word shingles.  The signatures' bands miss a pair at similarity 0.8 with
    chance 4e-7; ``miss`` bounds the posterior at which a batch drops a pair.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("alt"), F.col("text").cast("string").alias("text"))
    sketch = shared_table(base.mapInArrow(_sketch(words), "doc_id long, alt long, n_shingles long, set_key binary, sig binary"), "sketch")

    found = sketch.where("set_key is not null and doc_id is not null")
    classes = found.groupBy("set_key").agg(F.min(F.struct("doc_id", "alt", "sig", F.col("n_shingles").alias("n"))).alias("rep"))
    classes = shared_table(classes.select("set_key", "rep.*"), "classes")
    signed = classes.select("doc_id", "alt", "n", "sig")
    keys = [F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]
    bands = classes.select("doc_id", "alt", F.explode(F.array(*keys)).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    members = shared_table(bands.join(shared.hint("merge"), "band").select(F.col("band").alias("grp"), "doc_id", "alt"), "members")
    # Buckets of equal members, told by their number, first member and two sums of hashes, are one.
    of_members = [F.count("*").alias("k"), F.min("doc_id").alias("least"), F.bit_xor(F.xxhash64("doc_id", "alt")).alias("x"), F.bit_xor(F.xxhash64("alt", "doc_id", F.lit(9))).alias("y")]
    distinct = members.groupBy("grp").agg(*of_members).groupBy("k", "least", "x", "y").agg(F.min("grp").alias("grp")).select("grp")
    buckets = shared_table(members.join(distinct.hint("merge"), "grp"), "buckets")
    edges = _joining(buckets, signed, None, None, percent, miss, chunk, leaders)
    groups = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    groups = shared_table(groups.join(signed.select("doc_id", "alt").hint("merge"), "doc_id").select("grp", "doc_id", "alt"), "groups")
    texts = base.join(groups.select("doc_id", "alt").hint("merge"), ["doc_id", "alt"], "left_semi").dropDuplicates(["doc_id", "alt"])
    links = _joining(groups, signed, shared_table(texts, "texts"), words, percent, miss, chunk, leaders)

    joined = connected_components(links).toDF("doc_id", "component")
    ranked = classes.select("set_key", "doc_id").join(joined, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(ranked, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _first(large: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest members of each group; partial top-n runs before the shuffle."""
    order = Window.partitionBy("grp").orderBy("doc_id", "alt")
    return large.withColumn("rank", F.row_number().over(order)).where(f"rank <= {n}").select("doc_id", "alt", "grp", "pieces")
