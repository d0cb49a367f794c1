"""Random strings of every encoding and of the usual lengths of keys are told, ordinary runs are not."""

from __future__ import annotations

import random
from collections import defaultdict

from tarnwork.llm import secrets

PLAIN = [
    "20240131123045000000", "00000000000000000001", "01234567890123456789", "10000000000000000000", "2024013120240201202402", "0000000000000000001A", "DEADBEEFCAFE0000FFFF0001",
    "ABCDEFABCDEFABCDEFABCDEF", "FACADEDECADE20240131BEADED", "A1A1A1A1A1A1A1A1A1A1A1A1", "0123456789ABCDEF0123456789ABCDEF", "00112233445566778899AABBCCDDEEFF",
]
#: The least share told of 40 random strings, by length; 20 characters of 32 or 36 letters are close to words.
LEAST = {20: {0: 0.4, 1: 0.5, 2: 0.5, 3: 0.05, 4: 0.25, 5: 0.25, 6: 0.8, 7: 0.8}, 32: {3: 0.6, 4: 0.7, 5: 0.7}, 40: {}, 64: {}}


def test_every_encoding_is_told_at_every_length(spark):
    rng = random.Random(9)
    keys = [(e, n, "".join(rng.choices(letters, k=n))) for e, (_, letters) in enumerate(secrets.ENCODINGS) for n in LEAST for _ in range(40)]
    texts = [f"some {k} here" for _, _, k in keys] + PLAIN
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(frame)).collect()}
    told = defaultdict(float)
    for i, (e, n, _) in enumerate(keys):
        told[e, n] += (found[i].n_random + found[i].n_hex > 0) / 40
    assert not [(e, n, told[e, n]) for n, least in LEAST.items() for e in range(len(secrets.ENCODINGS)) if told[e, n] < least.get(e, 0.85)]
    assert not [t for i, t in enumerate(PLAIN, len(keys)) if found[i].n_random]
