"""A group's members are told their group's size once, however large the group is."""

from __future__ import annotations

import random
import re
import time

from tarnwork.llm import near_dedup


def joined_rows(spark, since):
    """Rows that inner joins on a group's number gave out since an execution."""
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range((every := store.executionsList()).size()):
        if (e := every.apply(k).executionId()) <= since:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            if re.search(r"Join \[grp#\w+\], \[grp#\w+\], Inner", node.desc()):
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        out += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


def test_members_are_joined_with_their_group_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(300)]
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    given = []
    real = near_dedup._joining
    monkeypatch.setattr(near_dedup, "_joining", lambda groups, *rest: given.append(groups.count()) or real(groups, *rest))
    frame.count()
    before = (every := spark._jsparkSession.sharedState().statusStore().executionsList()).apply(every.size() - 1).executionId()
    found = near_dedup.near_duplicates(frame, words=4, chunk=10, leaders=2)
    assert {r.component_id for r in found.collect()} == {0}
    time.sleep(2)
    made = joined_rows(spark, before)
    # each member once where equal buckets become one, and once in each of the two steps
    assert 0 < made <= 1.2 * (given[0] + sum(given))
