"""Cross links against a loop over all pairs of people and resources."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tarnwork.operators import registry
from tarnwork.session import reachable


def plain(name):
    return (name or "").lower().strip(" ").replace("-", " ").replace("_", " ")


def test_every_pair_with_evidence(spark):
    reachable(spark)
    rng = random.Random(3)
    near = lambda name: "".join(c for c in name if rng.random() > 0.12)
    names = ["Ann Lee", "Bo", "A", None, "Maria-del Carmen", "jo_hn smith"] + ["".join(rng.choices("abc ", k=rng.randint(1, 14))) for _ in range(60)]
    topics = ["machine", "Machinery", "a b", "x", "tools,", "", None, "net works"]
    people = [(i, n, f"u{i}", rng.sample(topics, 2)) for i, n in enumerate(names)]
    texts = [None, "old machines, tools, more", "machinery, tools", "fox", "internet worksheets", ""]
    owners = [near(n) if n and k else n for k in (0, 1, 1) for n in names] + ["", "u3", " "]
    resources = [(i, f"u{i % 9}", o, "u5" if i % 7 == 0 else None, rng.choice(texts)) for i, o in enumerate(owners)]
    found = registry.cross_links(spark.createDataFrame(people, "person_id int, name string, username string, topics array<string>"), spark.createDataFrame(resources, "resource_id int, path_user string, owner string, created_by string, description string"))
    want = {}
    for p, name, user, wanted in people:
        for r, path, owner, by, text in resources:
            score = 1.0 * (path == user) + 0.9 * ((owner or "").lower() == user or by == user)
            score += 0.7 * (bool(owner) and SequenceMatcher(None, plain(name), plain(owner)).ratio() > 0.8)
            score += 0.3 * any(t is not None and t.lower() in (text or "").lower() for t in wanted)
            if score:
                want[p, r] = round(score, 6)
    assert {(r.person_id, r.resource_id): r.score for r in found.collect()} == want
    assert sum(s in (0.7, 1.0) for s in want.values()) > 20


def test_topic_pairs_are_not_shuffled(spark):
    """Pairs of people and resources that a topic links arise behind the last exchange, and each once."""
    people = spark.range(300).selectExpr("id as person_id", "concat('u', id) as username", "array('gears', if(id % 2 = 0, 'hot', 'x')) as topics")
    resources = spark.range(200).selectExpr("id % 150 as resource_id", "concat('u', id) as path_user", "'u1' as owner", "cast(null as string) as created_by", "if(id % 3 = 0, 'hot gears', 'gears') as description")
    found = registry.cross_links(people, resources, block=40)
    rows = found.collect()
    assert len(rows) == len({(r.person_id, r.resource_id) for r in rows}) == 300 * 150
    assert {r.score for r in rows} == {0.3, 1.2, 1.3, 2.2}
    plan = found._jdf.queryExecution().optimizedPlan()
    assert not any(name in plan.nodeName() for name in ("Aggregate", "Repartition"))
    assert "Aggregate" not in plan.toString().split("Project")[0]
    parts = registry.cross_links(people, resources, block=40).select("person_id", "resource_id").where("person_id > 250")
    assert parts.count() == 49 * 150


def test_rows_arise_a_few_people_at_a_time(spark):
    """No row that pairs arise from holds a whole block of people, however many pairs are known and null ids among them."""
    rng = random.Random(5)
    people, held = [*range(100), None], [*range(70), None]
    for share in (0, 0.02, 1):
        known = [(p, [r for r in held if rng.random() < 0.5]) for p in people if rng.random() < share]
        frame = spark.createDataFrame([(people, held, known or None)], "persons array<int>, held array<int>, known array<struct<person_id: int, own: array<int>>>")
        found = frame.select(registry.groups(F.col("persons"), F.col("held"), F.col("known")).alias("g")).first().g
        assert max(len(g.persons) for g in found) == (16 if share < 1 else 1)
        pairs = [(p, r) for g in found for p in g.persons for r in g.held]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(p, r) for p in people for r in held} - {(p, r) for p, own in known for r in own}


def test_pairs_arise_from_groups(spark):
    people = spark.range(300).selectExpr("id as person_id", "concat('u', id) as username", "array('gears') as topics")
    resources = spark.range(200).selectExpr("id as resource_id", "'u1' as path_user", "'' as owner", "cast(null as string) as created_by", "'gears' as description")
    generated = registry.cross_links(people, resources)._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert [line.split("Generate ")[1].split("(")[0] for line in generated.splitlines() if "Generate " in line] == ["explode", "explode", "explode"]
