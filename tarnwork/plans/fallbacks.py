"""What a plan does when its steps find too little, and steps that run side by side.

Strategies rewrite the query and ask the plan's first action again: ``decomposition`` takes the part of a joined query with most
search terms, ``expansion`` writes acronyms out and adds other names of topics, ``narrowing`` keeps the two longest terms,
``reformulation`` keeps the terms alone.  Rules stand where a language model may be asked instead: ``rewriters`` takes others.

Steps that don't depend on each other are Spark jobs of their own groups, started together; a step that runs out of its time has
its jobs cancelled and counts as failed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..functions.aliases import TOPIC_ALIASES
from ..functions.text import ACRONYMS
from .routing import NO_TERMS
from .steps import Execution, Outcome, Step, combine, execute, in_order, quality_of

_JOINTS = re.compile(r"(?i)\s+(?:and|or|versus|vs|as well as|along with|together with)\s+|[,;]\s*")


def terms(query: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if len(w) > 2 and w not in NO_TERMS]


def decomposition(query: str) -> str:
    """The part with most terms, the first of equal ones."""
    parts = [p.strip() for p in _JOINTS.split(query) if p.strip()]
    return max(parts, key=lambda p: len(terms(p)), default=query)


def expansion(query: str) -> str:
    """Acronyms written out, then the other names of topics that the query has."""
    words = [ACRONYMS.get(w.lower(), w) for w in query.split()]
    more = [alias for w in terms(query) for alias in TOPIC_ALIASES.get(w, ())]
    return " ".join([*words, *dict.fromkeys(more)])


def narrowing(query: str) -> str:
    """The two longest terms, in their order."""
    kept = sorted(terms(query), key=len, reverse=True)[:2]
    return " ".join(w for w in terms(query) if w in kept) or query


def reformulation(query: str) -> str:
    return " ".join(terms(query)) or query


REWRITERS: dict[str, Callable[[str], str]] = {"reformulation": reformulation, "decomposition": decomposition, "expansion": expansion, "narrowing": narrowing}


def with_strategies(steps: list[Step], actions: dict, strategies: tuple[str, ...], rewriters: dict[str, Callable[[str], str]] | None = None, structured: tuple[str, ...] = ("registry",)) -> Execution:
    """``execute`` whose fallbacks are strategies: each asks the first step's action with the rewritten query.  A strategy that is not
    known fails and is no retry."""
    known = {**REWRITERS, **(rewriters or {})}
    first = steps[0].action if steps else ""

    def asked(name: str) -> Callable:
        return lambda query, parent: actions[first](known[name](query), parent)

    return execute(steps, {**actions, **{name: asked(name) for name in strategies}}, list(strategies), (*structured, *(strategies if first in structured else ())))


def execute_together(spark: SparkSession, steps: list[Step], actions: dict[str, Callable[[str, DataFrame | None], DataFrame]], seconds: float = 60.0, structured: tuple[str, ...] = ("registry",), at_once: int = 4) -> Execution:
    """Run steps level by level, those of a level at the same time; a step takes at most ``seconds`` from its level's start."""
    run, found, left = Execution(), {}, in_order(steps)

    def one(step: Step, group: str) -> Outcome:
        spark.sparkContext.setJobGroup(group, f"plan step {step.id}", interruptOnCancel=True)
        rows = combine(found, step.sources) if step.action == "combine" else actions[step.action](step.query, found.get(step.parent))
        if rows is None:
            return Outcome(step.id, None, 0.0, "no source results to combine")
        n = len(rows.take(20))
        return Outcome(step.id, rows, quality_of(n, 0) if step.action in structured else quality_of(0, n))

    with ThreadPoolExecutor(at_once) as pool:
        while left:
            told = {o.step for o in run.outcomes}
            ready = [s for s in left if (s.parent is None or s.parent in found) and all(x in told or x not in {y.id for y in steps} for x in s.sources)]
            if not ready:
                break
            groups = {s.id: f"plan-{uuid.uuid4().hex}" for s in ready}
            running = {s.id: pool.submit(inheritable_thread_target(one), s, groups[s.id]) for s in ready}
            for step in ready:
                try:
                    out = running[step.id].result(timeout=seconds)
                except Late:
                    spark.sparkContext.cancelJobGroup(groups[step.id])
                    out = Outcome(step.id, None, 0.0, f"took more than {seconds:g} seconds")
                except Exception as error:  # a failed step is an outcome, not the end of the plan
                    out = Outcome(step.id, None, 0.0, str(error))
                run.outcomes.append(out)
                if out.success:
                    found[step.id] = out.rows
            left = [s for s in left if s not in ready]
    return run
