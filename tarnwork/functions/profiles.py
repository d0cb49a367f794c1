"""Dispositions of voices: nested documents of eighteen traits, as structs and as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The traits by group; all are 0.5 by default but the style of curiosity, which is a word.
TRAITS = {
    "epistemic_appetite": ("curiosity_style", "scope", "surprise_seeking"),
    "cognitive_style": ("thinking_mode", "abstraction", "classification"),
    "methodological": ("making_style", "formalism", "tacit_explicit"),
    "social": ("disclosure", "inquiry", "collaboration", "competition"),
    "temporal": ("paradigm_orientation", "patience", "archival"),
    "aesthetic": ("elegance_completeness", "mechanism_phenomenon", "risk"),
}
DEFAULT, STYLE = 0.5, "hunter"
_SCHEMA = ", ".join(f"{g} struct<" + ", ".join(f"{t}: {'string' if t == 'curiosity_style' else 'double'}" for t in ts) + ">" for g, ts in TRAITS.items())


def disposition(document: Column) -> Column:
    """The struct of a JSON document; what is missing has its default."""
    raw = F.from_json(document, _SCHEMA)
    value = lambda g, t: F.coalesce(raw[g][t], F.lit(STYLE) if t == "curiosity_style" else F.lit(DEFAULT)).alias(t)
    return F.struct(*[F.struct(*[value(g, t) for t in ts]).alias(g) for g, ts in TRAITS.items()])


def disposition_json(struct: Column) -> Column:
    return F.to_json(struct)


def disposition_vector(struct: Column) -> Column:
    """The eighteen numbers in order, without the word."""
    return F.array(*[struct[g][t] for g, ts in TRAITS.items() for t in ts if t != "curiosity_style"])
