"""Score, rule and parsing expressions for one candidate row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import bounded_preference, col, round_dp

# Weights of the score parts and of the label adjustment (fixed values).
WEIGHTS = {"qed": 0.45, "rules": 0.25, "mw": 0.15, "tpsa": 0.10, "rotatable": 0.05, "label": 0.05}
RULE_LIMITS = {"mw": 500, "hba": 10, "hbd": 5, "logp": 5}
# Numbers as a text parser accepts them: digit groups may be joined by "_".
_DIGITS = r"\d+(_\d+)*"
FLOAT_TEXT = rf"(?i)^[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf(inity)?|nan)$"


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def priority_score(
    mw: Column | str, tpsa: Column | str, rotatable: Column | str, qed: Column | str,
    rules_pass: Column | str, label: Column | str, probability: Column | str, valid: Column | str,
) -> Column:
    """Weighted preference score in [0, 1]; 0 for invalid rows or rows without descriptors."""
    p = F.coalesce(col(probability).cast("double"), F.lit(0.0))
    excess = F.greatest(F.lit(0.0), col(rotatable).cast("double") - 10)
    parts = {
        "qed": col(qed).cast("double"),
        "rules": F.when(col(rules_pass), 1.0).otherwise(0.4),
        "mw": bounded_preference(mw, 150, 500),
        "tpsa": bounded_preference(tpsa, 20, 140),
        "rotatable": F.greatest(F.lit(0.0), 1 - excess / 10),
        "label": F.when(col(label) == "high", p).when(col(label) == "low", -p).otherwise(0.0),
    }
    raw = _total([F.lit(WEIGHTS[name]) * part for name, part in parts.items()])
    score = round_dp(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)
    usable = F.coalesce(col(valid), F.lit(False)) & raw.isNotNull()
    return F.when(usable, score).otherwise(0.0)


def rule_violations(mw: Column | str, hba: Column | str, hbd: Column | str, logp: Column | str) -> Column:
    """How many of the four limits are exceeded (evaluated on unrounded values)."""
    values = {"mw": mw, "hba": hba, "hbd": hbd, "logp": logp}
    return _total([(col(values[k]) > limit).cast("int") for k, limit in RULE_LIMITS.items()])


def complexity(
    heavy: Column | str, rings: Column | str, bridgeheads: Column | str, spiro: Column | str,
    chiral: Column | str, hetero: Column | str, valid: Column | str,
) -> Column:
    """Struct ``(sa_score, synthetic_feasibility_category, synthetic_feasibility_status)``."""
    raw = _total([
        F.lit(1.0),
        col(heavy) / 25,
        col(rings) * 0.35,
        (col(bridgeheads) + col(spiro)) * 0.75,
        col(chiral) * 0.5,
        col(hetero) / 20,
    ])
    ok = F.coalesce(col(valid), F.lit(False)) & raw.isNotNull()
    score = F.when(ok, round_dp(F.least(F.lit(10.0), F.greatest(F.lit(1.0), raw)), 3))
    category = (
        F.when(score <= 3, "easy").when(score <= 6, "moderate").when(score > 6, "difficult")
        .otherwise("not_available")
    )
    status = (
        F.when(ok, "heuristic_synthetic_accessibility")
        .when(F.coalesce(col(valid), F.lit(False)), "not_run").otherwise("not_run_invalid_molecule")
    )
    return F.struct(
        score.alias("sa_score"),
        category.alias("synthetic_feasibility_category"),
        status.alias("synthetic_feasibility_status"),
    )


def parse_docking(raw: Column | str, present: bool = True) -> Column:
    """Struct ``(docking_score, docking_status)`` from optional input text."""
    if not present:
        return F.struct(
            F.lit(None).cast("double").alias("docking_score"),
            F.lit("not_provided").alias("docking_status"),
        )
    text = F.regexp_replace(col(raw), r"^\s+|\s+$", "")
    number = F.when(
        text.rlike(FLOAT_TEXT), F.regexp_replace(text, "_", "").try_cast("double")
    )
    return F.struct(
        number.alias("docking_score"),
        F.when(number.isNull(), "invalid_docking_score").otherwise("provided").alias("docking_status"),
    )


def normalize_label(raw: Column | str) -> Column:
    """high / low / uncertain from a raw model label; negative terms win."""
    text = F.lower(col(raw).cast("string"))
    return (
        F.when(text.rlike("|".join(V.LOW_TERMS)), "low")
        .when(text.rlike("|".join(V.HIGH_TERMS)), "high")
        .otherwise("uncertain")
    )
