"""Forgetting score, memory weight and lifecycle of retrieved documents, as column expressions.

Times are unix seconds; "now" is always a parameter.  Unknown documents (null last access) score 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of the forgetting score, of the final score and of the memory weight.
LAMBDA, ALPHA, BETA, WEIGHT, THRESHOLD = 0.1, 0.3, 0.5, 0.3, 0.7
W_TIME, W_FEEDBACK, W_REDUNDANCY, PRIOR, PRIOR_K = 0.5, 0.3, 0.2, 0.5, 2
#: Lifecycle states by lower bound of the weight, and how much they attenuate.
STATES = (("Active", 0.8, 1.0), ("Warm", 0.5, 0.8), ("Cold", 0.2, 0.5))
ARCHIVED, SUPPRESSED, SUPPRESSED_UPTO = ("Archived", 0.2), ("Suppressed", 0.05), 0.05


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def forgetting_score(last: Column, uses: Column, total: Column, correct: Column, now, lam=LAMBDA, alpha=ALPHA, beta=BETA) -> Column:
    """0 is fresh, 1 forgotten: (1 - e^(-lam days)) / (1 + alpha uses) * (1 - beta accuracy), within [0, 1]."""
    days = (_num(now) - last) / 86400.0
    accuracy = F.when(total > 0, correct / total).otherwise(0.5)
    raw = (1.0 - F.exp(-_num(lam) * days)) * (1.0 / (1.0 + _num(alpha) * uses)) * (1.0 - accuracy * _num(beta))
    return F.coalesce(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), F.lit(0.5))


def final_score(similarity: Column, score: Column, weight=WEIGHT) -> Column:
    return similarity * (1.0 - score * _num(weight))


def w_time(last: Column, now, lam=LAMBDA) -> Column:
    return F.exp(-_num(lam) * (_num(now) - last) / 86400.0)


def w_feedback(success: Column, total: Column, prior=PRIOR, k=PRIOR_K) -> Column:
    return (success + _num(prior) * _num(k)) / (total + _num(k))


def memory_weight(time: Column, feedback: Column, redundancy: Column, a=W_TIME, b=W_FEEDBACK, c=W_REDUNDANCY) -> Column:
    return _num(a) * time + _num(b) * feedback + _num(c) * redundancy


def lifecycle_state(weight: Column) -> Column:
    """Suppressed is tested before Archived, whose range it lies in."""
    out = F.when(weight <= SUPPRESSED_UPTO, SUPPRESSED[0])
    for name, above, _ in STATES:
        out = out.when(weight > above, name)
    return out.when(weight.isNotNull(), ARCHIVED[0])


def attenuation(state: Column) -> Column:
    out = F.when(state == SUPPRESSED[0], SUPPRESSED[1]).when(state == ARCHIVED[0], ARCHIVED[1])
    for name, _, factor in STATES:
        out = out.when(state == name, factor)
    return out


def retrievable(state: Column) -> Column:
    return ~state.isin(ARCHIVED[0], SUPPRESSED[0])
