"""Answer scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score levels and the rounded base of the logistic curve.
NO_EVIDENCE = 0.3
UNDECIDED = 0.5
DATA_FOUND = 0.75
HIT_FLOOR = 0.6
HIT_RANGE = 0.3
LOGISTIC_BASE = 2.71828

# A Java double may also be written "1d" or in hex, which is no number in a judge's reply.
NUMBER = r"(?i)^([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan)$"


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(LOGISTIC_BASE), -x))


def base_score(answer_type: Column, n_rows: Column, failed: Column, n_hits: Column, mean_rerank: Column) -> Column:
    """Score before judging: by result rows for data answers, by rerank score otherwise."""
    rows = F.coalesce(n_rows, F.lit(0))
    data = (
        F.when((rows > 0) & ~F.coalesce(failed, F.lit(False)), DATA_FOUND)
        .when(rows == 0, NO_EVIDENCE)
        .otherwise(UNDECIDED)
    )
    retrieved = F.when(
        F.coalesce(n_hits, F.lit(0)) > 0,
        HIT_FLOOR + HIT_RANGE * logistic(F.coalesce(mean_rerank, F.lit(0.0))),
    ).otherwise(NO_EVIDENCE)
    return F.when(F.coalesce(answer_type == "data", F.lit(False)), data).otherwise(retrieved)


def final_score(base: Column, judge_text: Column) -> Column:
    """Mean of the base score and the judge's number in [0, 1]; the base alone if it is no number."""
    text = F.trim(judge_text)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    # Not least() and greatest(): they skip nulls. NaN compares as greatest and so gives 1.
    judged = F.when(number > 1, F.lit(1.0)).when(number < 0, F.lit(0.0)).otherwise(number)
    return (base + F.coalesce(judged, base)) / 2
