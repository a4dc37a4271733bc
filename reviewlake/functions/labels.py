"""Rating and class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.text import strings

SCHEMES = {"excellent": lx.LABELS_EXCELLENT, "amazing": lx.LABELS_AMAZING}


def rating_label(rating: Column, scheme: str = "excellent") -> Column:
    """Label of a rating 1..5; anything else, null included, is `unknown`."""
    labels = strings(SCHEMES[scheme])
    known = rating.isin(1, 2, 3, 4, 5)
    return F.when(known, F.element_at(labels, rating.cast("int"))).otherwise("unknown")


def class_label(prediction: Column, scheme: str = "amazing") -> Column:
    """Label of a predicted class: 1..5 count from one, others are clamped to 0..4."""
    p = prediction.cast("int")
    index = F.when(p.between(1, 5), p - 1).otherwise(p)
    clamped = F.greatest(F.lit(0), F.least(F.lit(4), index))
    return F.when(p.isNotNull(), F.element_at(strings(SCHEMES[scheme]), clamped + 1))


def polarity(label: Column) -> Column:
    """positive / negative / neutral group of a label in either scheme."""
    return (
        F.when(label.isin(*lx.NEGATIVE_LABELS), "negative")
        .when(label.isin(*lx.POSITIVE_LABELS), "positive")
        .otherwise("neutral")
    )
