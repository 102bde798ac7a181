"""Column expressions over ``map<string,string>`` way tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline import constants as K


def _tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def lifecycle_value(tags: Column) -> Column:
    """Value of the first lifecycle-prefixed highway key, in vocabulary order."""
    return F.coalesce(*[_tag(tags, f"{p}:highway") for p in K.LIFECYCLE_PREFIXES])


def has_lifecycle(tags: Column) -> Column:
    return F.coalesce(
        F.exists(
            F.map_keys(tags),
            lambda k: k.isin([f"{p}:highway" for p in K.LIFECYCLE_PREFIXES]),
        ),
        F.lit(False),
    )


def visibility_weight(visibility: Column) -> Column:
    """Loss weight of a visibility grade; unknown and missing grades weigh 1."""
    out = F.lit(1.0)
    for grade, weight in K.VISIBILITY_WEIGHT.items():
        out = F.when(visibility == grade, F.lit(weight)).otherwise(out)
    return out


def visibility_class(tags: Column) -> Column:
    return (
        F.when(has_lifecycle(tags), F.lit("lifecycle"))
        .when(_tag(tags, "trail_visibility").isin(*K.FAINT_VISIBILITY), F.lit("faint"))
        .otherwise(F.lit("active"))
    )


def classify_kind(tags: Column) -> Column:
    """trail / excluded / water, or NULL where the way is not evidence at all."""
    water = _tag(tags, "waterway")
    life = lifecycle_value(tags)
    highway = _tag(tags, "highway")
    hidden = (
        F.coalesce(_tag(tags, "surface").isin(*K.INVISIBLE_SURFACES), F.lit(False))
        | F.coalesce(_tag(tags, "bridge").isin("yes", "boardwalk"), F.lit(False))
        | F.coalesce(_tag(tags, "tunnel") == "yes", F.lit(False))
    )
    return (
        F.when(water.isNotNull(), F.when(water.isin(*K.WATERWAYS), F.lit("water")))
        .when(
            life.isNotNull(),
            F.when(life.isin(*K.ACTIVE_HIGHWAYS, *K.LIFECYCLE_ONLY_HIGHWAYS), F.lit("trail")),
        )
        .when(F.coalesce(highway.isin(*K.ACTIVE_HIGHWAYS), F.lit(False)),
              F.when(hidden, F.lit("excluded")).otherwise(F.lit("trail")))
    )


def classify_weight(tags: Column) -> Column:
    """Loss weight that goes with ``classify_kind``; NULL where the kind is NULL."""
    kind = classify_kind(tags)
    return (
        F.when(kind == "trail",
               F.when(has_lifecycle(tags), F.lit(K.LIFECYCLE_WEIGHT))
               .otherwise(visibility_weight(_tag(tags, "trail_visibility"))))
        .when(kind.isNotNull(), F.lit(0.0))
    )


def classify_way(tags: Column) -> Column:
    return F.struct(classify_kind(tags).alias("kind"), classify_weight(tags).alias("weight"))


def evidence_kind(tags: Column) -> Column:
    """lifecycle / faint for rare trail evidence, NULL for everything else.

    A lifecycle-tagged way that is not a trail stays NULL even if it also
    carries a faint grade.
    """
    cls = visibility_class(tags)
    return F.when((classify_kind(tags) == "trail") & cls.isin("lifecycle", "faint"), cls)
