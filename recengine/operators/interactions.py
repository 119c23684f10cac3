"""Interaction building from raw logs.

Logs are joined to their dictionaries (equi-joins; E6 soft lookups drop
unknown keys), then reduced with ``groupBy`` -- partial aggregation keeps a
hot user or course from landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.operators.joins import last_writer_map
from recengine.operators.ordering import ranked


def completion_rating(progress: str | Column, threshold: float = 0.8) -> Column:
    """5 when progress >= t, else ``5 * sqrt(progress / t)``."""
    p = F.col(progress) if isinstance(progress, str) else progress
    return F.when(p >= threshold, F.lit(5.0)).otherwise(5.0 * F.sqrt(p / F.lit(threshold)))


def behaviour_interactions(activity: DataFrame, resource_course: DataFrame, threshold: float = 0.5,
                           distinct: bool = True, user: str = "user_id", resource: str = "resource",
                           course: str = "course", ts: str = "ts") -> DataFrame:
    """Activity rows ``(user, resource, ts)`` -> course interactions.

    ``resource_course(resource, course)`` is the many-to-one map (build it with
    ``last_writer_map`` for last-writer-wins).  progress = resources touched /
    course size (``distinct=True`` counts each resource once; ``False``
    counts rows, the reference's repeat-inflated variant), rating = J1,
    time = first activity."""
    size = resource_course.groupBy(course).agg(F.countDistinct(resource).alias("course_size"))
    rows = activity.join(resource_course, resource)          # soft lookup: unknown resources drop
    touched = F.countDistinct(resource) if distinct else F.count(resource)
    agg = rows.groupBy(user, course).agg(touched.alias("touched"), F.min(ts).alias("first_ts"))
    out = agg.join(size, course).withColumn("progress", F.col("touched") / F.col("course_size"))
    return out.withColumn("rating", completion_rating("progress", threshold))


def exercise_interactions(problem_log: DataFrame, exercise_problem: DataFrame, user: str = "user_id",
                          problem: str = "problem", exercise: str = "exercise", ts: str = "ts",
                          pos: str = "input_pos") -> DataFrame:
    """Problem log -> distinct (user, exercise) through the
    exercise-problem relation.  A problem that stands in several exercises
    belongs to the last one in input order; problems of no exercise drop.
    ``ts`` is the time of the user's first kept row in input order, one per
    user.  ``pos`` orders both inputs (``sources.positions``)."""
    owner = last_writer_map(exercise_problem, problem, exercise, [pos])
    rows = problem_log.join(owner, problem)
    first = rows.groupBy(user).agg(F.min_by(ts, pos).alias(ts))
    return rows.select(user, exercise).distinct().join(first, user)


def enrolment_interactions(enrolments: DataFrame, min_items: int = 3, test_frac: float = 0.2,
                           user: str = "user_id", item: str = "item_id", pos: str = "pos") -> DataFrame:
    """Enrolment rows ``(user, item, pos)`` (the exploded course order):
    users with at least ``min_items``; the last ``ceil(frac * n)`` by
    position go to test; rating 1."""
    counts = enrolments.groupBy(user).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_items)
    keep = enrolments.join(counts.select(user), user, "left_semi")
    r = ranked(keep, [user], [F.col(pos).desc(), F.col(item).desc()], rank_col="__r", size_col="__n")
    split = F.when(F.col("__r") <= F.ceil(F.lit(test_frac) * F.col("__n")), "test").otherwise("train")
    return r.select(user, item, F.lit(1).alias("rating"), split.alias("split"))


def citation_interactions(citations: DataFrame, lo: int = 5, hi: int = 100, src: str = "paper",
                          dst: str = "reference") -> DataFrame:
    """Citation rows (sentinel -1 = no reference) -> ``(user=paper,
    item=reference, rating=1)`` for papers citing between ``lo`` and ``hi``
    (inclusive) references."""
    valid = citations.filter((F.col(dst) != -1) & F.col(dst).isNotNull())
    ok = valid.groupBy(src).agg(F.count(dst).alias("__n")).filter(F.col("__n").between(lo, hi))
    return (valid.join(ok.select(src), src, "left_semi")
            .select(F.col(src).alias("user_id"), F.col(dst).alias("item_id"), F.lit(1).alias("rating")))
