"""Column expressions for ticket state, SLA, labels and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ticket model.
RESOLVED_STATUSES = (5, 6)
HIGH_PRIORITIES = (5, 6)
INCIDENT, REQUEST = 1, 2
ROOT_ENTITY = 0
SEVERITIES = ("CRITIQUE", "ÉLEVÉ", "MODÉRÉ", "FAIBLE")
CRITICALITY_FLOORS = (0.5, 0.25, 0.1)
VOLUME_FLOORS = (100, 50, 20)
SLA_FLOORS = ((90, "good"), (70, "warn"))
DAYS_PER_MONTH = 30.0
MICROS_PER_DAY = 86_400_000_000


def is_resolved(status: Column) -> Column:
    return F.coalesce(status.isin(*RESOLVED_STATUSES), F.lit(False))


def is_high_priority(priority: Column) -> Column:
    return F.coalesce(priority.isin(*HIGH_PRIORITIES), F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days, NULL when a bound is missing."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(MICROS_PER_DAY))


def is_open(resolved: Column) -> Column:
    return ~F.coalesce(resolved, F.lit(False))


def sla_met(solved: Column, deadline: Column) -> Column:
    """Solved, and in time when a deadline exists. An open ticket has not met its SLA."""
    return solved.isNotNull() & (deadline.isNull() | F.coalesce(solved <= deadline, F.lit(False)))


def sla_violated(
    solved: Column, closed: Column, deadline: Column, now: Column | None = None
) -> Column:
    """Done after the deadline, or not done although a deadline exists.

    With ``now`` an unfinished ticket counts only once its deadline is past.
    """
    done = F.coalesce(solved, closed)
    unfinished = done.isNull() & deadline.isNotNull()
    if now is not None:
        unfinished = unfinished & (deadline < now)
    return F.coalesce(F.when(done.isNotNull(), done > deadline).otherwise(unfinished), F.lit(False))


def share(condition: Column) -> Column:
    """Aggregate: part of the rows that satisfy ``condition`` (a NULL does not)."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def day_micros(days: Column) -> Column:
    """Days as whole microseconds: their sum is exact, whatever order tasks finish in."""
    return F.round(days * F.lit(float(MICROS_PER_DAY))).cast("decimal(20,0)")


def mean_of_micros(total: Column, n: Column) -> Column:
    """Mean in days; NULL when ``n`` is 0."""
    return F.try_divide(total.cast("double"), n) / F.lit(float(MICROS_PER_DAY))


def mean_days(days: Column) -> Column:
    """Aggregate: repeatable mean of a column of days."""
    return mean_of_micros(F.sum(day_micros(days)), F.count(days))


def percent(ratio: Column, digits: int = 1) -> Column:
    return F.bround(ratio * 100.0, digits)


def months_active(first: Column, last: Column, whole_days: bool = False) -> Column:
    days = days_between(first, last)
    if whole_days:
        days = F.floor(days).cast("double")
    return F.coalesce(F.greatest(days / DAYS_PER_MONTH, F.lit(1.0)), F.lit(1.0))


def _first_floor(value: Column, floors, labels) -> Column:
    band = F.when(value >= floors[0], labels[0])
    for floor, label in zip(floors[1:], labels[1:]):
        band = band.when(value >= floor, label)
    return band.otherwise(labels[len(floors)])


def criticality_band(high_ratio: Column) -> Column:
    return _first_floor(high_ratio, CRITICALITY_FLOORS, SEVERITIES)


def severity_band(count: Column) -> Column:
    return _first_floor(count, VOLUME_FLOORS, SEVERITIES)


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value, F.lit(0.0))))


def sla_band(value: Column) -> Column:
    floors, labels = zip(*SLA_FLOORS)
    return _first_floor(clamp_percent(value), floors, (*labels, "bad"))


def severity_order(severity: Column) -> Column:
    """Sort key, most severe first; unknown labels sort with the mildest."""
    key = F.when(severity == SEVERITIES[0], 0)
    for rank in (1, 2):
        key = key.when(severity == SEVERITIES[rank], rank)
    return key.otherwise(3)


def user_display_name(fact_id: Column) -> Column:
    """Name of a user row joined from the LEFT; falls back to the fact-side id."""
    full = F.trim(
        F.concat(
            F.coalesce(F.col("realname"), F.lit("")),
            F.lit(" "),
            F.coalesce(F.col("firstname"), F.lit("")),
        )
    )
    return F.coalesce(
        F.nullif(full, F.lit("")),
        F.col("name"),
        F.concat(F.lit("user #"), fact_id.cast("string")),
        F.lit("Inconnu"),
    )


def fallback_label(name: Column, fact_id: Column, prefix: str, missing: str) -> Column:
    """``name``, else "<prefix> #<id>", else ``missing`` when the fact has no id at all."""
    return F.coalesce(name, F.concat(F.lit(f"{prefix} #"), fact_id.cast("string")), F.lit(missing))


def not_expired(expires: Column, now: Column) -> Column:
    return expires.isNull() | (expires > now)


def not_root_entity(entity: Column) -> Column:
    return entity.isNull() | (entity != ROOT_ENTITY)
