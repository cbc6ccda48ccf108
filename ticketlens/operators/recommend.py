"""Recommendation rules over profiles, forecasts, SLA and clusters."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.ids import reco_id
from ticketlens.operators.forecast import peak_and_mean


# Types, severities and thresholds of the four rules.
@dataclass(frozen=True)
class Formation:
    enabled: bool = True
    type: str = "FORMATION"
    severity: str = "ÉLEVÉ"
    profile: str = "critique"
    incident_concentration_pct: float = 80.0
    max_categories: int = 2


@dataclass(frozen=True)
class Surcharge:
    enabled: bool = True
    type: str = "SURCHARGE"
    severity: str = "CRITIQUE"
    volume_multiplier: float = 1.5
    sla_threshold_pct: float = 90.0


@dataclass(frozen=True)
class CauseRacine:
    enabled: bool = True
    type: str = "CAUSE_RACINE"
    severity: str = "CRITIQUE"
    algorithm: str = "dbscan"
    min_tickets: int = 100
    window_days: int = 30


@dataclass(frozen=True)
class Automatisation:
    enabled: bool = True
    type: str = "AUTOMATISATION"
    severity: str = "MODÉRÉ"
    min_repetitive: int = 30


@dataclass(frozen=True)
class Rules:
    expires_days: int = 14
    formation: Formation = field(default_factory=Formation)
    surcharge: Surcharge = field(default_factory=Surcharge)
    cause_racine: CauseRacine = field(default_factory=CauseRacine)
    automatisation: Automatisation = field(default_factory=Automatisation)

    @staticmethod
    def from_mapping(data: dict) -> "Rules":
        """Rules from a parsed document: ``{"expires_days": …, "rules": {<name>: {…}}}``."""
        base = Rules(expires_days=int(data.get("expires_days", 14)))
        changed = {}
        for name, values in data.get("rules", {}).items():
            rule = getattr(base, name)
            known = {f.name for f in fields(rule)}
            changed[name] = replace(rule, **{k: v for k, v in values.items() if k in known})
        return replace(base, **changed)


def load_rules(path: str | None = None) -> Rules:
    """Rules from a YAML file (JSON works too, being YAML); the defaults without one."""
    if path is None:
        return Rules()
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        import yaml

        return Rules.from_mapping(yaml.safe_load(text))
    except ImportError:
        import json

        return Rules.from_mapping(json.loads(text))


def _none() -> Column:
    return F.lit(None).cast("bigint")


def _reco(
    df: DataFrame, rule, title: Column, description: Column, evidence: Column,
    user: Column | None = None, category: Column | None = None, *extra: Column,
) -> DataFrame:
    user = _none() if user is None else user.cast("bigint")
    category = _none() if category is None else category.cast("bigint")
    return df.select(
        reco_id(F.lit(rule.type), user, _none(), category, *extra).alias("id"),
        F.lit(rule.type).alias("type"),
        user.alias("target_user_id"),
        _none().alias("target_group_id"),
        category.alias("target_category_id"),
        F.lit(rule.severity).alias("severity"),
        title.alias("title"),
        description.alias("description"),
        F.to_json(evidence).alias("evidence"),
    )


def _listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def formation(profiles: DataFrame, concentration: DataFrame, rule: Formation = Formation()) -> DataFrame:
    """Critical users whose incidents sit on few categories."""
    rows = (
        profiles.filter(F.col("profile") == rule.profile)
        .join(concentration, "user_id")
        .filter((F.col("pct") >= rule.incident_concentration_pct) & (F.size("categories") > 0))
    )
    return _reco(
        rows, rule,
        F.format_string("Formation ciblée pour l'utilisateur %d", "user_id"),
        F.format_string(
            "%.0f%% des incidents sur les catégories %s. Formation recommandée.",
            F.col("pct"), _listed(F.col("categories")),
        ),
        F.struct(
            F.lit(rule.profile).alias("profile"),
            F.bround("pct", 1).alias("concentration_pct"),
            F.col("categories"),
        ),
        F.col("user_id"), F.get(F.col("categories"), F.lit(0)),
    )


def automatisation(profiles: DataFrame, rule: Automatisation = Automatisation()) -> DataFrame:
    """Users with more repetitive tickets than the threshold."""
    count = F.col("features_snapshot.repetitive_count")
    rows = profiles.filter(count > rule.min_repetitive)
    return _reco(
        rows, rule,
        F.format_string("Automatiser les demandes répétitives de l'utilisateur %d", "user_id"),
        F.format_string(
            "%d tickets répétitifs. Privilégier l'automatisation/process au lieu de la formation.",
            count,
        ),
        F.struct(count.alias("repetitive_count")),
        F.col("user_id"),
    )


def surcharge(forecasts: DataFrame, team_sla: DataFrame, rule: Surcharge = Surcharge()) -> DataFrame:
    """Categories with a forecast peak while the team's SLA (a one-row frame) is low."""
    sla = F.col("team_sla_pct")
    rows = (
        peak_and_mean(forecasts)
        .withColumn("team_sla_pct", team_sla.select("team_sla_pct").scalar())
        .filter(
            (F.col("mean") > 0)
            & (F.col("peak") > rule.volume_multiplier * F.col("mean"))
            & (sla < rule.sla_threshold_pct)
        )
    )
    return _reco(
        rows, rule,
        F.format_string("Surcharge prévue sur la catégorie %d", "category_id"),
        F.format_string(
            f"Volume prévu %.0f > {rule.volume_multiplier}× la moyenne, "
            f"SLA équipe %.0f%% < {rule.sla_threshold_pct:.0f}%%.",
            F.col("peak"), sla,
        ),
        F.struct(
            F.bround("peak", 1).alias("predicted_peak"),
            F.bround("mean", 1).alias("avg_predicted"),
            F.bround(sla, 1).alias("team_sla_pct"),
        ),
        None, F.col("category_id"),
    )


def cause_racine(clusters: DataFrame, now: Column, rule: CauseRacine = CauseRacine()) -> DataFrame:
    """Dense recent clusters. The cluster number is part of the id, so two never collide."""
    cutoff = now - F.make_dt_interval(F.lit(rule.window_days))
    rows = clusters.filter(
        (F.col("algorithm") == rule.algorithm)
        & (F.col("ticket_count") >= rule.min_tickets)
        & (F.col("last_seen").isNull() | (F.col("last_seen") >= cutoff))
    )
    return _reco(
        rows, rule,
        F.format_string("Cause racine détectée (cluster %d)", "cluster_id"),
        F.format_string(
            "%d tickets similaires. Mots-clés: %s.",
            F.col("ticket_count"), _listed(F.col("top_keywords")),
        ),
        F.struct("cluster_id", "ticket_count", "sample_titles", "top_keywords"),
        None, None, F.col("cluster_id"),
    )


def recommendations(
    *,
    profiles: DataFrame,
    concentration: DataFrame,
    forecasts: DataFrame,
    team_sla: DataFrame,
    clusters: DataFrame,
    now: Column,
    rules: Rules = Rules(),
) -> DataFrame:
    """All enabled rules, stamped with creation and expiry time."""
    parts = []
    if rules.formation.enabled:
        parts.append(formation(profiles, concentration, rules.formation))
    if rules.automatisation.enabled:
        parts.append(automatisation(profiles, rules.automatisation))
    if rules.surcharge.enabled:
        parts.append(surcharge(forecasts, team_sla, rules.surcharge))
    if rules.cause_racine.enabled:
        parts.append(cause_racine(clusters, now, rules.cause_racine))
    if not parts:
        raise ValueError("no rule is enabled")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    expiry = now + F.make_dt_interval(F.lit(rules.expires_days))
    return union.withColumns({"created_at": now, "expires_at": expiry})
