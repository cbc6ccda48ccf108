import datetime as dt
import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ticketlens.functions.ids import content_fingerprint
from ticketlens.operators import features, forecast, listings, metrics, models, recommend, requesters, resolve, rollups
from ticketlens.operators.filters import Filters, table_search, timestamp

LAYOUT = (
    "id long, user_requester long, user_assign long, entities_id long, groups_id_requester long,"
    " itilcategories_id long, status int, type int, priority int, date timestamp_ntz,"
    " solvedate timestamp_ntz, closedate timestamp_ntz, time_to_resolve timestamp_ntz, name string,"
    " name_normalized string, is_resolved boolean, is_high_priority boolean, resolution_days double"
)


def ticket(i, **more):
    at = more.pop("date", dt.datetime(2024, 1, 1) + dt.timedelta(days=i))
    status = more.pop("status", 5 if i % 2 == 0 else 1)
    solved = more.pop("solvedate", at + dt.timedelta(hours=26) if status in (5, 6) else None)
    row = {
        "id": i, "user_requester": 1, "user_assign": 9, "entities_id": 1, "groups_id_requester": 1,
        "itilcategories_id": 1, "status": status, "type": 1, "priority": 3, "date": at,
        "solvedate": solved, "closedate": None, "time_to_resolve": at + dt.timedelta(hours=30) if at else None,
        "name": "Panne", "name_normalized": "panne", "is_resolved": status in (5, 6),
        "is_high_priority": False,
        "resolution_days": (solved - at).total_seconds() / 86400 if solved and at else None,
    }
    return tuple({**row, **more}.values())


def frame(spark, *data):
    return spark.createDataFrame(list(data), LAYOUT)


def users(spark):
    return spark.createDataFrame([(1, "ann", "Doe", "Ann"), (9, "tech", None, None)], "id long, name string, realname string, firstname string")


# --- roll-ups -------------------------------------------------------------------------------
def test_kpi_snapshot(spark):
    df = frame(spark, ticket(0, is_high_priority=True), ticket(1))
    assert tuple(rollups.kpi_snapshot(df).first()) == (2, 50.0, 1, 1.08)
    assert tuple(rollups.kpi_snapshot(df.limit(0)).first()) == (0, 0.0, 0, 0.0)


def test_overview_of_nothing(spark):
    assert tuple(rollups.overview_kpis(frame(spark).limit(0)).first()) == (0, 0.0, 0.0, 0)


def test_site_shares_leave_the_root_out(spark):
    df = frame(spark, ticket(0, entities_id=0), ticket(1, entities_id=1), ticket(2, entities_id=None), ticket(3, entities_id=7))
    sites = spark.createDataFrame([(1, "One")], "id long, name string")
    got = {r.name: (r.total, r.part_pct, r.total_tickets) for r in rollups.site_rollup(df, sites).collect()}
    assert got == {"One": (1, 33.3, 3), "Sans site": (1, 33.3, 3), "Site #7": (1, 33.3, 3)}


def test_rollups_break_ties_by_id_and_cut(spark):
    df = frame(spark, *[ticket(i, itilcategories_id=c) for i, c in enumerate([5, 5, 3, 3, 8, None])])
    cats = spark.createDataFrame([(5, "Five")], "id long, name string")
    out = rollups.category_rollup(df, cats, Filters(limit=3)).collect()
    assert {(r.category_id, r.name) for r in out} == {(3, "Cat #3"), (5, "Five"), (8, "Cat #8")}
    for r in out:
        assert r.resolved + r.open == r.total and r.incidents + r.requests <= r.total


def test_requester_rollup(spark):
    df = frame(spark, *[ticket(i) for i in range(70)], ticket(100, user_requester=4), ticket(101, user_requester=None))
    profiles = spark.createDataFrame([(1, "critique")], "user_id long, profile string")
    first, second = rollups.requester_rollup(df, users(spark), profiles).orderBy("rank").collect()
    assert (first.rank, first.name, first.total, first.profile, first.repetitive) == (1, "Doe Ann", 70, "critique", 0)
    assert first.tickets_per_month == round(70 / (69 / 30), 2)
    assert (second.name, second.profile, second.tickets_per_month) == ("user #4", None, 1.0)


def test_filters(spark):
    df = frame(spark, ticket(0), ticket(1, date=dt.datetime(2024, 1, 2, 23, 59)), ticket(2), ticket(3, date=None, solvedate=None))
    f = Filters(start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 2))
    assert rows(f.apply(df).select("id")) == [(0,), (1,)]
    assert Filters().apply(df).count() == 4
    with pytest.raises(ValueError):
        Filters(limit=501)


def test_filter_reaches_the_scan(spark, tmp_path, capsys):
    frame(spark, ticket(0)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    f = Filters(start_date=dt.date(2024, 1, 1), entity_id=1)
    rollups.overview_kpis(df, f).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(date,2024-01-01" in plan and "EqualTo(entities_id,1)" in plan
    assert "name_normalized" not in plan


def test_table_search(spark):
    df = spark.createDataFrame([(1, "Été"), (2, "hiver"), (3, None), (10, "été 2")], "id int, s string")
    assert [r.id for r in table_search(df, " ÉTÉ ", sort_by="id", ascending=False).collect()] == [10, 1]
    assert [r.id for r in table_search(df, sort_by="id", page=2, page_size=3).collect()] == [10]


# --- features -------------------------------------------------------------------------------
def test_user_features(spark):
    df = frame(
        spark, *[ticket(i) for i in range(4)], ticket(4, name_normalized="x"), ticket(5, name_normalized=""),
        ticket(6, name_normalized="", type=None, status=None, priority=6), ticket(7, name_normalized=""), ticket(8, user_requester=None),
    )
    r, = features.user_features(df).collect()
    assert (r.total_tickets, r.resolved_count + r.open_count, r.incidents_count, r.requests_count) == (8, 8, 7, 0)
    assert r.repetitive_count == 4 and r.high_priority_count == 1 and round(r.avg_resolution_days, 4) == 1.0833
    assert features.repetitive_titles(df).first().repetitive_count == 4
    assert features.user_features(df.limit(0)).count() == 0


def test_sla_features(spark):
    now = timestamp("2024-01-10 00:00:00")
    late = dt.datetime(2024, 1, 9)
    df = frame(spark, ticket(0), ticket(2, time_to_resolve=dt.datetime(2024, 1, 3, 1)), ticket(4, date=late, status=1), ticket(6, user_assign=8, status=1, time_to_resolve=None))
    nine, eight = sorted(features.sla_features(df, now).collect(), key=lambda r: -r.technician_id)
    assert (nine.current_open_tickets, nine.tickets_last_7_days, nine.historical_sla_pct, nine.sla_violation) == (1, 2, 50.0, 1)
    assert (eight.historical_sla_pct, eight.sla_violation, eight.avg_resolution_days_last_30_days) == (100.0, 0, 0.0)
    future = frame(spark, ticket(0, date=late, status=1, time_to_resolve=dt.datetime(2024, 2, 1)))
    assert features.sla_features(future, now).first().sla_violation == 1
    assert features.sla_features(future, now, past_deadline_only=True).first().sla_violation == 0


def test_daily_counts_are_filled(spark):
    at = dt.datetime(2024, 2, 27, 5)
    df = frame(spark, ticket(0, date=at), ticket(1, date=at + dt.timedelta(days=3)), ticket(2, date=at + dt.timedelta(days=3)), ticket(3, itilcategories_id=None))
    got = [(str(r.ds), r.y) for r in features.daily_category_counts(df).orderBy("ds").collect()]
    assert got == [("2024-02-27", 1), ("2024-02-28", 0), ("2024-02-29", 0), ("2024-03-01", 2)]
    assert features.daily_category_counts(df, top_n=1).select("category_id").distinct().count() == 1


def test_incident_concentration(spark):
    df = frame(spark, *[ticket(i, itilcategories_id=c) for i, c in enumerate([1, 1, 1, 2, 2, 3, 3, None])], ticket(9, type=2, itilcategories_id=3))
    r, = features.incident_concentration(df).collect()
    assert round(r.pct, 3) == round(500 / 7, 3) and r.categories == [1, 2]


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Panne", "d'écran"), (2, None, None), (3, "", "x")], "id long, name string, content string")
    assert rows(features.text_corpus(df).select("id", "text")) == [(1, "Panne. d'écran"), (3, ". x")]


# --- forecast -------------------------------------------------------------------------------
def series(spark, values, category=1):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(category, start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "category_id long, ds date, y long")


def test_average_forecast(spark):
    out = forecast.forecast_average(series(spark, [100] * 3 + [1, 3] * 7)).orderBy("forecast_date").collect()
    assert len(out) == 3 and str(out[0].forecast_date) == "2024-01-18"
    assert (out[0].predicted_count, out[0].lower_bound, out[0].upper_bound, out[0].confidence) == (2.0, 0.04, 3.96, "low")


def test_seasonal_forecast_finds_line_and_week(spark):
    week = [0, 1, 2, 3, 2, 1, 0]
    y = [10 + i * 2 + 4 * week[i % 7] for i in range(56)]
    out = forecast.forecast_seasonal(series(spark, y)).orderBy("forecast_date").collect()
    want = [10 + i * 2 + 4 * week[i % 7] for i in range(56, 59)]
    assert all(abs(r.predicted_count - w) < 1.0 and r.lower_bound <= r.predicted_count <= r.upper_bound for r, w in zip(out, want))
    assert {r.confidence for r in out} == {"high"}


def test_model_choice_by_length(spark):
    df = series(spark, [2] * 20, 1).unionByName(series(spark, [4] * 5, 2))
    got = {(r.category_id, r.confidence) for r in forecast.forecast_volume(df).collect()}
    assert got == {(1, "high"), (2, "low")} and forecast.forecast_volume(df).count() == 6


def test_backtest(spark):
    df = series(spark, [2] * 20 + [0, 2, 4], 1).unionByName(series(spark, [1] * 5, 2))
    r = forecast.backtest(df).first()
    assert abs(r.rmse - np.sqrt(8 / 3)) < 1e-9 and abs(r.mape - (2 + 0 + 0.5) / 3 * 100) < 1e-9 and r.n_categories == 2
    assert tuple(forecast.backtest(series(spark, [1] * 5)).first()) == (0.0, 0.0, 1)


# --- models and metrics ---------------------------------------------------------------------
@pytest.mark.parametrize(
    "change, profile",
    [({"high_priority_count": 3}, "critique"), ({"total_tickets": 20}, "dependant"), ({"repetitive_count": 5}, "dependant"),
     ({"tickets_per_month": 4.0}, "dependant"), ({"total_tickets": 5, "resolved_count": 4}, "autonome"), ({"resolved_count": 1}, "standard"),
     ({"total_tickets": 0, "resolved_count": 0}, "standard")],
)
def test_profile_rules(spark, change, profile):
    base = dict(user_id=1, total_tickets=8, incidents_count=0, requests_count=0, resolved_count=8, open_count=0,
                high_priority_count=0, repetitive_count=0, avg_resolution_days=1.0, tickets_per_month=1.0)
    df = spark.createDataFrame([{**base, **change}])
    assert models.rule_profiles(df).first().profile == profile


def behaviour(spark):
    data = []
    for u in range(40):
        n, high = (25, 0) if u % 4 == 0 else (8, 4) if u % 4 == 1 else (3, 0) if u % 4 == 2 else (6, 0)
        for k in range(n):
            i = u * 100 + k
            data.append(ticket(i, user_requester=u, date=dt.datetime(2024, 1, 1) + dt.timedelta(days=(i * 7) % 120),
                               status=5 if u % 4 == 2 or k % 2 else 1, priority=6 if k < high else 3, name_normalized=f"t{k % 4}"))
    return frame(spark, *data)


def test_forest_learns_the_rules(spark):
    df = behaviour(spark)
    users_ = features.user_features(df).cache()
    model = models.train_profiles(users_, df.count(), trees=20)
    scored = models.profile_predictions(model, users_)
    assert metrics.accuracy_and_f1(scored, "truth", "predicted").first().accuracy >= 0.9
    out = models.predict_profiles(model, users_).collect()
    assert len(out) == 40 and all(0 < r.confidence <= 1 and r.features_snapshot.total_tickets > 0 for r in out)
    assert models.train_profiles(users_, 99) is None


def test_forest_keeps_node_ids_and_does_not_depend_on_how_rows_came(spark):
    users_ = features.user_features(behaviour(spark)).cache()
    forests = [
        models.train_profiles(rows_, 500, trees=10).stages[-1]
        for rows_ in (users_.coalesce(1), users_.repartition(7, "total_tickets"))
    ]
    assert all(f.getCacheNodeIds() for f in forests)
    assert forests[0].toDebugString.split("\n")[1:] == forests[1].toDebugString.split("\n")[1:]


def test_risk_model_and_fallback(spark):
    layout = "technician_id long, current_open_tickets long, tickets_last_7_days long, avg_resolution_days_last_30_days double, high_priority_ratio double, historical_sla_pct double, sla_violation int"
    mixed = spark.createDataFrame([(i, i, i % 3, 1.0, 0.1, 100.0 - i, int(i > 10)) for i in range(20)], layout)
    scored = models.predict_risk(models.train_risk(mixed, 500), mixed).collect()
    assert {r.confidence for r in scored} == {"high"} and all(0 <= r.risk_score <= 1 for r in scored)
    assert all((r.risk_score >= 0.5) == bool(r.next_48h_prediction) for r in scored)
    single = mixed.withColumn("sla_violation", F.lit(1))
    assert models.train_risk(single, 500) is None and models.train_risk(mixed, 99) is None
    assert {tuple(r)[1:] for r in models.predict_risk(None, single).collect()} == {(1.0, 1, "low")}


def test_auc_with_ties_equals_pair_counting(spark):
    rng = np.random.default_rng(4)
    score, truth = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    pos, neg = score[truth == 1], score[truth == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    df = spark.createDataFrame(list(zip(truth.tolist(), score.tolist())), "t int, s double")
    assert abs(metrics.auc(df, "t", "s").first().auc - want) < 1e-9
    assert metrics.auc(df.filter("t = 1"), "t", "s").first().auc == 0.0


def test_f1_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    r = metrics.accuracy_and_f1(df, "t", "p").first()
    assert abs(r.accuracy - 1 / 3) < 1e-9 and abs(r.f1_macro - 0.5 / 3) < 1e-9 and r.n == 3


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    mark = content_fingerprint(df).first()
    assert mark == content_fingerprint(df.orderBy(F.desc("x"))).first()
    assert mark.fingerprint != content_fingerprint(df.filter("x = 1")).first().fingerprint


# --- recommendations ------------------------------------------------------------------------
NOW = "2024-03-01 00:00:00"


def profiles(spark, repetitive=31):
    return spark.sql(f"SELECT 7L AS user_id, 'critique' AS profile, 1.0 AS confidence, named_struct('repetitive_count', {repetitive}L) AS features_snapshot")


def test_rules_fire_at_their_thresholds(spark):
    assert recommend.automatisation(profiles(spark, 30)).count() == 0
    assert recommend.automatisation(profiles(spark, 31)).first().target_user_id == 7
    spread = spark.sql("SELECT 7L AS user_id, 80.0D AS pct, array(4L, 5L) AS categories")
    r = recommend.formation(profiles(spark), spread).first()
    assert (r.severity, r.target_category_id) == ("ÉLEVÉ", 4)
    assert json.loads(r.evidence) == {"profile": "critique", "concentration_pct": 80.0, "categories": [4, 5]}
    assert r.description == "80% des incidents sur les catégories [4, 5]. Formation recommandée."
    assert recommend.formation(profiles(spark), spread.withColumn("pct", F.lit(79.9))).count() == 0
    fc = spark.createDataFrame([(1, 100.0), (1, 10.0), (1, 10.0), (2, 5.0), (3, 0.0)], "category_id long, predicted_count double")
    sla = spark.createDataFrame([(89.0,)], "team_sla_pct double")
    assert rows(recommend.surcharge(fc, sla).select("target_category_id")) == [(1,)]
    assert recommend.surcharge(fc, sla.withColumn("team_sla_pct", F.lit(90.0))).count() == 0


def test_root_causes_have_their_own_ids(spark):
    clusters = spark.sql("""SELECT * FROM VALUES (1L, 'dbscan', 100L, TIMESTAMP_NTZ '2024-02-20 00:00:00'), (2L, 'dbscan', 150L, NULL),
        (3L, 'dbscan', 99L, NULL), (4L, 'kmeans', 500L, NULL), (5L, 'dbscan', 200L, TIMESTAMP_NTZ '2024-01-01 00:00:00')
        AS t(cluster_id, algorithm, ticket_count, last_seen)""").withColumns({"sample_titles": F.array(F.lit("é")), "top_keywords": F.array(F.lit("a"), F.lit("b"))})
    out = recommend.cause_racine(clusters, timestamp(NOW)).collect()
    assert {json.loads(r.evidence)["cluster_id"] for r in out} == {1, 2} and len({r.id for r in out}) == 2
    assert "[a, b]" in out[0].description


def test_ids_are_stable(spark):
    import hashlib

    r = recommend.automatisation(profiles(spark)).first()
    assert r.id == hashlib.sha1(b"AUTOMATISATION|7|None|None").hexdigest()[:20]


def test_rules_from_a_file(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text('{"expires_days": 7, "rules": {"surcharge": {"enabled": false, "volume_multiplier": 2.0}}}')
    rules = recommend.load_rules(str(path))
    assert rules.expires_days == 7 and not rules.surcharge.enabled and rules.surcharge.volume_multiplier == 2.0
    assert rules.cause_racine.min_tickets == 100


def test_listing_and_acks(spark):
    recos = spark.sql("""SELECT * FROM VALUES ('a', 'FAIBLE', TIMESTAMP_NTZ '2024-03-02 00:00:00', NULL), ('b', 'CRITIQUE', TIMESTAMP_NTZ '2024-02-01 00:00:00', NULL),
        ('c', 'CRITIQUE', TIMESTAMP_NTZ '2024-02-02 00:00:00', TIMESTAMP_NTZ '2024-02-20 00:00:00') AS t(id, severity, created_at, expires_at)""")
    acks = spark.createDataFrame([("b", 1), ("b", 1), ("a", 2)], "recommendation_id string, user_id long")
    got = [(r.id, r.acknowledged) for r in listings.reco_listing(recos, acks, 1, timestamp(NOW)).collect()]
    assert sorted(got) == [("a", False), ("b", True)]
    assert str(listings.high_water(recos.limit(0), timestamp(NOW)).first()[0]) == NOW


# --- names and requesters -------------------------------------------------------------------
def test_resolution(spark):
    dims = {
        "dim_users": spark.createDataFrame([(1, "jd", "Doe", "Jane"), (2, "jane doe", None, None), (3, "jd", None, None)], "id long, name string, realname string, firstname string"),
        "dim_entities": spark.createDataFrame([(5, "Plant A", "Root > Plant A"), (4, "Plant A", "Other > Plant A")], "id long, name string, completename string"),
    }
    shown = [("DOE  jane", " root >plant a"), ("jane doe", "Plant A"), ("JD", "nowhere"), (None, None), ("nan", "")]
    columns = "id long, user_requester long, user_requester_display string, entities_id long, entities_id_display string"
    df = spark.createDataFrame([(i, None, u, None, e) for i, (u, e) in enumerate(shown)] + [(9, 77, "77", 88, "88")], columns)
    want = {0: (1, 5), 1: (1, 4), 2: (1, None), 3: (None, None), 4: (None, None), 9: (77, 88)}
    for limit in (resolve.DICTIONARY_ROWS, 0):  # broadcast dictionary, then the shuffle path
        out = resolve.resolve_display_names(df.unionByName(df), dims, dictionary_rows=limit)
        assert out.columns == df.columns and out.count() == 2 * len(want)
        assert {r.id: (r.user_requester, r.entities_id) for r in out.collect()} == want
    assert {(r.column, r.name_key) for r in resolve.name_dictionary(df, dims).collect()} == {
        ("user_requester", "doe jane"), ("user_requester", "jane doe"), ("user_requester", "jd"),
        ("entities_id", "root > plant a"), ("entities_id", "plant a"),
    }


def test_resolution_shuffles_the_fact_at_most_once(spark):
    dims = {"dim_users": spark.range(0, 50).selectExpr("id", "concat('u', id) AS name", "NULL AS realname", "NULL AS firstname")}
    df = spark.range(0, 2000).selectExpr("id", "CAST(NULL AS BIGINT) AS user_requester", "concat('U', id % 70) AS user_requester_display")
    plan = resolve.resolve_display_names(df, dims)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    slow = resolve.resolve_display_names(df, dims, dictionary_rows=0)
    plan = slow._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 2  # lookups against the dictionary, ids back to the fact
    assert slow.filter("user_requester IS NOT NULL").count() == sum(i % 70 < 50 for i in range(2000))


def test_resolution_shuffles_lookups_of_wide_columns_only(spark):
    """One column's dictionary fits, the other's does not: the small one needs no shuffle."""
    spell = "id", "concat('u', id) AS name", "NULL AS realname", "NULL AS firstname"
    dims = {
        "dim_users": spark.range(0, 50).selectExpr(*spell),
        "dim_entities": spark.range(0, 4).selectExpr("id", "concat('e', id) AS name", "NULL AS completename"),
    }
    df = spark.range(0, 500).selectExpr(
        "id", "CAST(NULL AS BIGINT) AS user_requester", "concat('U', id % 70) AS user_requester_display",
        "CAST(NULL AS BIGINT) AS entities_id", "concat('E ', id % 5) AS entities_id_display",
    ).replace({"E 0": "e0", "E 1": "e1", "E 2": "e2", "E 3": "e3"})
    out = resolve.resolve_display_names(df, dims, dictionary_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 3  # the small column's dictionary, then the wide one's lookups and ids
    for r in out.collect():
        assert r.user_requester == (r.id % 70 if r.id % 70 < 50 else None)
        assert r.entities_id == (r.id % 5 if r.id % 5 < 4 else None)


def test_requesters(spark):
    tickets = spark.range(1, 200).select("id")
    group_links = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "tickets_id long, type int")
    user_links = spark.createDataFrame([(1, 1), (3, 1)], "tickets_id long, type int")
    missing = requesters.missing_requester(tickets, group_links, user_links)
    assert missing.count() == 198
    groups = spark.createDataFrame([(1, "Sales"), (2, "IT - Net"), (3, "HR")], "id long, name string")
    members = spark.createDataFrame([(i, i % 3 + 1) for i in range(1, 600)], "users_id long, groups_id long")
    people = requesters.dept_members(groups, members)
    assert {r.group_name for r in people.select("group_name").distinct().collect()} == {"Sales", "HR"}
    out = requesters.assign_requester(missing, people, seed=1)
    assert out.count() == 198 and out.filter("tickets_id = 3").first().users_id is None
    pairs = {(r.users_id, r.groups_id) for r in people.collect()}
    both = out.filter("users_id IS NOT NULL AND groups_id IS NOT NULL").collect()
    assert all((r.users_id, r.groups_id) in pairs for r in both) and len({r.users_id for r in both}) > 100
    assert rows(out) == rows(requesters.assign_requester(missing, people, seed=1))
    assert rows(out) != rows(requesters.assign_requester(missing, people, seed=2))


def test_no_candidates_assign_nothing(spark):
    missing = spark.createDataFrame([(1, True, True)], "id long, needs_group boolean, needs_user boolean")
    nobody = spark.createDataFrame([], "users_id long, groups_id long, group_name string")
    assert requesters.assign_requester(missing, nobody).count() == 0


def test_classification_metrics_in_one_pass_equal_the_parts(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice([0, 1, None]), rng.choice([0, 1]), rng.choice([0.1, 0.5, 0.9, None, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "t int, p int, s double")
    got = metrics.classification_metrics(df, "t", "p", "s").first()
    base = metrics.accuracy_and_f1(df, "t", "p").first()
    assert (got.accuracy, got.f1_macro, got.n) == (base.accuracy, base.f1_macro, base.n)
    assert abs(got.f1 - metrics.binary_f1(df, "t", "p").first().f1) < 1e-12
    assert abs(got.auc - metrics.auc(df, "t", "s").first().auc) < 1e-12
