import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from ticketlens.operators.filters import timestamp
from ticketlens.plans import retrain
from ticketlens.plans.ingest import load_batch, rejects_path
from ticketlens.sources.landing import DIMENSION_FIELDS, TICKET_FIELDS
from ticketlens.sources.warehouse import Warehouse
from ticketlens.streaming.alerts import alert_stream, run_alerts
from ticketlens.streaming.ingest import run_ingest

NOW = "2024-03-01 00:00:00"
RECO = "id string, severity string, title string, description string, created_at timestamp_ntz"


def reco(i, severity="CRITIQUE", day=10, hour=0):
    return (f"r{i}", severity, f"t{i}", None, dt.datetime(2024, 1, day, hour))


def test_alerts_survive_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(*recos):
        spark.createDataFrame(list(recos), RECO).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(RECO).parquet(source)
        feed = alert_stream(stream, timestamp("2024-01-05 00:00:00"))
        run_alerts(feed, sink, state, availableNow=True).awaitTermination()
        return [r[0] for r in rows(spark.read.parquet(sink).select("recommendation_id"))]

    land(reco(1), reco(2, "FAIBLE"), reco(3, day=4), reco(1))
    assert run() == ["r1"]
    land(reco(1), reco(4, hour=1))
    assert run() == ["r1", "r4"]
    assert run() == ["r1", "r4"]
    first = spark.read.parquet(sink).orderBy("recommendation_id").first()
    assert (first.type, first.timestamp) == ("alert", "2024-01-10T00:00:00.000000")


def page(path, name, *tickets):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps(t, ensure_ascii=False) for t in tickets), encoding="utf-8")


def test_ingest_stream_restarts_and_updates(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    house.upsert("dim_entities", spark.createDataFrame([(5, "Usine", "Root > Usine")], "id long, name string, completename string"), timestamp(NOW))
    landing, state = tmp_path / "landing", str(tmp_path / "state")

    def run(now=NOW):
        run_ingest(house, str(landing), state, now=lambda: timestamp(now), availableNow=True).awaitTermination()
        return {r.id: r for r in house.read("dim_tickets_enriched").collect()}

    page(landing, "a", {"2": 1, "1": "Re: Panne", "12": 1, "15": "2024-01-01 08:00:00", "80": "root > usine", "4": [{"id": 3}]}, {"2": 2, "12": 5, "15": "2024-01-01 08:00:00", "17": "2024-01-02 08:00:00"})
    got = run()
    assert (got[1].name_normalized, got[1].entities_id, got[1].user_requester, got[1].is_resolved) == ("panne", 5, 3, False)
    before = house.versions("dim_tickets_enriched")
    run()
    assert house.versions("dim_tickets_enriched") == before
    page(landing, "b", {"2": 1, "1": "Panne", "12": 6, "15": "2024-01-01 08:00:00"})
    got = run("2024-03-02 00:00:00")
    assert got[1].is_resolved and len(got) == 2 and str(got[1].loaded_at) == NOW
    kpis = {str(r.date): (r.total_tickets, r.resolved_pct) for r in house.read("fact_kpis_daily").collect()}
    assert kpis == {"2024-03-01": (2, 50.0), "2024-03-02": (2, 100.0)}


def test_newest_copy_of_a_ticket_wins(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    raw = spark.createDataFrame([("1", "old", "2024-01-01 00:00:00"), ("1", "new", "2024-01-02 00:00:00"), (None, "x", None)], "id string, name string, date_mod string")
    for field in TICKET_FIELDS.values():
        if field not in raw.columns:
            raw = raw.withColumn(field, F.lit(None).cast("string"))
    groups = spark.createDataFrame([('[{"id": 5}]', "g"), ("?", "h")], "id string, name string")
    for field in DIMENSION_FIELDS["dim_groups"]:
        if field not in groups.columns:
            groups = groups.withColumn(field, F.lit(None).cast("string"))
    rejected = load_batch(house, raw, {"dim_groups": groups}, timestamp(NOW), version=3)
    assert rows(house.read("dim_groups").select("id", "name")) == [(5, "g")]
    assert rows(house.read("dim_tickets_enriched").select("id", "name")) == [(1, "new")]
    assert rejected == {"dim_groups": 1, "dim_tickets_enriched": 1}
    kept = spark.read.parquet(rejects_path(house, "dim_tickets_enriched", 3)).collect()
    assert [json.loads(r.record) for r in kept] == [{"name": "x"}]


def test_an_alert_dated_ahead_silences_nothing(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(*recos):
        spark.createDataFrame(list(recos), RECO).coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = alert_stream(spark.readStream.schema(RECO).parquet(source))
        run_alerts(feed, sink, state, availableNow=True).awaitTermination()
        return [r[0] for r in rows(spark.read.parquet(sink).select("recommendation_id"))]

    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    land(("ahead", "CRITIQUE", "t", None, now + dt.timedelta(days=400)))
    assert run() == ["ahead"]
    land(("today", "CRITIQUE", "t", None, now - dt.timedelta(days=1)))
    assert run() == ["ahead", "today"]


def test_clusters_of_an_earlier_run_do_not_stay(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))

    def clusters(algorithm, *counts):
        return spark.createDataFrame(
            [(i, algorithm, n) for i, n in enumerate(counts)], "cluster_id long, algorithm string, ticket_count long"
        )

    def held():
        return rows(house.read("ml_clusters").select("algorithm", "ticket_count"))

    house.replace("ml_clusters", clusters("kmeans", 7), timestamp(NOW), "algorithm", ["kmeans"])
    house.replace("ml_clusters", clusters("dbscan", 10, 5), timestamp(NOW), "algorithm", ["dbscan"])
    house.replace("ml_clusters", clusters("dbscan", 15), timestamp(NOW), "algorithm", ["dbscan"])
    assert held() == [("dbscan", 15), ("kmeans", 7)]
    assert str(house.read("ml_clusters").first().computed_at) == NOW
    house.replace("ml_clusters", clusters("dbscan"), timestamp(NOW), "algorithm", ["dbscan"])
    assert held() == [("kmeans", 7)]


def test_the_promoted_model_is_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    root = str(tmp_path)
    assert retrain.current_model(spark, root, "classifier") is None
    frame = spark.range(1)
    for value, mark in ((0.5, "a"), (0.7, "b"), (0.6, "c")):
        step = SQLTransformer(statement=f"SELECT *, '{mark}' AS mark FROM __THIS__")
        retrain._record(spark, root, "classifier", {"f1_macro": value}, "h", Pipeline(stages=[step]).fit(frame))
    assert retrain.current_model(spark, root, "classifier").transform(frame).first().mark == "b"
    retrain._record(spark, root, "sla_risk", {"f1": 0.0}, "h", None)
    assert retrain.current_model(spark, root, "sla_risk") is None


def test_promotion(spark, tmp_path):
    assert retrain.promotes(0.1, None, True) and retrain.promotes(0.5, 0.5, True)
    assert not retrain.promotes(0.4, 0.5, True) and retrain.promotes(3.0, 4.0, False)
    root = str(tmp_path)
    runs = [retrain._record(spark, root, "forecaster", {"mape": v}, "h", None) for v in (10.0, 12.0, 9.0)]
    assert [(r["version"], r["promoted"]) for r in runs] == [(1, True), (2, False), (3, True)]
    assert retrain.history(spark, root).count() == 3


def test_dashboard_over_a_scored_warehouse(spark, tmp_path):
    from ticketlens.operators.filters import Filters
    from ticketlens.plans import inference
    from ticketlens.plans.dashboard import Dashboard

    house = Warehouse(spark, str(tmp_path))
    house.ensure_schema()
    tickets = spark.sql("""SELECT id, concat('Re: imprimante panne bureau ', CASE WHEN id % 3 = 0 THEN 'nord' ELSE 'sud' END) AS name,
        CASE WHEN id % 2 = 0 THEN 5 ELSE 1 END AS status, 1 AS type, 6 AS priority, id % 2 AS itilcategories_id, id % 4 AS user_requester,
        9L AS user_assign, 1L AS entities_id, 1L AS groups_id_requester, id % 2 = 0 AS is_resolved, true AS is_high_priority,
        'imprimante panne bureau' AS name_normalized, 1.0D AS resolution_days,
        timestampadd(DAY, CAST(id % 30 AS INT), TIMESTAMP_NTZ '2024-02-01 00:00:00') AS date,
        TIMESTAMP_NTZ '2024-02-29 20:00:00' AS date_mod,
        CASE WHEN id % 2 = 0 THEN TIMESTAMP_NTZ '2024-03-01 00:00:00' END AS solvedate FROM range(240)""")
    house.upsert("dim_tickets_enriched", tickets, timestamp(NOW))
    rules = inference.recommend.Rules(cause_racine=inference.recommend.CauseRacine(min_tickets=50))
    for table, frame in inference.infer(house.read("dim_tickets_enriched"), timestamp(NOW), rules, trees=5).items():
        house.upsert(table, frame, timestamp(NOW))
    board = Dashboard(house, dt.datetime(2024, 3, 1))
    overview = {k: v.collect() for k, v in board.overview().items()}
    assert overview["kpis"][0].total_tickets == 240 and overview["repetitive"][0][0] == 240
    assert 1 <= len(overview["alerts"]) <= 4
    assert board.services().first().criticality == "CRITIQUE"
    first = board.requesters(Filters(limit=2)).orderBy("rank").first()
    assert (first.user_id, first.total, first.repetitive, first.profile) == (0, 60, 60, "critique")
    assert board.technicians().first().risk_confidence == "low"
    assert {r.ticket_count for r in board.repetitive().collect()} == {80, 160}
    assert board.volume_forecast().count() > 0 and board.sla_risk().count() == 1
    assert board.sites().count() == 1 and board.categories().count() == 2
    assert {"AUTOMATISATION", "CAUSE_RACINE"} <= {r.type for r in board.recommendations(1).collect()}
