import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ticketlens.functions import cleaning, measures as m
from ticketlens.operators import shaping
from ticketlens.sources import landing


def one(spark, kind, value, expression):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "title, expected",
    [
        ("RE: Tr: Imprimante en panne", "imprimante en panne"),
        ("  fwd :re:  Accès VPN ", "accès vpn"),
        ("Report", "report"),
        ("re", "re"),
        ("", ""),
        (None, ""),
        ("FW: fw: RE:", ""),
        ("\tRe: Écran noir\n", "écran noir"),
    ],
)
def test_normalize_title(spark, title, expected):
    assert one(spark, "string", title, cleaning.normalize_title) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("Root > Plant A", "Root > Plant A"),
        ("12", "12"),
        ('[{"id": 7, "name": "x"}]', "7"),
        ('["", null, {"name": "Ann"}]', "Ann"),
        ('[[], [{"id": null, "completename": "A > B"}]]', "A > B"),
        ('{"name": "", "completename": "C"}', "C"),
        ("[]", None),
        ("{}", None),
        ('[null, ""]', None),
        ("[urgent] printer", "[urgent] printer"),
        (None, None),
        ("", ""),
    ],
)
def test_flatten_cell(spark, cell, expected):
    assert one(spark, "string", cell, cleaning.flatten_cell) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12), (" 12 ", 12), ("12.0", 12), ("1e3", 1000), ("12.7", None), ("abc", None),
     ("", None), (None, None), ("-5", -5), ("9007199254740993", 9007199254740993)],
)
def test_whole_number(spark, text, expected):
    assert one(spark, "string", text, cleaning.whole_number) == expected


@pytest.mark.parametrize(
    "word, expected",
    [("1", True), (" Yes", True), ("ON", True), ("0", False), ("", False), ("NaN", False),
     ("maybe", None), (None, None)],
)
def test_coerce_bool(spark, word, expected):
    assert one(spark, "string", word, cleaning.coerce_bool) is expected


@pytest.mark.parametrize(
    "name, expected",
    [("Root entity  >  Plant A", "root entity > plant a"), ("A>B", "a > b"), ("  ", None),
     ("NaN", None), ("<NA>", None), (None, None), ("É\tX", "é x")],
)
def test_normalize_display_name(spark, name, expected):
    assert one(spark, "string", name, cleaning.normalize_display_name) == expected


def test_lenient_dates(spark):
    parse = cleaning.lenient_timestamp
    assert one(spark, "string", "2024-03-01 10:00:00", parse) == dt.datetime(2024, 3, 1, 10)
    assert one(spark, "string", "n/a", parse) is None
    assert one(spark, "string", "2024-02-30 10:00:00", parse) is None
    assert one(spark, "string", "01/02/2024", parse) == dt.datetime(2024, 1, 2)
    assert one(spark, "string", "13/02/2024 08:30", parse) == dt.datetime(2024, 2, 13, 8, 30)
    assert one(spark, "string", "2/3/2024 7:05:09", parse) == dt.datetime(2024, 2, 3, 7, 5, 9)
    assert one(spark, "string", "2024/03/01", parse) == dt.datetime(2024, 3, 1)
    assert one(spark, "string", " 1.3.2024 ", parse) == dt.datetime(2024, 3, 1)
    assert one(spark, "string", "02/30/2024", parse) is None
    assert one(spark, "string", "01/02/2024 junk", parse) is None


def test_conform_keeps_the_layout_when_empty(spark):
    empty = spark.createDataFrame([], "stray string, id string")
    out = shaping.enrich(empty)
    assert out.count() == 0
    assert {"name_normalized", "is_resolved", "entities_id_display"} <= set(out.columns)
    assert "stray" not in out.columns


def test_enrich(spark):
    raw = spark.createDataFrame(
        [
            ("1", "Re: Tr: Panne", "5", "6", "2024-01-01 08:00:00", "2024-01-02 10:00:00", '[{"id": 3}]'),
            ("2", None, "1", None, "bad", None, "Unknown person"),
        ],
        "id string, name string, status string, priority string, date string, solvedate string,"
        " _users_id_requester string",
    )
    a, b = shaping.enrich(raw).orderBy("id").collect()
    assert (a.name_normalized, a.is_resolved, a.is_high_priority) == ("panne", True, True)
    assert round(a.resolution_days, 4) == 1.0833 and a.user_requester == 3
    assert (b.name_normalized, b.is_resolved, b.is_high_priority) == ("", False, False)
    assert b.date is None and b.resolution_days is None
    assert b.user_requester is None and b.user_requester_display == "Unknown person"


def test_landing_files(spark, tmp_path):
    (tmp_path / "page.json").write_text(
        '{"2": 5, "1": "Écran", "12": 1, "4": [{"id": 9}], "80": "Root > A", "999": "x"}\n'
        '{"2": "6", "1": null}\n',
        encoding="utf-8",
    )
    page = landing.read_rows(spark, str(tmp_path), landing.TICKET_FIELDS)
    a, b = landing.remap_search_rows(page).orderBy("id").collect()
    assert (a.id, a.name, a._users_id_requester, a.entities_id) == ("5", "Écran", '[{"id": 9}]', "Root > A")
    assert (b.id, b.name, b.status) == ("6", None, None)


def test_followups(spark):
    df = spark.createDataFrame(
        [(1, 10, None, "Ticket"), (2, 10, 0, "Ticket"), (3, 10, 7, "Ticket"), (4, 10, 0, "Problem"), (5, 10, None, None)],
        "id int, items_id int, tickets_id int, itemtype string",
    )
    got = {r.id: r.tickets_id for r in landing.normalize_followups(df).collect()}
    assert got == {"1": "10", "2": "10", "3": "7", "4": "0", "5": None}


def test_records_keep_nulls_and_accents(spark):
    df = spark.sql("SELECT 1L AS id, 'é' AS name, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS d, double('NaN') AS x")
    assert shaping.to_records(df).first()[0] == '{"id":1,"name":"é","d":"2024-01-01 00:00:00","x":null}'


def test_type_dimension(spark):
    df = spark.createDataFrame([("7", "n", "yes", "Root", "[1, 2]")], "id string, name string, is_active string, entities_id string, groups_id string")
    assert rows(shaping.type_dimension(df, "dim_users")) == [(7, True, None, "n", "[1, 2]")]
    with pytest.raises(ValueError):
        shaping.type_dimension(df, "dim_unknown")


def test_sla_and_bands(spark):
    t = "TIMESTAMP_NTZ '2024-01-0{} 00:00:00'"
    null = "CAST(NULL AS TIMESTAMP_NTZ)"
    cases = [  # solved, closed, deadline, met, violated
        (t.format(1), null, t.format(2), True, False),
        (t.format(2), null, t.format(2), True, False),
        (t.format(3), null, t.format(2), False, True),
        (t.format(3), null, null, True, False),
        (null, null, t.format(2), False, True),
        (null, t.format(3), t.format(2), False, True),
        (null, null, null, False, False),
    ]
    for solved, closed, deadline, met, violated in cases:
        row = spark.sql(f"SELECT {solved} AS s, {closed} AS c, {deadline} AS d").select(
            m.sla_met(F.col("s"), F.col("d")), m.sla_violated(F.col("s"), F.col("c"), F.col("d"))
        ).first()
        assert tuple(row) == (met, violated)
    values = spark.createDataFrame([(0.5,), (0.25,), (0.1,), (0.09,)], "v double")
    assert [r[0] for r in values.select(m.criticality_band(F.col("v"))).collect()] == list(m.SEVERITIES)
    counts = spark.createDataFrame([(100,), (50,), (20,), (19,)], "v int")
    assert [r[0] for r in counts.select(m.severity_band(F.col("v"))).collect()] == list(m.SEVERITIES)
    sla = spark.createDataFrame([(120.0,), (90.0,), (89.9,), (-3.0,), (None,)], "v double")
    assert [r[0] for r in sla.select(m.sla_band(F.col("v"))).collect()] == ["good", "good", "warn", "bad", "bad"]


def test_user_display_name(spark):
    df = spark.createDataFrame(
        [(1, " Doe ", "Ann", "x"), (2, None, None, "login"), (3, "", " ", None), (None, None, None, None)],
        "id int, realname string, firstname string, name string",
    )
    got = [r[0] for r in df.select(m.user_display_name(F.col("id"))).collect()]
    assert got == ["Doe  Ann", "login", "user #3", "Inconnu"]


def test_flatten_cell_goes_through_lists_of_any_depth(spark):
    assert one(spark, "string", '[[[{"id":5}]]]', cleaning.flatten_cell) == "5"
    assert one(spark, "string", '[[[[["x"]]]]]', cleaning.flatten_cell) == "x"
    assert one(spark, "string", "[" * 40 + '"deep"' + "]" * 40, cleaning.flatten_cell) == "deep"
    assert one(spark, "string", '[[[], [""]], [[[{"name": ""}, {"completename": "Z"}]]], "late"]', cleaning.flatten_cell) == "Z"
    assert one(spark, "string", "[" * 12 + "]" * 12, cleaning.flatten_cell) is None


def test_flatten_cell_walks_items_not_characters(spark):
    cells = {
        '["", {"name": "' + "x" * 500 + '"}]': "x" * 500, '[[], [[], [""]], ["a,[b"]]': "a,[b",
        "[[[[[[1]]]]]]": "1", '["", "", "", {"id": "", "name": ""}, "last"]': "last", "[]": None, "[[],[]]": None,
    }
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", cleaning.flatten_cell(F.col("c")).alias("v"))
    assert {r.c: r.v for r in rows.collect()} == cells
    assert "translate" in rows._jdf.queryExecution().analyzed().toString()  # steps count brackets and commas
