"""The ticket model as views over the given order tables (mapping in FIXTURES.md).

One ticket per order. A caller names the ticket columns it needs and only the joins behind
those columns are built, so a query that needs no category never reads parts or lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import measures
from ticketlens.functions.cleaning import normalize_title

ASSIGNEE_BASE = 1_000_000
UNKNOWN_BASE = 5_000_000
UNKNOWN_CATEGORY = 900

_STATUS = """CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'P' THEN 5
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 5 END END"""
_PRIORITY = """CASE o_orderpriority
    WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 4 = 0 THEN 6 ELSE 4 END
    WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 4 END
    WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END"""
_DEADLINE_HOURS = "CASE priority WHEN 6 THEN 4 WHEN 5 THEN 8 WHEN 4 THEN 24 WHEN 3 THEN 48 ELSE 72 END"
_NAME = """concat(CASE o_orderkey % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FW: Re: ' ELSE '' END, p_type)"""
_CATEGORY = f"""CASE WHEN p_brand IS NOT NULL AND o_orderkey % 211 = 0 THEN {UNKNOWN_CATEGORY}
    ELSE CAST(replace(p_brand, 'Brand#', '') AS BIGINT) END"""
_REQUESTER = f"""CASE WHEN o_orderkey % 50 = 0 THEN NULL
    WHEN o_orderkey % 97 = 0 THEN o_custkey + {UNKNOWN_BASE} ELSE o_custkey END"""

_LINE = {"name", "name_normalized", "itilcategories_id", "user_assign"}
_PART = {"name", "name_normalized", "itilcategories_id"}
_CUSTOMER = {"entities_id", "groups_id_requester"}
_NATION = {"groups_id_requester"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. ``spread`` is for costly work per row: a file of fewer splits than there
    are cores is dealt out to all of them; a table of many splits is left as it is."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows


def _hours(start: str, hours: str):
    return F.expr(f"timestampadd(HOUR, CAST({hours} AS INT), {start})")


def tickets(spark: SparkSession, sf_dir: str, *columns: str, spread: bool = False) -> DataFrame:
    """The named columns of the enriched fact, ``id`` always among them."""
    wanted = ["id", *[c for c in columns if c != "id"]]
    need = set(wanted)
    rows = table(spark, sf_dir, "orders", spread)
    if need & _LINE:
        lines = (
            table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
        )
        rows = rows.join(lines, rows.o_orderkey == lines.l_orderkey, "left")
    if need & _PART:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
        rows = rows.join(part, F.col("pk") == F.col("p_partkey"), "left")
    if need & _CUSTOMER:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if need & _NATION:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")

    built = {
        "id": F.col("o_orderkey"),
        "content": F.lit(None).cast("string"),
        "status": F.expr(_STATUS),
        "type": F.expr("CAST(1 + o_orderkey % 2 AS INT)"),
        "priority": F.expr(_PRIORITY),
        "date": F.col("o_orderdate"),
        "user_requester": F.expr(_REQUESTER),
    }
    if need & _LINE:
        built["user_assign"] = F.col("sk") + ASSIGNEE_BASE
    if need & _PART:
        built |= {"name": F.expr(_NAME), "itilcategories_id": F.expr(_CATEGORY)}
    if need & _CUSTOMER:
        built["entities_id"] = F.expr(
            "CASE WHEN o_orderkey % 75 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END"
        )
    if need & _NATION:
        built["groups_id_requester"] = F.expr(
            "CASE WHEN o_orderkey % 60 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END"
        )
    rows = rows.select("o_orderkey", *[c.alias(n) for n, c in built.items()])
    rows = rows.withColumn("urgency", F.col("priority")).withColumn(
        "impact", F.expr("greatest(1, priority - 1)")
    )
    rows = rows.withColumn(
        "solvedate",
        F.when(F.col("status").isin(5, 6), _hours("date", "(o_orderkey * 37) % 100")),
    )
    rows = rows.withColumn(
        "closedate", F.when(F.col("status") == 6, _hours("solvedate", "o_orderkey % 48"))
    )
    rows = rows.withColumns(
        {
            "date_mod": F.coalesce("closedate", "solvedate", "date"),
            "time_to_resolve": F.when(F.col("id") % 7 != 0, _hours("date", _DEADLINE_HOURS)),
            "is_resolved": measures.is_resolved(F.col("status")),
            "is_high_priority": measures.is_high_priority(F.col("priority")),
            "resolution_days": measures.days_between(F.col("date"), F.col("solvedate")),
        }
    )
    if "name_normalized" in need:
        rows = rows.withColumn("name_normalized", normalize_title(F.col("name")))
    return rows.select(*wanted)


TICKET_COLUMNS = (
    "id", "name", "content", "status", "type", "priority", "itilcategories_id", "date",
    "date_mod", "solvedate", "closedate", "time_to_resolve", "user_requester", "user_assign",
    "entities_id", "groups_id_requester", "urgency", "impact", "is_resolved",
    "is_high_priority", "resolution_days", "name_normalized",
)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END").alias("realname"),
        F.expr("CASE WHEN c_custkey % 10 <> 0 THEN c_name END").alias("firstname"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + ASSIGNEE_BASE).alias("id"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("realname"),
        F.lit(None).cast("string").alias("firstname"),
    )
    return customers.unionByName(suppliers)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.concat("r_name", F.lit(" > "), "n_name").alias("completename"),
        F.col("n_regionkey").cast("bigint").alias("entities_id"),
        F.lit(2).alias("level"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(
        F.expr("CAST(replace(p_brand, 'Brand#', '') AS BIGINT)").alias("id"),
        F.col("p_brand").alias("name"),
        F.concat(F.lit("Catalog > "), "p_brand").alias("completename"),
        F.lit(None).cast("bigint").alias("itilcategories_id"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"),
        F.col("r_name").alias("name"),
        F.col("r_name").alias("completename"),
        F.lit(None).cast("bigint").alias("groups_id"),
        F.lit(None).cast("bigint").alias("entities_id"),
    )


# --- the same tickets as landed: everything text, keys shown in several ways -----------------
_STAMP = "date_format({c}, 'yyyy-MM-dd HH:mm:ss')"
_RAW = {
    "id": "CAST(id AS STRING)",
    "name": "name",
    "content": "content",
    "status": "CAST(status AS STRING)",
    "type": "CAST(type AS STRING)",
    "priority": "CAST(priority AS STRING)",
    "itilcategories_id": """CASE id % 4
        WHEN 0 THEN concat('Catalog > Brand#', itilcategories_id)
        WHEN 1 THEN concat('Brand#', itilcategories_id)
        WHEN 2 THEN concat('  catalog  >   BRAND#', itilcategories_id, ' ')
        ELSE CAST(itilcategories_id AS STRING) END""",
    "date": _STAMP.format(c="date"),
    "date_mod": f"CASE WHEN id % 31 = 0 THEN 'n/a' ELSE {_STAMP.format(c='date_mod')} END",
    "solvedate": _STAMP.format(c="solvedate"),
    "closedate": _STAMP.format(c="closedate"),
    "time_to_resolve": _STAMP.format(c="time_to_resolve"),
    "_users_id_requester": """CASE id % 4
        WHEN 0 THEN concat('[{"id": ', user_requester, ', "name": "x"}]')
        WHEN 1 THEN concat('["", {"name": "Customer#', lpad(CAST(user_requester AS STRING), 9, '0'), '"}]')
        WHEN 2 THEN concat('Customer#', lpad(CAST(user_requester AS STRING), 9, '0'))
        ELSE CAST(user_requester AS STRING) END""",
    "_users_id_assign": """CASE WHEN id % 41 = 0 THEN concat('Nobody ', id % 7)
        ELSE concat('SUPPLIER#', lpad(CAST(user_assign - 1000000 AS STRING), 9, '0')) END""",
    "entities_id": """CASE id % 4
        WHEN 0 THEN concat('{"completename": "x", "name": "NATION_', entities_id, '"}')
        WHEN 1 THEN concat('nation_', entities_id)
        WHEN 2 THEN concat('Anywhere > Nation ', entities_id)
        ELSE CAST(entities_id AS STRING) END""",
    "_groups_id_requester": """CASE id % 3
        WHEN 0 THEN concat('[[{"id": ', groups_id_requester, '}]]')
        WHEN 1 THEN CASE WHEN groups_id_requester IS NULL THEN '[]' END
        ELSE CAST(groups_id_requester AS STRING) END""",
    "urgency": "CAST(urgency AS STRING)",
    "impact": "CAST(impact AS STRING)",
}


def raw_tickets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Landed rows (all cells text) of the named raw fields, or of all."""
    wanted = ["id", *[c for c in (columns or _RAW) if c != "id"]]
    renamed = {
        "_users_id_requester": "user_requester",
        "_users_id_assign": "user_assign",
        "_groups_id_requester": "groups_id_requester",
    }
    base = tickets(spark, sf_dir, *[renamed.get(c, c) for c in wanted], spread=True)
    return base.select(*[F.expr(_RAW[c]).alias(c) for c in wanted])


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rows keyed by option id; two options are absent from the page."""
    from ticketlens.sources.landing import TICKET_FIELDS

    raw = raw_tickets(spark, sf_dir)
    kept = {opt: name for opt, name in TICKET_FIELDS.items() if name not in ("content", "impact")}
    return raw.select(*[F.col(name).alias(str(opt)) for opt, name in kept.items()])


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed users: flags spelled in many ways, groups as lists, one unknown column."""
    return table(spark, sf_dir, "customer").select(
        F.expr("CAST(c_custkey AS STRING)").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("realname"),
        F.expr("CASE WHEN c_custkey % 10 <> 0 THEN c_name END").alias("firstname"),
        F.expr(
            "element_at(array('1', ' True', 'YES', 'off', '0', '', 'maybe', 'on ', 'NaN', 'f'),"
            " CAST(c_custkey % 10 AS INT) + 1)"
        ).alias("is_active"),
        F.expr("""CASE WHEN c_custkey % 3 = 0 THEN concat('[{"id": ', c_nationkey, '}]')
            WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS STRING) ELSE 'Root entity' END""").alias(
            "entities_id"
        ),
        F.expr("concat('[', c_nationkey, ', ', c_custkey % 7, ']')").alias("groups_id"),
        F.col("c_acctbal").alias("balance"),
    )


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ticket-group and ticket-user links from order lines; repeats included."""
    lines = table(spark, sf_dir, "lineitem")
    group_links = lines.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("tickets_id"),
        F.expr("CAST(1 + l_linenumber % 2 AS INT)").alias("type"),
    )
    user_links = lines.filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("tickets_id"),
        F.expr("CAST(1 + l_linenumber % 3 AS INT)").alias("type"),
    )
    return group_links, user_links


def departments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups, one per nation (those of region 4 being technician pools), and their members."""
    depts = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.expr("CASE WHEN n_regionkey = 4 THEN concat('IT - ', n_name) ELSE n_name END").alias("name"),
    )
    members = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("users_id"), F.col("c_nationkey").cast("bigint").alias("groups_id")
    )
    return depts, members


# --- result tables derived from the given ones -----------------------------------------------
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the part of recommendations."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('r', event_id)").alias("id"),
        F.expr("""CASE event_type WHEN 'click' THEN 'FORMATION' WHEN 'error' THEN 'SURCHARGE'
            WHEN 'purchase' THEN 'CAUSE_RACINE' ELSE 'AUTOMATISATION' END""").alias("type"),
        F.col("user_id").alias("target_user_id"),
        F.expr("""CASE event_type WHEN 'error' THEN 'CRITIQUE' WHEN 'purchase' THEN 'ÉLEVÉ'
            WHEN 'signup' THEN 'MODÉRÉ' ELSE 'FAIBLE' END""").alias("severity"),
        F.expr("concat('Event ', event_id)").alias("title"),
        F.col("event_type").alias("description"),
        F.col("props").alias("evidence"),
        F.col("ts").alias("created_at"),
        F.expr("CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL '14' DAY END").alias("expires_at"),
    )


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("click", "view"))
        .select(
            F.expr("concat('r', event_id + 1)").alias("recommendation_id"),
            (F.col("user_id") % 3).alias("user_id"),
            F.col("ts").alias("acknowledged_at"),
        )
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in the part of ticket clusters."""
    rows = tickets(spark, sf_dir, "itilcategories_id", "date").filter("itilcategories_id IS NOT NULL")
    return (
        rows.groupBy(F.col("itilcategories_id").alias("cluster_id"))
        .agg(
            F.count(F.lit(1)).alias("ticket_count"),
            F.min("date").alias("first_seen"),
            F.max("date").alias("last_seen"),
        )
        .withColumns(
            {
                "algorithm": F.expr("CASE WHEN cluster_id % 2 = 1 THEN 'dbscan' ELSE 'kmeans' END"),
                "severity": measures.severity_band(F.col("ticket_count")),
                "top_keywords": F.array(F.concat(F.lit("brand"), F.col("cluster_id"))),
                "sample_titles": F.array(F.concat(F.lit("Brand#"), F.col("cluster_id"))),
            }
        )
    )


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk row per technician; every ninth has no score."""
    rows = tickets(spark, sf_dir, "user_assign", "is_high_priority").filter("user_assign IS NOT NULL")
    score = F.bround(measures.share(F.col("is_high_priority")), 4)
    return (
        rows.groupBy(F.col("user_assign").alias("technician_id"))
        .agg(score.alias("_s"), (F.count(F.lit(1)) % 2).cast("int").alias("next_48h_prediction"))
        .select(
            "technician_id",
            F.when(F.col("technician_id") % 9 != 0, F.col("_s")).alias("risk_score"),
            "next_48h_prediction",
            F.lit("high").alias("confidence"),
        )
    )
