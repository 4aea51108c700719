"""Golden records: each field of a cluster's record is the first value that isn't null in a sorted window over the cluster.

Two orders serve all fields, RECENT and TRUSTED; name and address put their own measure first and break ties by the TRUSTED rank. A cluster
may hold a third of all rows, so its rows are dealt to shards: what all of them must know (latest time, chosen segment) comes from windows
over shards and then over the shards' winners, is joined back by (cluster, shard), and the fields are filled the same way. Every order is
total, so the winner of a cluster is the winner of its shard too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import common

#: Sources by falling trust, hours until a record is stale, the characters that leave a string blank.
TRUST = ("crm", "web", "store", "partner")
STALE_HOURS = 60 * 24
BLANK = " \t\n\x0b\x0c\r"
#: A cluster's rows go to so many shards at least, or to as many as the session has shuffle partitions.
SHARDS = 64

CLUSTER, SHARD = ["_id", "_none"], ["_id", "_none", "_shard"]
FIELDS = ["client_id", "trust", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def _rows(clients: DataFrame, shards: int) -> DataFrame:
    """Typed fields with blank strings as null, the cluster's key without nulls, the shard, and the number of copies of each row."""
    text = lambda c: F.when(F.btrim(F.col(c).cast("string"), F.lit(BLANK)) != "", F.col(c).cast("string")).alias(c)
    balance = F.col("balance").cast("double")
    finite = F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance)
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), F.col("source").cast("string")), F.lit(0))
    cluster = F.coalesce(F.col("master_id"), F.col("client_id")).cast("long")
    rows = clients.select(
        F.coalesce(cluster, F.lit(0)).alias("_id"), cluster.isNull().alias("_none"), F.col("client_id").cast("long").alias("client_id"), F.when(trust > 0, trust).otherwise(len(TRUST) + 1).cast("int").alias("trust"),
        "updated_at", text("name"), text("email"), text("city"), F.col("nation_id").cast("int").alias("nation_id"), text("segment"), finite.alias("balance"),
    )
    rows = rows.groupBy(*CLUSTER, *FIELDS).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("_shard", F.pmod(F.xxhash64(*FIELDS), F.lit(shards)).cast("int"))


def _order(*first: Column) -> list[Column]:
    """RECENT, led by the given columns; rows alike in all of it go by their values, so that no order is left to chance."""
    values = [F.asc_nulls_last(c) for c in ("name", "email", "segment", "balance", "city", "nation_id")]
    return [*first, F.desc_nulls_last("updated_at"), F.asc("trust"), F.asc_nulls_last("client_id"), *values]


def _first(column: Column, window: WindowSpec) -> Column:
    """The first value of the whole window that isn't null."""
    return F.first_value(column, F.lit(True)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _known(rows: DataFrame) -> DataFrame:
    """Of each shard: its cluster's latest time, number of rows, and RECENT's segment with the client_id that has it."""

    def step(rows: DataFrame, by: list[str]) -> DataFrame:
        whole = Window.partitionBy(*by)
        chosen = F.when(F.col("segment").isNotNull(), F.struct(*FIELDS))
        return rows.select(*SHARD, F.max("latest").over(whole).alias("latest"), F.sum("n").over(whole).alias("n"), _first(chosen, whole.orderBy(*_order())).alias("chosen"), F.row_number().over(whole.orderBy(*_order())).alias("at"))

    shards = step(rows.withColumn("latest", F.col("updated_at")), SHARD).where("at = 1").select(*SHARD, "latest", "n", "chosen.*")
    return step(shards, CLUSTER).select(*SHARD, "latest", F.col("n").alias("n_records"), F.col("chosen.segment").alias("chosen"), F.col("chosen.client_id").alias("segment_from"))


def _filled(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with the TRUSTED rank, and for each field the first value over the keys of `by` with its client_id and rank."""
    whole = Window.partitionBy(*by)
    recent, trusted = whole.orderBy(*_order()), whole.orderBy(*_order(F.asc("stale"), F.asc("trust")))
    rows = rows.withColumn("rank", F.row_number().over(trusted))
    longest = whole.orderBy(F.desc_nulls_last(F.char_length("name")), F.asc("rank"))
    fullest = whole.orderBy(F.desc(F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")), F.asc("rank"))
    of = lambda *values: F.struct(*values, F.col("client_id").alias("from"), "rank")
    known = lambda c: F.when(F.col(c).isNotNull(), of(c))
    of_segment = F.when(F.col("segment").eqNullSafe(F.col("chosen")), known("balance"))
    return rows.withColumns({
        "_email": _first(known("email"), trusted), "_name": _first(known("name"), longest), "_address": _first(of("city", "nation_id"), fullest),
        "_balance": F.coalesce(_first(of_segment, recent), _first(known("balance"), recent)), "_stale": F.sum("n_stale").over(whole),
    })


def golden_records(clients: DataFrame) -> DataFrame:
    """One record for each cluster_id (master_id, else client_id) of clients: cluster_id, n_records, n_stale, name, email, segment, city,
    nation_id, balance_cents, and the client_id that supplied each field.

    Columns used: client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance; others are ignored. Blank strings,
    and balances that aren't finite, count as null. Unknown or null sources are trusted least, a null client_id sorts last. Rows with neither id
    form one cluster with a null id. Rows alike in time, source and client_id (repeated ones too, each counts) go by their values: name, email,
    segment, balance, city, nation_id. Without rows the result is empty.
    """
    shards = max(SHARDS, int(clients.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _rows(clients, shards)
    zoned = dict(clients.dtypes)["updated_at"] == "timestamp"
    age = F.unix_micros("latest") - F.unix_micros("updated_at") if zoned else F.col("latest") - F.col("updated_at")
    limit = F.lit(STALE_HOURS * 3_600_000_000) if zoned else F.make_dt_interval(F.lit(0), F.lit(STALE_HOURS))
    rows = rows.join(_known(rows).hint("merge"), SHARD).withColumn("stale", F.col("updated_at").isNull() | (age > limit))
    rows = _filled(rows.withColumn("n_stale", F.when(F.col("stale"), F.col("n")).otherwise(0)), SHARD)
    # a shard hands on the rows that won a field; the first of them carries its count
    won = F.array("_email.rank", "_name.rank", "_balance.rank", "_address.rank")
    rows = rows.where(F.array_contains(F.array_compact(won), F.col("rank"))).withColumn("n_stale", F.when(F.col("rank") == F.col("_address.rank"), F.col("_stale")).otherwise(0))
    rows = rows.drop("rank", "_email", "_name", "_balance", "_address", "_stale")
    out = _filled(rows, CLUSTER).where("rank = 1")
    cents = F.floor(100 * F.col("_balance.balance") + 0.5).cast("long")
    return out.select(
        F.when(~F.col("_none"), F.col("_id")).alias("cluster_id"), "n_records", F.col("_stale").alias("n_stale"), F.col("_name.name").alias("name"), F.col("_email.email").alias("email"), F.col("chosen").alias("segment"),
        F.col("_address.city").alias("city"), F.col("_address.nation_id").alias("nation_id"), cents.alias("balance_cents"), F.col("_name.from").alias("name_from"), F.col("_email.from").alias("email_from"), "segment_from",
        F.col("_balance.from").alias("balance_from"), F.when(F.col("_address.city").isNotNull() | F.col("_address.nation_id").isNotNull(), F.col("_address.from")).alias("address_from"),
    )


def op13_golden(spark, sf_dir: str) -> DataFrame:
    return golden_records(common.table(spark, sf_dir, "clients"))


ORACLE = r"""
WITH c AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, coalesce(list_position(['crm', 'web', 'store', 'partner'], source), 5) AS trust,
    name, email, city, segment, nation_id, balance FROM clients
), b AS (
  SELECT cluster_id, client_id, updated_at, CASE WHEN trust = 0 THEN 5 ELSE trust END AS trust, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance,
    CASE WHEN regexp_matches(name, '[^ \t-\r]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^ \t-\r]') THEN email END AS email,
    CASE WHEN regexp_matches(city, '[^ \t-\r]') THEN city END AS city, CASE WHEN regexp_matches(segment, '[^ \t-\r]') THEN segment END AS segment,
    max(updated_at) OVER (PARTITION BY cluster_id) AS latest FROM c
), s AS (SELECT *, updated_at IS NULL OR latest - updated_at > INTERVAL 1440 HOUR AS stale FROM b),
r AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id NULLS LAST, name NULLS LAST, email NULLS LAST, segment NULLS LAST, balance NULLS LAST, city NULLS LAST, nation_id NULLS LAST) AS recent,
    row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, updated_at DESC NULLS LAST, client_id NULLS LAST, name NULLS LAST, email NULLS LAST, segment NULLS LAST, balance NULLS LAST, city NULLS LAST, nation_id NULLS LAST) AS trusted FROM s
), g AS (SELECT *, first_value(segment IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY recent ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen FROM r),
w AS (
  SELECT cluster_id, count(*) AS n_records, count(*) FILTER (WHERE stale) AS n_stale, any_value(chosen) AS segment,
    arg_min({'v': name, 'f': client_id}, {'a': -length(name), 'b': trusted}) FILTER (WHERE name IS NOT NULL) AS n, arg_min({'v': email, 'f': client_id}, trusted) FILTER (WHERE email IS NOT NULL) AS e,
    arg_min({'f': client_id}, recent) FILTER (WHERE segment IS NOT NULL) AS s, arg_min({'v': balance, 'f': client_id}, {'a': CASE WHEN segment IS NOT DISTINCT FROM chosen THEN 0 ELSE 1 END, 'b': recent}) FILTER (WHERE balance IS NOT NULL) AS m,
    arg_min({'c': city, 'n': nation_id, 'f': client_id}, {'a': (city IS NULL)::INT + (nation_id IS NULL)::INT, 'b': trusted}) AS a
  FROM g GROUP BY cluster_id
)
SELECT cluster_id, n_records, n_stale, n.v AS name, e.v AS email, segment, a.c AS city, CAST(a.n AS INTEGER) AS nation_id, CAST(floor(100 * m.v + 0.5) AS BIGINT) AS balance_cents,
  n.f AS name_from, e.f AS email_from, s.f AS segment_from, m.f AS balance_from, CASE WHEN a.c IS NOT NULL OR a.n IS NOT NULL THEN a.f END AS address_from FROM w
"""
