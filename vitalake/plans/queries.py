"""Every operator as a query over the given tables, each beside the SQL that gives the same rows.

Arrays are joined to text in the results and Float32 columns are widened, so that both engines
compare the same plain values. `SQL` is None where SQL has no such thing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake import schemas
from vitalake.functions import arrays, values
from vitalake.functions.ids import stable_id, stable_ids
from vitalake.ml import models
from vitalake.operators import clean, dims, logs, lookups, merge, rollups
from vitalake.operators.occurrences import occurrence_id
from vitalake.plans import dashboards, runs, serving, warehouse
from vitalake.session import bytes_under, configure, shared_dir
from vitalake.sources import backup as backups
from vitalake.sources import buckets, landing, publications, readers, tolerance, versions
from vitalake.streaming import clustered, log_streams

LOAD_TS = datetime(2026, 6, 17, 3, 0, tzinfo=timezone.utc)
OLD_TS = LOAD_TS - timedelta(days=1)
AS_OF = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)
MINUTE = timedelta(minutes=1)


class Tables:
    """The given tables, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def scratch(self) -> str:
        """A new folder in the shared folder of the cluster."""
        return shared_dir(self.spark, f"vitalake-{uuid.uuid4().hex}")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = Query(build, sql)
        return build

    return register


def sid_text(*exprs: str) -> str:
    """`id_text` in SQL."""
    texts = [f"CAST({e} AS VARCHAR)" for e in exprs]
    if len(texts) == 1:
        return texts[0]
    return " || ".join(f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, '-')" for x in texts)


def sid(*exprs: str) -> str:
    """`stable_id` in SQL."""
    return f"CAST('0x' || substr(md5({sid_text(*exprs)}), 1, 15) AS BIGINT)"


def joined(array: Column | str) -> Column:
    """An array as text, element by element."""
    col = F.col(array) if isinstance(array, str) else array
    return F.array_join(col.cast("array<string>"), ",")


# ── Projections, filters, tags ───────────────────────────────────────────────


@query("rename_map", "SELECT p_partkey AS item_id, p_name AS item, p_size AS size_cm FROM part")
def _(t):
    headed = t.part.withColumnRenamed("p_size", "Size (cm)")
    return clean.rename_map(headed, {"p_partkey": "item_id", "p_name": "item", "Size (cm)": "size_cm", "absent": "x"})


@query(
    "null_tokens",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('', '4-NOT SPECIFIED') THEN NULL ELSE o_orderpriority END
       AS o_orderpriority FROM orders""",
)
def _(t):
    return values.null_tokens(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ("", "4-NOT SPECIFIED"))


@query("filter_nonempty", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('', 'PROMO')")
def _(t):
    return t.part.filter(values.present("p_type", ("", "PROMO"))).select("p_partkey", "p_type")


@query(
    "cond_default",
    f"""SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'N' THEN 0 ELSE {sid('l_returnflag')} END AS flag_id,
        CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag_names FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        values.when_present("l_returnflag", stable_id("l_returnflag"), F.lit(0).cast("bigint"), ("N",)).alias("flag_id"),
        joined(arrays.single_or_empty("l_returnflag", "l_returnflag", ("N",))).alias("flag_names"),
    )


@query(
    "const_tag",
    """SELECT o_orderkey, 'external_csv' AS source, CAST(0 AS BIGINT) AS member_id,
       CAST(NULL AS TIMESTAMP) AS started_at FROM orders""",
)
def _(t):
    return clean.tag(
        t.orders.select("o_orderkey"),
        source="external_csv",
        member_id=F.lit(0).cast("bigint"),
        started_at=F.lit(None).cast("timestamp_ntz"),
    )


@query("load_stamp", "SELECT n_nationkey, '2026-06-17T03-00-00Z' AS created, true AS same FROM nation")
def _(t):
    return clean.stamp(t.nation, LOAD_TS).select(
        "n_nationkey", values.utc_label("created_at").alias("created"), F.expr("created_at = updated_at").alias("same")
    )


@query(
    "utc_label",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') AS label FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", values.utc_label("o_orderdate").alias("label"))


@query(
    "check_enum",
    "SELECT c_custkey, c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed FROM customer",
)
def _(t):
    ok, bad = clean.check_enum(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return clean.tag(ok, allowed=True).unionByName(clean.tag(bad, allowed=False))


def _size_text(t: Tables) -> DataFrame:
    """Part sizes as text: some with a fraction, some missing, as in a raw file."""
    text = F.col("p_size").cast("string")
    size = F.when(F.col("p_type") == "PROMO", F.concat(text, F.lit(".0"))).when(F.col("p_type") != "SMALL", text)
    return t.part.select("p_partkey", size.alias("size"), F.col("p_retailprice").cast("string").alias("price"))


@query(
    "strict_cast",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 0 ELSE CAST(p_size AS BIGINT) END AS size,
       p_retailprice AS price FROM part WHERE p_type <> 'PROMO'""",
)
def _(t):
    return clean.strict_cast(_size_text(t), {"size": "bigint", "price": "double"})[0]


@query(
    "strict_cast_skipped",
    "SELECT p_partkey, p_size || '.0' AS size FROM part WHERE p_type = 'PROMO'",
)
def _(t):
    return clean.strict_cast(_size_text(t), {"size": "bigint", "price": "double"})[1].select("p_partkey", "size")


@query(
    "prefix_count",
    """SELECT (SELECT count(*) FROM customer WHERE starts_with(c_name, 'Customer#00000000')) AS customers,
       (SELECT count(*) FROM supplier WHERE starts_with(s_name, 'Supplier#')) AS suppliers,
       (SELECT count(*) FROM orders) AS orders_total""",
)
def _(t):
    return clean.marker_counts(
        {
            "customers": (t.customer, clean.starts_with("c_name", "Customer#00000000")),
            "suppliers": (t.supplier, clean.starts_with("s_name", "Supplier#")),
            "orders_total": (t.orders, None),
        }
    )


@query(
    "delete_where",
    "SELECT c_custkey, c_name FROM customer WHERE NOT coalesce(c_acctbal < 0 OR starts_with(c_name, 'Customer#00000001'), false)",
)
def _(t):
    gone = (F.col("c_acctbal") < 0) | clean.starts_with("c_name", "Customer#00000001")
    return clean.delete_where(t.customer, gone).select("c_custkey", "c_name")


# ── Keys and dimensions ──────────────────────────────────────────────────────


@query(
    "stable_id",
    f"""SELECT n_name, {sid('n_name')} AS id, {sid('n_name', 'n_regionkey', "nullif(n_regionkey, 2)")} AS id3 FROM nation""",
)
def _(t):
    third = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))
    return t.nation.select("n_name", stable_id("n_name").alias("id"), stable_id("n_name", "n_regionkey", third).alias("id3"))


@query(
    "id_collisions",
    """SELECT CAST(p_size AS BIGINT) AS id, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1
       HAVING count(DISTINCT p_name) > 1""",
)
def _(t):
    return dims.id_collisions(t.part.withColumn("p_size", F.col("p_size").cast("bigint")), "p_size", "p_name")


_STAMP_SQL = "TIMESTAMP '2026-06-17 03:00:00'"


def _plain_stamps(df: DataFrame) -> DataFrame:
    stamps = [c for c in ("created_at", "updated_at") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query(
    "dim_build",
    f"""SELECT {sid('name')} AS id, name, {_STAMP_SQL} AS created_at, {_STAMP_SQL} AS updated_at
        FROM (SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderpriority NOT IN ('', '4-NOT SPECIFIED'))""",
)
def _(t):
    return _plain_stamps(dims.build_dim(t.orders, "o_orderpriority", ("", "4-NOT SPECIFIED"), LOAD_TS))


@query(
    "dim_union",
    f"""SELECT {sid('name')} AS id, name FROM (SELECT CAST(c_nationkey AS VARCHAR) AS name FROM customer
        UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier)""",
)
def _(t):
    sources = [(t.customer, F.col("c_nationkey").cast("string")), (t.supplier, F.col("s_nationkey").cast("string"))]
    return dims.build_dim_union(sources, load_ts=LOAD_TS).select("id", "name")


@query(
    "dim_explode",
    f"""SELECT {sid('name')} AS id, name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part
        UNION SELECT unnest([p_type, p_brand]) FROM part) WHERE name <> ''""",
)
def _(t):
    worded = t.part.select(F.split("p_name", " ").alias("a"), F.array("p_type", "p_brand").alias("b"))
    return dims.build_dim_arrays(worded, ["a", "b"], load_ts=LOAD_TS).select("id", "name")


def _nation_dim(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.lit(OLD_TS).alias("created_at"),
        F.lit(OLD_TS).alias("updated_at"),
    )


@query(
    "dim_upsert",
    f"""WITH seen AS (SELECT DISTINCT 'NATION_' || c_nationkey AS name FROM customer WHERE c_acctbal > 0
                      UNION SELECT p_type FROM part)
        SELECT coalesce(n_nationkey, {sid('name')}) AS id, coalesce(n_name, name) AS name,
        n_name IS NULL AS created_now, name IS NOT NULL AS updated_now
        FROM nation FULL JOIN seen ON n_name = name""",
)
def _(t):
    names = (
        t.customer.filter("c_acctbal > 0")
        .select(F.concat(F.lit("NATION_"), "c_nationkey").alias("name"))
        .unionByName(t.part.select(F.col("p_type").alias("name")))
    )
    return dims.upsert_dim(_nation_dim(t), names, LOAD_TS).select(
        "id",
        "name",
        (F.col("created_at") == F.lit(LOAD_TS)).alias("created_now"),
        (F.col("updated_at") == F.lit(LOAD_TS)).alias("updated_now"),
    )


@query(
    "occurrence_id",
    f"""SELECT {sid('(' + sid_text("'csv'", 'l_returnflag', 'l_linestatus', 'l_linenumber') + ')', 'i')} AS id,
        l_returnflag, l_linestatus, l_linenumber FROM (SELECT *, row_number() OVER (
        PARTITION BY l_returnflag, l_linestatus, l_linenumber) AS i FROM lineitem)""",
)
def _(t):
    return occurrence_id(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), "csv")


# ── Joins and merges ─────────────────────────────────────────────────────────


@query(
    "lookup_optional",
    """SELECT c_custkey, CAST(n_regionkey AS BIGINT) AS region FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""",
)
def _(t):
    dim = t.nation.filter("n_regionkey < 3").withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))
    return lookups.lookup(
        t.customer.select("c_custkey", "c_nationkey"), dim, "c_nationkey", "region", "n_nationkey", "n_regionkey"
    ).select("c_custkey", "region")


@query(
    "lookup_strict",
    "SELECT c_custkey, CAST(n_regionkey AS BIGINT) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(t):
    dim = t.nation.withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))
    return lookups.lookup_strict(
        t.customer.select("c_custkey", "c_nationkey"), dim, "c_nationkey", "region", "n_nationkey", "n_regionkey"
    ).select("c_custkey", "region")


@query(
    "lookup_misses",
    """SELECT o_custkey AS key, count(*) AS n FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def _(t):
    rich = t.customer.filter("c_acctbal > 0")
    return lookups.lookup_misses(t.orders, rich, "o_custkey", "c_custkey", "c_nationkey")


_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part"


@query(
    "array_lookup",
    f"""SELECT p_partkey, coalesce(string_agg(coalesce(CAST(id AS VARCHAR), '-'), ',' ORDER BY pos), '') AS word_ids
        FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos
              FROM part) LEFT JOIN (SELECT name, {sid('name')} AS id FROM ({_WORDS}) WHERE name > 'h') ON word = name
        GROUP BY p_partkey""",
)
def _(t):
    worded = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    dim = dims.build_dim_arrays(worded, ["words"], load_ts=LOAD_TS).filter("name > 'h'")
    found = lookups.lookup_array(worded, dim, "words", "ids", ["p_partkey"])
    text = F.transform("ids", lambda i: F.coalesce(i.cast("string"), F.lit("-")))
    return found.select("p_partkey", F.array_join(text, ",").alias("word_ids"))


@query(
    "insert_if_absent",
    """SELECT o_custkey AS custkey, o_totalprice AS amount FROM orders UNION ALL
       SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    target = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"))
    source = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"))
    return merge.insert_if_absent(target, source, ["custkey"])


@query(
    "upsert",
    """WITH batch AS (SELECT o_custkey, o_totalprice, o_orderstatus FROM orders QUALIFY
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
       SELECT c_custkey AS custkey, coalesce(o_totalprice, c_acctbal) AS amount, coalesce(o_orderstatus, '') AS status,
       CAST(c_nationkey AS BIGINT) AS kept, o_custkey IS NOT NULL AS updated_now FROM customer LEFT JOIN batch ON c_custkey = o_custkey
       WHERE c_acctbal > 0
       UNION ALL SELECT o_custkey, o_totalprice, o_orderstatus, -1, true FROM batch
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(t):
    target = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_acctbal").alias("amount"),
        F.lit("").alias("status"),
        F.col("c_nationkey").cast("bigint").alias("kept"),
        F.lit(OLD_TS).alias("updated_at"),
    )
    source = t.orders.select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.lit(-1).cast("bigint").alias("kept"),
        F.col("o_orderkey").alias("seq"),
    )
    merged = merge.upsert(target, source, ["custkey"], "seq", LOAD_TS, keep=("kept",))
    return merged.withColumn("updated_now", F.col("updated_at") == F.lit(LOAD_TS)).drop("updated_at")


@query(
    "scalar_lookup",
    """SELECT o_orderkey, (SELECT c_nationkey FROM customer WHERE c_name = 'Customer#000000007') AS nation,
       (SELECT c_nationkey FROM customer WHERE c_name = 'nobody') AS none FROM orders""",
)
def _(t):
    named = lambda name: lookups.scalar(t.customer, F.col("c_name") == name, "c_nationkey")
    return t.orders.select(
        "o_orderkey", named("Customer#000000007").alias("nation"), named("nobody").alias("none")
    )


@query(
    "insert_from_parent",
    """SELECT s_suppkey AS id, s_name AS title, s_acctbal AS amount FROM supplier
       UNION ALL SELECT c_custkey, 'about ' || c_name, NULL FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(t):
    target = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("amount")
    )
    new = {"id": F.col("c_custkey"), "title": F.concat(F.lit("about "), "c_name")}
    return lookups.insert_from(target, t.customer, F.col("c_mktsegment") == "BUILDING", new)


@query(
    "orphan_fk",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = o_custkey)""",
)
def _(t):
    fact = t.orders.select("o_orderkey", "o_custkey")
    return lookups.orphans(fact, t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey")


@query(
    "orphan_keys",
    """SELECT word AS key, count(*) AS n_rows FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
       WHERE word NOT IN (SELECT p_type FROM part UNION SELECT 'red') GROUP BY 1""",
)
def _(t):
    dim = t.part.select("p_type").distinct().unionByName(t.part.select(F.lit("red").alias("p_type")))
    return lookups.orphan_keys(t.part.select(F.split("p_name", " ").alias("words")), dim, "words", "p_type")


@query(
    "latest_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return merge.latest_by_key(rows, ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    "split_entity",
    f"""SELECT 'buyer' AS entity, {sid('o_custkey')} AS id, {sid('o_custkey')} AS buyer_id, o_orderstatus AS value FROM orders
        UNION ALL SELECT 'price', {sid('o_custkey', "'price'")}, {sid('o_custkey')}, o_orderpriority FROM orders""",
)
def _(t):
    buyer = stable_id("o_custkey").alias("buyer_id")
    parts = merge.split_entities(
        t.orders,
        {
            "buyer": [stable_id("o_custkey").alias("id"), buyer, F.col("o_orderstatus").alias("value")],
            "price": [stable_id("o_custkey", F.lit("price")).alias("id"), buyer, F.col("o_orderpriority").alias("value")],
        },
    )
    return merge.union_tagged(parts, "entity")


@query(
    "union_sources",
    """SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier""",
)
def _(t):
    return merge.union_tagged(
        {
            "customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
            "supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        }
    )


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("union_distinct", "SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def _(t):
    return merge.union_distinct([t.orders.select(F.col("o_custkey").alias("key")), t.customer.select(F.col("c_custkey").alias("key"))])


# ── Arrays and JSON text ─────────────────────────────────────────────────────


@query(
    "array_map_id",
    f"SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda m: {sid('m')}), ',') AS ids FROM part",
)
def _(t):
    return t.part.select("p_partkey", joined(stable_ids(F.split("p_name", " "))).alias("ids"))


@query(
    "array_single",
    """SELECT o_orderkey, o_orderstatus AS one, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS n_priorities
       FROM orders""",
)
def _(t):
    some = arrays.single_or_empty("o_orderpriority", "o_orderpriority", ("5-LOW",))
    return t.orders.select(
        "o_orderkey", joined(arrays.single("o_orderstatus")).alias("one"), F.size(some).alias("n_priorities")
    )


@query(
    "array_length_filter",
    "SELECT p_partkey FROM part WHERE p_type <> 'PROMO'",
)
def _(t):
    return t.part.filter(arrays.non_empty(arrays.single_or_empty("p_type", "p_type", ("PROMO",)))).select("p_partkey")


@query(
    "to_json_array",
    "SELECT p_partkey, CAST(to_json([p_name, p_type || ' \"' || p_brand || '\"']) AS VARCHAR) AS instruction FROM part",
)
def _(t):
    quoted = F.concat("p_type", F.lit(' "'), "p_brand", F.lit('"'))
    return t.part.select("p_partkey", arrays.json_array(F.array("p_name", quoted)).alias("instruction"))


@query(
    "json_objects",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '[]' ELSE CAST(to_json([{{'id': {sid('o_orderpriority')},
        'severity': CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END}}]) AS VARCHAR) END AS diseases FROM orders""",
)
def _(t):
    name = F.when(F.col("o_orderpriority") == "5-LOW", "None").otherwise(F.col("o_orderpriority"))
    severity = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return t.orders.select(
        "o_orderkey", arrays.condition_entries(name, stable_id("o_orderpriority"), severity).alias("diseases")
    )


# ── Logs and availability ────────────────────────────────────────────────────


def _service() -> Column:
    return F.concat(F.lit("svc-"), F.col("user_id") % 8)


def log_lines(t: Tables) -> DataFrame:
    """Events as log lines: one of eight services, and a line of the event's type and properties."""
    return t.events.select(
        "event_id",
        "ts",
        _service().alias("compose_service"),
        F.concat(F.lit("c"), F.col("user_id")).alias("container"),
        F.concat_ws(" ", "event_type", "props").alias("line"),
    )


_LINES = """(SELECT event_id, ts, 'svc-' || (user_id % 8) AS compose_service, 'c' || user_id AS container,
            event_type || ' ' || props AS line FROM events)"""


@query(
    "parse_logs",
    """SELECT event_id, ts, event_type || ' ' || props AS line, 'stdout' AS stream, 'c' || user_id AS container
       FROM (SELECT *, 'svc-' || (user_id % 8) AS s FROM events) WHERE s IN ('svc-1', 'svc-2', 'svc-5')""",
)
def _(t):
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    record = F.struct(F.concat_ws(" ", "event_type", "props").alias("log"), F.lit("stdout").alias("stream"), time.alias("time"))
    records = t.events.select(
        F.to_json(record).alias("value"),
        F.lit("stack").alias("meta_project"),
        _service().alias("meta_service"),
        F.concat(F.lit("/c"), "user_id").alias("meta_name"),
        F.col("event_id").cast("string").alias("meta_id"),
        F.current_timestamp().alias("arrived"),
    )
    parsed = logs.parse_logs(records, ["svc-1", "svc-2", "svc-5"])
    return parsed.select(
        F.col("container_id").cast("bigint").alias("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "line",
        "stream",
        "container",
    )


@query("reject_old", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 168 HOUR")
def _(t):
    return logs.reject_old(t.events.select("event_id", "ts"), as_of=AS_OF)


@query(
    "ingest_logs",
    """SELECT event_id, ts, event_type || ' ' || props AS line FROM events WHERE user_id % 8 IN (1, 2, 5) AND user_id % 20 <= 7""",
)
def _(t):
    kept = log_streams.ingest(_records(t), ["svc-1", "svc-2", "svc-5"])
    return kept.select(F.col("container_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "line")


def _records(t: Tables) -> DataFrame:
    """Events as container records, which arrive as many days after their time as the user's number says, counted around 20."""
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    record = F.struct(F.concat_ws(" ", "event_type", "props").alias("log"), F.lit("stdout").alias("stream"), time.alias("time"))
    delay = F.make_dt_interval((F.col("user_id") % 20).cast("int"))
    return t.events.select(
        F.to_json(record).alias("value"),
        F.lit("stack").alias("meta_project"),
        _service().alias("meta_service"),
        F.lit("/c").alias("meta_name"),
        F.col("event_id").cast("string").alias("meta_id"),
        (F.col("ts").cast("timestamp") + delay).alias("arrived"),
    )


@query(
    "ingest_refused",
    """SELECT event_id, ts, event_type || ' ' || props AS line,
       CASE WHEN user_id % 8 NOT IN (1, 2, 5) THEN 'service' WHEN user_id % 20 > 7 THEN 'age' END AS refused FROM events""",
)
def _(t):
    # A stream of records in two runs with one checkpoint; what was stored and what was refused are read back together.
    source, kept, refused = (f"{t.scratch}/{x}" for x in ("records", "kept", "refused"))
    for odd in (0, 1):
        _records(t).filter(F.col("meta_id").cast("bigint") % 2 == odd).write.mode("append").json(source)
        stream = log_streams.open_json(t.spark, source, log_streams.RECORD_SCHEMA)
        name = f"refused-{uuid.uuid4().hex}"
        log_streams.store_with_refused(
            stream, ["svc-1", "svc-2", "svc-5"], kept, refused, name, checkpoint=f"{t.scratch}/checkpoint", once=True
        ).awaitTermination()
    read = t.spark.read.parquet
    both = read(kept).withColumn("refused", F.lit(None).cast("string")).unionByName(read(refused))
    return both.select(F.col("container_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "line", "refused")


_RANGE = "ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00'"
_DAY = timedelta(hours=24)


@query(
    "count_over_time",
    f"""SELECT count(*) AS n FROM {_LINES} WHERE {_RANGE} AND regexp_full_match(compose_service, 'svc-.+')
        AND NOT regexp_full_match(compose_service, 'svc-0|svc-7') AND regexp_matches(line, '(error|exception|fatal|panic)', 'i')""",
)
def _(t):
    chosen = {"compose_service": ("svc-.+", "svc-0|svc-7")}
    return logs.count_over_time(log_lines(t), AS_OF, _DAY, values.ERROR_WORDS, chosen)


@query("count_over_time_none", f"SELECT count(*) AS n FROM {_LINES} WHERE {_RANGE} AND regexp_matches(line, 'no such text')")
def _(t):
    return logs.count_over_time(log_lines(t), AS_OF, _DAY, "no such text")


@query(
    "count_over_time_by",
    f"SELECT compose_service, count(*) AS n FROM {_LINES} WHERE {_RANGE} AND regexp_matches(line, '(warn|warning|purchase)', 'i') GROUP BY 1",
)
def _(t):
    return logs.count_over_time(log_lines(t), AS_OF, _DAY, (*values.WARN_WORDS, "purchase"), by=["compose_service"])


@query(
    "log_summary",
    f"""SELECT *, CASE WHEN errors >= 10 THEN 'red' WHEN errors >= 1 THEN 'orange' ELSE 'green' END AS errors_band,
        CASE WHEN warnings >= 10 THEN 'orange' WHEN warnings >= 1 THEN 'yellow' ELSE 'green' END AS warnings_band,
        CASE WHEN total >= 1 THEN 'blue' ELSE 'green' END AS total_band,
        CASE WHEN fatals >= 1 THEN 'red' ELSE 'green' END AS fatals_band FROM (SELECT
        count(*) FILTER (regexp_matches(line, '(error|exception|fatal|panic)', 'i')) AS errors,
        count(*) FILTER (regexp_matches(line, '(warn|warning)', 'i')) AS warnings,
        count(*) FILTER (regexp_matches(line, '(fatal|panic)', 'i')) AS fatals, count(*) AS total FROM {_LINES}
        WHERE {_RANGE} AND regexp_full_match(compose_service, 'svc-[0-5]') AND NOT regexp_full_match(compose_service, 'svc-3'))""",
)
def _(t):
    return dashboards.log_summary(log_lines(t), AS_OF, _DAY, "svc-[0-5]", "svc-3")


def _series_sql(where: str = "true", span_steps: int = 5) -> str:
    # A line counts in every range (at - 5 min, at] on whole minutes.
    return f"""SELECT compose_service, first_at + to_minutes(i) AS window_end, count(*) AS n FROM (SELECT *,
        date_trunc('minute', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE AS first_at,
        unnest(range(0, {span_steps})) AS i FROM {_LINES} WHERE {where}) GROUP BY 1, 2"""


_ERRORS = "regexp_matches(line, '(error|exception|fatal|panic)', 'i')"


@query("rate_by_service", f"SELECT compose_service, window_end, n / 300.0::DOUBLE AS rate FROM ({_series_sql()})")
def _(t):
    return logs.rate(log_lines(t), ["compose_service"])


@query("errors_by_service", _series_sql(_ERRORS))
def _(t):
    return logs.count_series(log_lines(t), ["compose_service"], pattern=values.ERROR_WORDS)


@query(
    "errors_by_service_stream",
    _series_sql(_ERRORS),
)
def _(t):
    raw = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    lines = raw.select(
        F.col("ts").cast("timestamp").alias("ts"),
        _service().alias("compose_service"),
        F.concat_ws(" ", "event_type", "props").alias("line"),
    )
    keys = ["compose_service", "window_end"]
    series = logs.count_series(logs.watermark(lines), keys[:1], pattern=values.ERROR_WORDS)
    out, checkpoint = f"{t.scratch}/errors", f"{t.scratch}/checkpoint"
    log_streams.start_measure(series, out, f"errors-{uuid.uuid4().hex}", keys, checkpoint, once=True).awaitTermination()
    return log_streams.read_measure(t.spark, out, keys).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(
    "log_search",
    f"""SELECT event_id, ts, compose_service, line FROM {_LINES} WHERE {_ERRORS} AND regexp_full_match(compose_service, 'svc-[1-4]')
        ORDER BY ts DESC, event_id LIMIT 200""",
)
def _(t):
    found = logs.search(
        log_lines(t), {"compose_service": ("svc-[1-4]", None)}, values.ERROR_WORDS, logs.TAIL_LINES, tie=["event_id"]
    )
    return found.select("event_id", "ts", "compose_service", "line")


@query(
    "label_values",
    f"""SELECT DISTINCT compose_service FROM {_LINES} WHERE regexp_full_match(compose_service, '.+')
        AND NOT regexp_full_match(compose_service, 'svc-0|svc-3')""",
)
def _(t):
    return logs.label_values(log_lines(t), "compose_service", ".+", "svc-0|svc-3")


@query(
    "label_values_chained",
    f"SELECT DISTINCT container FROM {_LINES} WHERE regexp_full_match(compose_service, 'svc-1|svc-2')",
)
def _(t):
    return logs.label_values(log_lines(t), "container", labels={"compose_service": ("svc-1|svc-2", None)})


@query(
    "series_stats",
    f"""SELECT compose_service, max(n) AS max_n, avg(n) AS mean_n, CAST(sum(n) AS BIGINT) AS sum_n, arg_max(n, window_end) AS last_n
        FROM ({_series_sql(_ERRORS)}) GROUP BY 1""",
)
def _(t):
    series = logs.count_series(log_lines(t), ["compose_service"], pattern=values.ERROR_WORDS)
    return logs.series_stats(series, ["compose_service"], "n")


def samples(t: Tables) -> DataFrame:
    """Events as up/down samples of a job; some have no value."""
    up = F.when(F.col("value") < 10, 0.0).when(F.col("value") >= 20, 1.0)
    return t.events.select("event_id", "ts", F.col("event_type").alias("job"), up.alias("value"))


_SAMPLES = """(SELECT event_id, ts, event_type AS job,
              CASE WHEN value < 10 THEN 0.0::DOUBLE WHEN value >= 20 THEN 1.0::DOUBLE END AS value FROM events)"""


@query(
    "last_not_null",
    f"""SELECT job, value AS last, CASE WHEN value = 1 THEN 'UP' ELSE 'DOWN' END AS status FROM {_SAMPLES} WHERE value IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    return logs.service_status(samples(t), order=("ts", "event_id"))


@query(
    "availability",
    f"""SELECT job, date_trunc('minute', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE AS window_end,
        arg_max(value, (ts, event_id)) AS last, avg(value) AS up_ratio FROM {_SAMPLES}
        WHERE regexp_full_match(job, 'click|view') AND value IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return logs.availability(samples(t), "click|view", MINUTE, order=("ts", "event_id"))


@query(
    "errors_long_series",
    f"""SELECT compose_service, first_at + i * INTERVAL 15 SECOND AS window_end, count(*) AS n FROM (SELECT *,
        time_bucket(INTERVAL 15 SECOND, ts - INTERVAL 1 MICROSECOND) + INTERVAL 15 SECOND AS first_at,
        unnest(range(0, 5760)) AS i FROM {_LINES} WHERE {_ERRORS}) GROUP BY 1, 2""",
)
def _(t):
    return logs.count_long_series(log_lines(t), ["compose_service"], _DAY, timedelta(seconds=15), values.ERROR_WORDS)


def _panels(t: Tables) -> dict[str, DataFrame]:
    return dashboards.overview(log_lines(t), samples(t), AS_OF, _DAY, order=("ts", "event_id"))


@query(
    "panel_status",
    f"""SELECT job, value AS last, CASE WHEN value = 1 THEN 'UP' ELSE 'DOWN' END AS status, CASE WHEN value >= 1 THEN 'green' ELSE 'red'
        END AS band FROM {_SAMPLES} WHERE value IS NOT NULL AND {_RANGE}
        QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    return _panels(t)["status"]


@query(
    "panel_availability",
    f"""SELECT job, date_trunc('minute', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE AS window_end,
        arg_max(value, (ts, event_id)) AS last, avg(value) AS up_ratio FROM {_SAMPLES} WHERE {_RANGE} AND value IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return _panels(t)["availability"]


@query("panel_services", f"SELECT DISTINCT compose_service FROM {_LINES} WHERE {_RANGE}")
def _(t):
    return _panels(t)["services"]


@query(
    "panel_rate",
    f"""SELECT compose_service, window_end, n / 300.0::DOUBLE AS rate FROM ({_series_sql("ts > TIMESTAMP '2024-01-15 12:00:00' - "
        "INTERVAL 1445 MINUTE AND ts <= TIMESTAMP '2024-01-15 12:00:00'")}) WHERE {_RANGE.replace("ts ", "window_end ")}""",
)
def _(t):
    return _panels(t)["rate"]


def _stored_lines(t: Tables) -> str:
    """The log lines as a table in folders of days."""
    path = f"{t.scratch}/lines"
    log_lines(t).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    return path


@query(
    "log_search_clustered",
    f"""SELECT event_id, ts, compose_service, line FROM {_LINES} WHERE {_ERRORS} AND {_RANGE} AND compose_service IN ('svc-1', 'svc-4')
        ORDER BY ts DESC, event_id LIMIT 200""",
)
def _(t):
    # All days but the last are compacted; a search by service opens the files that cover it.
    path = _stored_lines(t)
    clustered.compact(t.spark, path, t.scratch, AS_OF.date(), file_bytes=1 << 18)
    lines = clustered.read_lines(t.spark, path, t.scratch, AS_OF, _DAY, ["svc-1", "svc-4"])
    return logs.search(lines, None, values.ERROR_WORDS, logs.TAIL_LINES, tie=["event_id"]).select("event_id", "ts", "compose_service", "line")


@query("panel_rate_rollup", QUERIES["panel_rate"].sql)
def _(t):
    # The same panel from counts per step: no line is read for it.
    path = _stored_lines(t)
    rollups.refresh(t.spark, path, t.scratch)
    counts = rollups.read_rollup(t.spark, t.scratch, AS_OF, _DAY + logs.RATE_RANGE)
    return rollups.shown(rollups.rate(counts, ["compose_service"], logs.RATE_RANGE), AS_OF, _DAY)


_CUT = AS_OF + timedelta(seconds=17, milliseconds=250)


@query("log_summary_rollup", QUERIES["log_summary"].sql.replace(_RANGE, f"ts > TIMESTAMP '{_CUT - _DAY:%Y-%m-%d %H:%M:%S.%f}' AND ts <= TIMESTAMP '{_CUT:%Y-%m-%d %H:%M:%S.%f}'"))
def _(t):
    # A range that cuts a step at either end: whole steps from the rollup, the lines of the two pieces from the table.
    path = _stored_lines(t)
    rollups.refresh(t.spark, path, t.scratch)
    labels = {"compose_service": ("svc-[0-5]", "svc-3")}
    return rollups.summary(rollups.read_rollup(t.spark, t.scratch), t.spark.read.parquet(path), _CUT, _DAY, labels, dashboards.LOG_STEPS)


@query(
    "availability_filled",
    f"""WITH steps AS (SELECT job, unnest(range(TIMESTAMP '2024-01-14 12:01:00', TIMESTAMP '2024-01-15 12:00:01', INTERVAL 1 MINUTE)) AS window_end
            FROM (SELECT DISTINCT job FROM {_SAMPLES} WHERE value IS NOT NULL AND ts > TIMESTAMP '2024-01-14 11:30:00'
                  AND ts <= TIMESTAMP '2024-01-15 12:00:00')),
        seen AS (SELECT job, ts, arg_max(value, event_id) AS value FROM {_SAMPLES} WHERE value IS NOT NULL GROUP BY job, ts),
        own AS (SELECT job, date_trunc('minute', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE AS window_end, avg(value) AS up_ratio
            FROM {_SAMPLES} WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT s.job, s.window_end, CASE WHEN v.ts > s.window_end - INTERVAL 30 MINUTE THEN v.value END AS last, o.up_ratio,
               CASE WHEN v.ts > s.window_end - INTERVAL 30 MINUTE THEN date_diff('microsecond', v.ts, s.window_end) / 1e6 END AS age_s
        FROM steps s ASOF LEFT JOIN seen v ON s.job = v.job AND s.window_end >= v.ts
        LEFT JOIN own o ON o.job = s.job AND o.window_end = s.window_end""",
)
def _(t):
    return logs.availability_filled(samples(t), AS_OF, _DAY, step=MINUTE, staleness=timedelta(minutes=30), order=("ts", "event_id"))


@query(
    "threshold_band",
    f"""SELECT compose_service, window_end, n, CASE WHEN n >= 5 THEN 'red' WHEN n >= 1 THEN 'orange' ELSE 'green' END AS band
        FROM ({_series_sql(_ERRORS)})""",
)
def _(t):
    series = logs.count_series(log_lines(t), ["compose_service"], pattern=values.ERROR_WORDS)
    return series.withColumn("band", values.band("n", values.ERROR_RATE_STEPS))


@query(
    "severity_flags",
    """SELECT doc_id, regexp_matches(text, '(error|exception|fatal|panic)', 'i') AS is_error,
       regexp_matches(text, '(warn|warning)', 'i') AS is_warning, regexp_matches(text, '(fatal|panic)', 'i') AS is_fatal
       FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in values.severity_flags("text").items()])


# ── Sources and sinks ────────────────────────────────────────────────────────


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_type <> 'PROMO'")
def _(t):
    # Rows of one type get a size that is no whole number; they must end in quarantine.
    text = _size_of_promo()
    t.part.select("p_partkey", text.alias("Size (cm)"), "p_name", "p_retailprice").write.option("header", True).csv(
        f"{t.scratch}/csv"
    )
    schema = "p_partkey bigint, p_name string, `Size (cm)` int, p_retailprice double"
    read = readers.read_csv(t.spark, f"{t.scratch}/csv", schemas.T.StructType.fromDDL(schema), corrupt=True)
    read.write.parquet(f"{t.scratch}/raw")
    good, _bad = tolerance.tolerate(t.spark.read.parquet(f"{t.scratch}/raw"), max_ratio=0.5)
    return good.withColumnRenamed("Size (cm)", "p_size")


def _size_of_promo() -> Column:
    size = F.col("p_size").cast("string")
    return F.when(F.col("p_type") == "PROMO", F.concat(size, F.lit(".5"))).otherwise(size)


@query("json_roundtrip", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS words, nullif(p_type, 'PROMO') AS p_type FROM part")
def _(t):
    kind = F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type")
    t.part.select("p_partkey", F.split("p_name", " ").alias("words"), kind).write.json(f"{t.scratch}/json")
    schema = schemas.T.StructType.fromDDL("p_partkey bigint, words array<string>, p_type string")
    read = readers.read_json(t.spark, f"{t.scratch}/json", schema, lines=True)
    return read.withColumn("words", joined("words"))


#: Ranges of a read of JSON arrays: no shorter than 64 KB, and about 256 in all until they have the size that Spark's own have.
_LEAST_RANGE, _RANGES, _MOST_RANGE = 65_536, 256, 128 * 1024**2


def range_bytes(total: int) -> int:
    """Bytes of a range, of which each costs two tasks: their number must not grow with every 64 KB of the input."""
    return min(max(_LEAST_RANGE, total // _RANGES), _MOST_RANGE)


@query(
    "json_array_split",
    """SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, array_length(string_split(o_orderpriority, '-')) AS n_parts,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders""",
)
def _(t):
    # The orders of a customer as one JSON array after the other, read back in ranges of 64 KB or more, in the order of the files.
    order = F.struct("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.split("o_orderpriority", "-").alias("parts"))
    arrays_of = t.orders.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(order))).alias("value"))
    arrays_of.select("value").write.text(f"{t.scratch}/arrays")
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double, parts array<string>")
    size = "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(size)
    t.spark.conf.set(size, str(range_bytes(bytes_under(t.spark, f"{t.scratch}/arrays"))))
    try:
        readers.read_json(t.spark, f"{t.scratch}/arrays", schema, seq=True).write.parquet(f"{t.scratch}/read")
    finally:
        t.spark.conf.set(size, before)
    read = t.spark.read.parquet(f"{t.scratch}/read")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(readers.SEQ)).cast("bigint").alias("place")
    return read.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.size("parts").cast("bigint").alias("n_parts"), place)


@query(
    "absent_source",
    """SELECT 'external_csv' AS source, c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT 'api', c_custkey, c_name FROM customer WHERE false""",
)
def _(t):
    here = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.union_tagged(
        {"external_csv": here, "api": readers.read_or_empty(t.spark, f"{t.scratch}/absent.csv", here.schema)}
    )


@query("version_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal <= 0 UNION ALL SELECT * EXCLUDE (s_nationkey) FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    versions.write_version(rows.filter("s_acctbal <= 0"), t.scratch, "raw", "supplier", "2026-01-01T00-00-00Z")
    versions.full_refresh(rows, f"{t.scratch}/raw/supplier", "2026-01-02T00-00-00Z")
    first = versions.read_version(t.spark, t.scratch, "raw", "supplier", "2026-01-01T00-00-00Z")
    return first.unionByName(versions.read_version(t.spark, t.scratch, "raw", "supplier"))


@query("backup_restore", "SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'nation', n_nationkey FROM nation")
def _(t):
    tables = {
        "customer": t.customer.select(F.col("c_custkey").alias("id")),
        "nation": t.nation.select(F.col("n_nationkey").cast("bigint").alias("id")),
    }
    backups.backup(tables, t.scratch, "accounts", "2026-01-01T03-00-00Z")
    emptied = {name: clean.delete_where(df, F.col("id") >= 0) for name, df in tables.items()}
    versions.write_tables(emptied, t.scratch, "serving", "accounts", "2026-01-02T00-00-00Z")
    backups.restore(t.spark, t.scratch, "accounts", target=f"{t.scratch}/serving/accounts")
    return merge.union_tagged(versions.read_tables(t.spark, t.scratch, "serving", "accounts"))


@query(
    "publication_two_datasets",
    """SELECT 'customer' AS source, 1 AS number, c_custkey AS id, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', 1, s_suppkey, s_acctbal FROM supplier
       UNION ALL SELECT 'customer', 2, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0
       UNION ALL SELECT 'supplier', 2, s_suppkey, s_acctbal FROM supplier""",
)
def _(t):
    # One entry publishes two datasets, the next one of them; both are read as of either entry.
    kinds = {"customer": ("c_custkey", "c_acctbal"), "supplier": ("s_suppkey", "s_acctbal")}
    frames = {name: getattr(t, name).select(F.col(i).alias("id"), F.col(b).alias("balance")) for name, (i, b) in kinds.items()}
    staged = [versions.stage_tables({"data": df}, t.scratch, "accounts", name, "first") for name, df in frames.items()]
    versions.publish(t.spark, t.scratch, staged)
    versions.write_version(frames["customer"].filter("balance > 0"), t.scratch, "accounts", "customer", "second")
    seen = [
        versions.read_tables(t.spark, t.scratch, "accounts", name, number=number)["data"].withColumns(
            {"source": F.lit(name), "number": F.lit(number)}
        )
        for name in kinds
        for number in (1, 2)
    ]
    return merge.union_all(seen)


@query(
    "upsert_touched",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'late' ELSE o_orderstatus END AS o_orderstatus,
       o_orderkey % 100 = 0 AS updated FROM orders UNION ALL SELECT -1 - s_suppkey, 'new', true FROM supplier""",
)
def _(t):
    # All orders first, then a batch of changed and new ones: only the buckets of its keys are written again.
    schema = T.StructType.fromDDL("o_orderkey bigint, o_orderstatus string, created_at timestamp, updated_at timestamp")
    first = t.orders.select("o_orderkey", "o_orderstatus")
    changed = t.orders.filter("o_orderkey % 100 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus"))
    new = t.supplier.select((-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))
    old = None
    for label, batch, load_ts in (("1", first, OLD_TS), ("2", changed.unionByName(new), LOAD_TS)):
        folder = publications.claim(t.spark, t.scratch, "sales/orders", label)
        merged = buckets.upsert_buckets(batch, t.scratch, old, folder, "orders", ("o_orderkey",), schema, 2000, load_ts=load_ts)
        versions.publish(t.spark, t.scratch, [versions.Version("sales/orders", label, folder, (merged.table,))])
        old = versions.resolve(t.spark, t.scratch, "sales", "orders")
    rows = versions.read_tables(t.spark, t.scratch, "sales", "orders")["orders"]
    return rows.select("o_orderkey", "o_orderstatus", (F.col("updated_at") == F.lit(LOAD_TS)).alias("updated"))


# ── Whole loads on source files derived from the tables ──────────────────────


def _seq(key: str) -> Column:
    return F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col(key).alias("row")).alias(readers.SEQ)


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def landed_food(t: Tables) -> DataFrame:
    """Parts as landed foods: several rows per name, a missing category, calories that are no number."""
    calories = F.when(F.col("p_size") == 13, "13.0").otherwise(_text("p_size"))
    category = F.when(F.col("p_type") == "PROMO", "").when(F.col("p_type") == "LARGE", "None").otherwise(F.col("p_type"))
    cells = {
        "Food_Item": F.col("p_name"),
        "Category": category,
        "Calories (kcal)": calories,
        "Protein (g)": _text("p_retailprice"),
        "Meal_Type": F.col("p_brand"),
        "Water_Intake (ml)": _text("p_partkey"),
    }
    rest = {h: F.lit("0") for h, _, _ in schemas.DAILY_FOOD if h not in cells}
    return t.part.select(*[c.alias(h) for h, c in {**cells, **rest}.items()], _seq("p_partkey"))


_FOOD = """(SELECT *, CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'LARGE' THEN 'None' ELSE p_type END AS category
           FROM part WHERE p_size <> 13)"""


def _raw(landed: DataFrame, columns) -> DataFrame:
    raw = warehouse.raw_csv(landed, columns)
    return raw.filter(F.col(readers.CORRUPT).isNull()).drop(readers.CORRUPT)


def _warehouse(dataset: str, table: str, *raws: DataFrame) -> DataFrame:
    return warehouse.build(dataset, raws, LOAD_TS, only=[table])[table]


def _widened(df: DataFrame, *cols: str) -> DataFrame:
    out = df.select(*cols)
    return out.withColumns({c: F.col(c).cast("double") for c, kind in out.dtypes if kind == "float"}).withColumns(
        {c: joined(c) for c, kind in out.dtypes if kind.startswith("array")}
    )


@query(
    "warehouse_food_item",
    f"""SELECT {sid('p_name')} AS id, p_name AS name, p_brand AS meal_type, CAST({sid('category')} AS VARCHAR) AS category_ids,
        category AS category_names, CAST(p_size AS BIGINT) AS calories, p_retailprice::FLOAT::DOUBLE AS protein_g,
        p_partkey AS water_intake_ml FROM {_FOOD}
        QUALIFY row_number() OVER (PARTITION BY p_brand, p_size, p_name ORDER BY p_partkey DESC) = 1""",
)
def _(t):
    item = _warehouse("daily_food", "food_item", _raw(landed_food(t), schemas.DAILY_FOOD))
    return _widened(
        item, "id", "name", "meal_type", "category_ids", "category_names", "calories", "protein_g", "water_intake_ml"
    )


@query(
    "warehouse_food_category",
    f"SELECT DISTINCT {sid('category')} AS id, category AS name FROM {_FOOD} WHERE category <> ''",
)
def _(t):
    return _warehouse("daily_food", "food_category", _raw(landed_food(t), schemas.DAILY_FOOD)).select("id", "name")


def _known_categories(t: Tables) -> DataFrame:
    known = t.part.filter(F.col("p_type").isin("SMALL", "ECONOMY")).select(F.col("p_type").alias("name")).distinct()
    return known.select(
        F.length("name").cast("bigint").alias("id"),
        "name",
        F.lit(OLD_TS).alias("created_at"),
        F.lit(OLD_TS).alias("updated_at"),
    )


def _serving_food(t: Tables, table: str) -> DataFrame:
    current = {"food_category": _known_categories(t)}
    return serving.build("food_item", landed_food(t), current, LOAD_TS, only=[table])[table]


@query(
    "serving_food_item",
    f"""SELECT {sid('p_name')} AS id, p_name AS name, p_brand AS meal_type, CASE WHEN category IN ('', 'None') THEN ''
        WHEN category IN ('SMALL', 'ECONOMY') THEN CAST(length(category) AS VARCHAR) ELSE CAST({sid('category')} AS VARCHAR) END
        AS category_ids, CAST(p_size AS BIGINT) AS calories, p_retailprice AS protein_g, p_partkey AS water_intake_ml FROM {_FOOD}
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
)
def _(t):
    return _widened(
        _serving_food(t, "food_item"), "id", "name", "meal_type", "category_ids", "calories", "protein_g", "water_intake_ml"
    )


@query(
    "serving_food_category",
    f"""SELECT DISTINCT CASE WHEN category IN ('SMALL', 'ECONOMY') THEN CAST(length(category) AS BIGINT) ELSE {sid('category')} END
        AS id, category AS name, category NOT IN ('SMALL', 'ECONOMY') AS created_now FROM {_FOOD} WHERE category NOT IN ('', 'None')""",
)
def _(t):
    return _serving_food(t, "food_category").select("id", "name", (F.col("created_at") == F.lit(LOAD_TS)).alias("created_now"))


def landed_diet(t: Tables) -> DataFrame:
    """Orders as landed diet rows: a customer is a patient with several rows."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    cells = {
        "Patient_ID": F.concat(F.lit("P"), "o_custkey"),
        "Age": _text(F.col("o_orderkey") % 80 + 18),
        "Gender": F.when(status == "F", "Female").otherwise("Male"),
        "Weight_kg": _text(F.col("o_totalprice")),
        "Height_cm": _text(F.col("o_orderkey") % 50 + 150),
        "Disease_Type": F.when(priority == "1-URGENT", "").when(priority == "2-HIGH", "None").otherwise(priority),
        "Severity": F.when(status == "O", "None").otherwise(status),
        "Physical_Activity_Level": status,
        "Daily_Caloric_Intake": _text(F.col("o_orderkey") % 1000 + 1500),
        "Dietary_Restrictions": F.when(status == "P", "None").otherwise(status),
        "Allergies": F.when(status == "F", "").otherwise(priority),
        "Preferred_Cuisine": priority,
        "Diet_Recommendation": status,
        "BMI": _text(F.col("o_orderkey") % 20 + 18),
        "Cholesterol_mg/dL": _text(F.col("o_orderkey") % 101 + 150),
        "Blood_Pressure_mmHg": _text(F.col("o_orderkey") % 61 + 90),
        "Glucose_mg/dL": _text(F.col("o_orderkey") % 71 + 80),
        "Weekly_Exercise_Hours": _text(F.col("o_orderkey") % 11),
        "Adherence_to_Diet_Plan": _text(F.col("o_orderkey") % 91),
        "Dietary_Nutrient_Imbalance_Score": _text(F.col("o_orderkey") % 7),
    }
    rest = {h: F.lit("1.5") for h, _, _ in schemas.DIET if h not in cells}
    return t.orders.select(*[c.alias(h) for h, c in {**cells, **rest}.items()], _seq("o_orderkey"))


_DIET = """(SELECT o_orderkey AS seq, 'P' || o_custkey AS pid, o_orderkey % 80 + 18 AS age,
    CASE WHEN o_orderstatus = 'F' THEN 'Female' ELSE 'Male' END AS gender, o_totalprice AS weight,
    o_orderkey % 50 + 150 AS height, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS disease,
    nullif(o_orderstatus, 'O') AS severity, o_orderstatus AS status, o_orderkey % 1000 + 1500 AS kcal,
    nullif(o_orderstatus, 'P') AS restriction, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS allergy,
    o_orderpriority AS cuisine, CAST(o_orderkey % 20 + 18 AS DOUBLE) AS bmi, CAST(o_orderkey % 101 + 150 AS DOUBLE) AS cholesterol,
    CAST(o_orderkey % 61 + 90 AS DOUBLE) AS pressure, CAST(o_orderkey % 71 + 80 AS DOUBLE) AS glucose, CAST(o_orderkey % 11 AS DOUBLE) AS hours,
    CAST(o_orderkey % 91 AS DOUBLE) AS adherence, CAST(o_orderkey % 7 AS DOUBLE) AS imbalance FROM orders)"""


def _newest(keys: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) = 1"


_DISEASES = f"""CASE WHEN disease IS NULL THEN '[]' ELSE
    CAST(to_json([{{'id': {sid('disease')}, 'severity': severity}}]) AS VARCHAR) END"""


def _warehouse_diet(t: Tables, table: str) -> DataFrame:
    return _warehouse("diet_recommendation", table, _raw(landed_diet(t), schemas.DIET))


@query(
    "warehouse_patient",
    f"""SELECT {sid('pid')} AS id, pid AS id_data_set, age::SMALLINT AS age, gender,
        CASE WHEN allergy IS NULL THEN '' ELSE CAST({sid('allergy')} AS VARCHAR) END AS allergy_ids,
        coalesce(allergy, '') AS allergy_names, {_DISEASES} AS diseases FROM {_DIET} {_newest('pid')}""",
)
def _(t):
    return _widened(
        _warehouse_diet(t, "patient"), "id", "id_data_set", "age", "gender", "allergy_ids", "allergy_names", "diseases"
    )


@query(
    "warehouse_metrics",
    f"""SELECT {sid('pid', "'metrics'")} AS id, {sid('pid')} AS patient_id, weight::FLOAT::DOUBLE AS weight_kg,
        height::INTEGER AS height_cm, bmi, cholesterol AS cholesterol_mg_dl, pressure AS blood_pressure_mmhg, glucose AS glucose_mg_dl
        FROM {_DIET} {_newest('pid')}""",
)
def _(t):
    measures = ("weight_kg", "height_cm", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl")
    return _widened(_warehouse_diet(t, "metrics"), "id", "patient_id", *measures)


@query(
    "warehouse_exercises",
    f"""SELECT {sid('pid', "'exercises'")} AS id, {sid('pid')} AS patient_id, hours AS weekly_exercise_hours,
        status AS physical_activity_level FROM {_DIET} {_newest('pid')}""",
)
def _(t):
    return _widened(_warehouse_diet(t, "exercises"), "id", "patient_id", "weekly_exercise_hours", "physical_activity_level")


@query(
    "warehouse_diets",
    f"""SELECT {sid('pid', 'kcal', 'status')} AS id, kcal AS daily_caloric_intake, {sid('pid')} AS patient_id,
        CASE WHEN restriction IS NULL THEN 0 ELSE {sid('restriction')} END AS dietary_restriction_id,
        {sid('cuisine')} AS preferred_cuisine_id, {sid('status')} AS diet_recommendation_id,
        cuisine AS preferred_cuisine_name, coalesce(restriction, '') AS dietary_restriction_name,
        status AS diet_recommendation_name, adherence AS adherence_to_diet_plan, imbalance AS dietary_nutrient_imbalance_score,
        age::SMALLINT AS patient_age, gender AS patient_gender FROM {_DIET} {_newest('cuisine, kcal, pid, status')}""",
)
def _(t):
    return _widened(
        _warehouse_diet(t, "diets"),
        "id",
        "daily_caloric_intake",
        "patient_id",
        "dietary_restriction_id",
        "preferred_cuisine_id",
        "diet_recommendation_id",
        "preferred_cuisine_name",
        "dietary_restriction_name",
        "diet_recommendation_name",
        "adherence_to_diet_plan",
        "dietary_nutrient_imbalance_score",
        "patient_age",
        "patient_gender",
    )


_DIET_DIMS = ("disease", "allergy", "preferred_cuisine", "dietary_restriction", "diet_recommendation")


@query(
    "warehouse_diet_dims",
    f"""SELECT dim, {sid('name')} AS id, name FROM (SELECT DISTINCT 'disease' AS dim, disease AS name FROM {_DIET}
        UNION ALL SELECT DISTINCT 'allergy', allergy FROM {_DIET} UNION ALL SELECT DISTINCT 'preferred_cuisine', cuisine FROM {_DIET}
        UNION ALL SELECT DISTINCT 'dietary_restriction', restriction FROM {_DIET}
        UNION ALL SELECT DISTINCT 'diet_recommendation', status FROM {_DIET}) WHERE name IS NOT NULL""",
)
def _(t):
    tables = warehouse.build("diet_recommendation", [_raw(landed_diet(t), schemas.DIET)], LOAD_TS, only=_DIET_DIMS)
    return merge.union_tagged({d: df.select("id", "name") for d, df in tables.items()}, "dim")


def _known_patients(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("P"), "c_custkey").alias("id_data_set"),
        F.lit(0).cast("bigint").alias("age"),
        F.lit("").alias("gender"),
        F.array().cast("array<bigint>").alias("allergy_ids"),
        F.lit("[]").alias("diseases"),
        F.lit(OLD_TS).alias("created_at"),
        F.lit(OLD_TS).alias("updated_at"),
    )


def _known_metrics(t: Tables) -> DataFrame:
    cols = ("bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl")
    return t.customer.filter("c_acctbal > 5000").select(
        (-F.col("c_custkey")).alias("id"),
        F.col("c_custkey").alias("patient_id"),
        F.col("c_acctbal").alias("weight_kg"),
        F.lit(1).cast("bigint").alias("height_cm"),
        *[F.lit(0.0).alias(c) for c in cols],
        F.lit(OLD_TS).alias("created_at"),
        F.lit(OLD_TS).alias("updated_at"),
    )


def _serving_diet(t: Tables, table: str) -> DataFrame:
    current = {"patient": _known_patients(t), "metrics": _known_metrics(t)}
    return serving.build("diet", landed_diet(t), current, LOAD_TS, only=[table])[table]


_PATIENT_KEYS = "(SELECT c_custkey, 'P' || c_custkey AS known FROM customer WHERE c_acctbal > 0)"


@query(
    "serving_patient",
    f"""SELECT coalesce(c_custkey, {sid('pid')}) AS id, coalesce(pid, known) AS id_data_set, coalesce(age, 0) AS age,
        coalesce(gender, '') AS gender, CASE WHEN allergy IS NULL THEN '' ELSE CAST({sid('allergy')} AS VARCHAR) END AS allergy_ids,
        {_DISEASES} AS diseases, c_custkey IS NULL AS created_now, pid IS NOT NULL AS updated_now
        FROM (SELECT * FROM {_DIET} {_newest('pid')}) FULL JOIN {_PATIENT_KEYS} ON pid = known""",
)
def _(t):
    patient = _serving_diet(t, "patient")
    stamped = patient.withColumns(
        {
            "created_now": F.col("created_at") == F.lit(LOAD_TS),
            "updated_now": F.col("updated_at") == F.lit(LOAD_TS),
        }
    )
    return _widened(
        stamped, "id", "id_data_set", "age", "gender", "allergy_ids", "diseases", "created_now", "updated_now"
    )


@query(
    "serving_metrics",
    f"""SELECT -c_custkey AS id, c_custkey AS patient_id, c_acctbal AS weight_kg, CAST(1 AS BIGINT) AS height_cm, 0.0::DOUBLE AS bmi,
        0.0::DOUBLE AS cholesterol_mg_dl, 0.0::DOUBLE AS blood_pressure_mmhg, 0.0::DOUBLE AS glucose_mg_dl FROM customer
        WHERE c_acctbal > 5000 UNION ALL SELECT {sid('patient_id', "'metrics'")}, patient_id, weight, height, bmi, cholesterol, pressure, glucose
        FROM (SELECT *, coalesce(c_custkey, {sid('pid')}) AS patient_id FROM (SELECT * FROM {_DIET}
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq) = 1) LEFT JOIN {_PATIENT_KEYS} ON pid = known)
        WHERE patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
)
def _(t):
    measures = ("weight_kg", "height_cm", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl")
    return _serving_diet(t, "metrics").select("id", "patient_id", *measures)


@query(
    "serving_diets",
    f"""SELECT {sid('patient_id', "'diets'")} AS id, kcal AS daily_caloric_intake, patient_id,
        CASE WHEN restriction IS NULL THEN NULL ELSE {sid('restriction')} END AS dietary_restriction_id,
        {sid('cuisine')} AS preferred_cuisine_id, {sid('status')} AS diet_recommendation_id, adherence AS adherence_to_diet_plan,
        imbalance AS dietary_nutrient_imbalance_score FROM (SELECT *, coalesce(c_custkey, {sid('pid')}) AS patient_id FROM (SELECT * FROM {_DIET} {_newest('pid')})
        LEFT JOIN {_PATIENT_KEYS} ON pid = known)""",
)
def _(t):
    return _serving_diet(t, "diets").select(
        "id",
        "daily_caloric_intake",
        "patient_id",
        "dietary_restriction_id",
        "preferred_cuisine_id",
        "diet_recommendation_id",
        "adherence_to_diet_plan",
        "dietary_nutrient_imbalance_score",
    )


@query(
    "serving_exercises",
    f"""SELECT {sid('patient_id', "'exercises'")} AS id, patient_id, hours AS weekly_exercise_hours, status AS physical_activity_level
        FROM (SELECT coalesce(c_custkey, {sid('pid')}) AS patient_id, status, hours FROM (SELECT * FROM {_DIET}
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq) = 1) LEFT JOIN {_PATIENT_KEYS} ON pid = known)""",
)
def _(t):
    return _serving_diet(t, "exercises").select("id", "patient_id", "weekly_exercise_hours", "physical_activity_level")


@query(
    "serving_diet_dims",
    f"""SELECT dim, {sid('name')} AS id, name FROM (
        SELECT DISTINCT 'disease' AS dim, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'None' ELSE o_orderpriority END AS name FROM orders
        UNION ALL SELECT DISTINCT 'allergy', allergy FROM {_DIET} UNION ALL SELECT DISTINCT 'preferred_cuisine', cuisine FROM {_DIET}
        UNION ALL SELECT DISTINCT 'dietary_restriction', coalesce(restriction, 'None') FROM {_DIET}
        UNION ALL SELECT DISTINCT 'diet_recommendation', status FROM {_DIET}) WHERE name NOT IN ('', 'None')""",
)
def _(t):
    tables = serving.build("diet", landed_diet(t), {}, LOAD_TS, only=_DIET_DIMS)
    return merge.union_tagged({d: df.select("id", "name") for d, df in tables.items()}, "dim")


def landed_exercise(t: Tables) -> DataFrame:
    """Parts as landed exercises: several per name, some without equipment."""
    words = F.split("p_name", " ")
    return t.part.select(
        _text("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("force"),
        F.col("p_type").alias("level"),
        F.when(F.col("p_type") == "SMALL", "compound").alias("mechanic"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("equipment"),
        F.col("p_brand").alias("category"),
        words.alias("primaryMuscles"),
        F.array("p_type", F.lit(""), F.element_at(words, 1)).alias("secondaryMuscles"),
        F.array("p_name", "p_brand").alias("instructions"),
        F.array().cast("array<string>").alias("images"),
        _seq("p_partkey"),
    )


def _ids_sql(elements: str) -> str:
    return f"array_to_string(list_transform({elements}, lambda m: {sid('m')}), ',')"


@query(
    "warehouse_exercise",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, '' AS force, p_type AS level,
        CAST(to_json([p_name, p_brand]) AS VARCHAR) AS instruction, '[]' AS photo,
        {_ids_sql("string_split(p_name, ' ')")} AS primary_muscle_ids,
        {_ids_sql("[p_type, '', split_part(p_name, ' ', 1)]")} AS secondary_muscle_ids,
        {sid('p_brand')} AS category_id, CASE WHEN p_type = 'PROMO' THEN 0 ELSE {sid('p_type')} END AS equipment_id,
        CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END AS equipment_name FROM part""",
)
def _(t):
    raw = warehouse.raw_exercise(landed_exercise(t)).drop(readers.CORRUPT)
    return _widened(
        _warehouse("exercise_db", "exercise", raw),
        "id",
        "name",
        "force",
        "level",
        "instruction",
        "photo",
        "primary_muscle_ids",
        "secondary_muscle_ids",
        "category_id",
        "equipment_id",
        "equipment_name",
    )


@query(
    "warehouse_exercise_dims",
    f"""SELECT dim, {sid('name')} AS id, name FROM (SELECT DISTINCT 'muscle' AS dim, unnest(string_split(p_name, ' ') || [p_type]) AS name
        FROM part UNION ALL SELECT DISTINCT 'equipment', p_type FROM part WHERE p_type <> 'PROMO'
        UNION ALL SELECT DISTINCT 'exercise_category', p_brand FROM part)""",
)
def _(t):
    names = ("muscle", "equipment", "exercise_category")
    tables = warehouse.build("exercise_db", [warehouse.raw_exercise(landed_exercise(t))], LOAD_TS, only=names)
    return merge.union_tagged({d: df.select("id", "name") for d, df in tables.items()}, "dim")


@query(
    "serving_exercise",
    f"""SELECT {sid('p_name')} AS id, p_name AS name, p_type AS level, CASE WHEN p_type = 'SMALL' THEN 'compound' END AS mechanic,
        {_ids_sql("string_split(p_name, ' ')")} AS primary_muscle_ids,
        {_ids_sql("[p_type, split_part(p_name, ' ', 1)]")} AS secondary_muscle_ids,
        {sid('p_brand')} AS category_id, CASE WHEN p_type <> 'PROMO' THEN {sid('p_type')} END AS equipment_id FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
)
def _(t):
    return _widened(
        serving.build("exercise", landed_exercise(t), {}, LOAD_TS, only=["exercise"])["exercise"],
        "id",
        "name",
        "level",
        "mechanic",
        "primary_muscle_ids",
        "secondary_muscle_ids",
        "category_id",
        "equipment_id",
    )


@query(
    "serving_exercise_dims",
    f"""SELECT dim, {sid('name')} AS id, name FROM (SELECT DISTINCT 'muscle' AS dim, unnest(string_split(p_name, ' ') || [p_type]) AS name
        FROM part UNION ALL SELECT DISTINCT 'equipment', p_type FROM part WHERE p_type <> 'PROMO'
        UNION ALL SELECT DISTINCT 'exercise_category', p_brand FROM part)""",
)
def _(t):
    names = ("muscle", "equipment", "exercise_category")
    tables = serving.build("exercise", landed_exercise(t), {}, LOAD_TS, only=names)
    return merge.union_tagged({d: df.select("id", "name") for d, df in tables.items()}, "dim")


def _sessions(df: DataFrame, columns, **cells: Column) -> DataFrame:
    """Text cells under the headers of a source; a column without a cell holds 1."""
    return df.select(*[_text(cells.get(name, F.lit("1"))).alias(header) for header, name, _ in columns])


def landed_sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Order lines as landed sessions of the external file and orders as those of the API: many are alike."""
    external = _sessions(
        t.lineitem,
        schemas.WORKOUT,
        age=F.col("l_quantity").cast("int"),
        gender=F.col("l_returnflag"),
        weight_kg=F.col("l_linenumber") + 40,
        max_bpm=F.col("l_quantity").cast("int") + 100,
        session_duration_hours=F.col("l_quantity") / 4,
        workout_frequency_days_week=F.col("l_linenumber"),
        workout_type=F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("W"), "l_linenumber")),
        calories_burned=F.col("l_quantity"),
    )
    api = _sessions(
        t.orders, schemas.WORKOUT_API, age=F.lit(30), gender=F.col("o_orderstatus"), bmi=F.length("o_orderpriority"), workout_type=F.col("o_orderpriority")
    )
    return external, api


def raw_sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The landed sessions with typed columns, each source by its own header."""
    external, api = landed_sessions(t)
    return _raw(external, schemas.WORKOUT), _raw(api, schemas.WORKOUT_API)


#: Names of session measures in the warehouse, where they differ from those of the source.
_SESSION_NAMES = {"workout_frequency_days_week": "workout_frequency_per_week", "session_duration_hours": "duration_hours", "calories_burned": "calories"}
_SESSION_TYPES = {"Float32": "FLOAT::DOUBLE", "UInt8": "SMALLINT", "UInt16": "INTEGER", "String": "VARCHAR"}


def _session_sql(source: str, table: str, **cells: str) -> str:
    """The sessions of a source in SQL; each cell is the text of a column, and columns without one hold 1."""
    texts = {name: cells.get(name, "'1.0'" if kind == "Float32" else "'1'") for _, name, kind in schemas.WORKOUT}
    inner = ", ".join(f"{text} AS {name}" for name, text in texts.items())
    out = [
        f"{name}::{_SESSION_TYPES[kind]} AS {_SESSION_NAMES.get(name, name)}"
        for _, name, kind in schemas.WORKOUT
        if name != "workout_type"
    ]
    return f"""SELECT {sid(f"({sid_text(f"'{source}'", *texts)})", 'i')} AS id, '{source}' AS source, 0::BIGINT AS member_id, 0::BIGINT AS snapshot_id,
        {', '.join(out)}, {sid('workout_type')} AS workout_type_id, workout_type AS workout_type_name, CAST(NULL AS VARCHAR) AS started_at
        FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(texts)}) AS i FROM (SELECT {inner} FROM {table}))"""


@query(
    "warehouse_session",
    _session_sql(
        "external_csv",
        "lineitem",
        age="CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)",
        gender="l_returnflag",
        weight_kg="(l_linenumber + 40) || '.0'",
        max_bpm="CAST(CAST(l_quantity AS INTEGER) + 100 AS VARCHAR)",
        session_duration_hours="CAST(l_quantity / 4 AS VARCHAR)",
        workout_frequency_days_week="CAST(l_linenumber AS VARCHAR)",
        workout_type="CASE WHEN l_linenumber = 7 THEN '' ELSE 'W' || l_linenumber END",
        calories_burned="CAST(l_quantity AS VARCHAR)",
    )
    + " UNION ALL "
    + _session_sql("api", "orders", age="'30'", gender="o_orderstatus", bmi="length(o_orderpriority) || '.0'", workout_type="o_orderpriority"),
)
def _(t):
    session = _warehouse("workout_session", "session", *raw_sessions(t))
    columns = [c for c in session.columns if c not in ("created_at", "updated_at")]
    return _widened(session.withColumn("started_at", _text("started_at")), *columns)


@query(
    "warehouse_workout_type",
    f"""SELECT {sid('name')} AS id, name FROM (SELECT 'W' || l_linenumber AS name FROM lineitem WHERE l_linenumber <> 7
        UNION SELECT o_orderpriority FROM orders)""",
)
def _(t):
    return _warehouse("workout_session", "workout_type", *raw_sessions(t)).select("id", "name")


# ── Whole jobs ───────────────────────────────────────────────────────────────


def _written(t: Tables) -> str:
    """The landed shapes of the given tables as source files in a folder."""
    folder = f"{t.scratch}/in"
    names = {name: file for name, file, _, _ in landing.EXTERNAL}
    external, api = landed_sessions(t)
    files = {"daily_food": landed_food(t).drop(readers.SEQ), "diet_recommendation": landed_diet(t).drop(readers.SEQ), "workout_session": external}
    with ThreadPoolExecutor(max_workers=versions.AT_ONCE) as pool:
        written = [pool.submit(df.write.option("header", True).csv, f"{folder}/{names[name]}") for name, df in files.items()]
        written.append(pool.submit(api.write.option("header", True).csv, f"{folder}/workout_export.csv"))
        written.append(pool.submit(landed_exercise(t).drop(readers.SEQ).write.json, f"{folder}/{names['exercise']}"))
        for one in written:
            one.result()
    return folder


#: Per table of a whole job: the query that has its rows, the columns compared as text, and those added up.
_WHOLE_WAREHOUSE = {
    "food_category": ("warehouse_food_category", ["name"], []),
    "food_item": ("warehouse_food_item", ["name", "meal_type", "category_ids", "category_names"], ["calories", "protein_g", "water_intake_ml"]),
    "patient": ("warehouse_patient", ["id_data_set", "gender", "allergy_ids", "allergy_names", "diseases"], ["age"]),
    "metrics": ("warehouse_metrics", ["patient_id"], ["weight_kg", "height_cm", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl"]),
    "exercises": ("warehouse_exercises", ["patient_id", "physical_activity_level"], ["weekly_exercise_hours"]),
    "diets": (
        "warehouse_diets",
        ["patient_id", "dietary_restriction_id", "preferred_cuisine_id", "diet_recommendation_id", "preferred_cuisine_name",
         "dietary_restriction_name", "diet_recommendation_name", "patient_gender"],
        ["daily_caloric_intake", "adherence_to_diet_plan", "dietary_nutrient_imbalance_score", "patient_age"],
    ),
    "exercise": (
        "warehouse_exercise",
        ["name", "force", "level", "instruction", "photo", "primary_muscle_ids", "secondary_muscle_ids", "category_id", "equipment_id", "equipment_name"],
        [],
    ),
    "workout_type": ("warehouse_workout_type", ["name"], []),
    "session": (
        "warehouse_session",
        ["source", "gender", "workout_type_id", "workout_type_name"],
        ["member_id", "snapshot_id", "age", "height_m", "weight_kg", "bmi", "fat_percentage", "experience_level", "workout_frequency_per_week",
         "duration_hours", "calories", "avg_bpm", "max_bpm", "resting_bpm", "water_intake_liters"],
    ),
}
_WHOLE_SERVING = {
    "food_category": ("serving_food_category", ["name"], []),
    "food_item": ("serving_food_item", ["name", "meal_type", "category_ids"], ["calories", "protein_g", "water_intake_ml"]),
    "patient": ("serving_patient", ["id_data_set", "gender", "allergy_ids", "diseases"], ["age"]),
    "metrics": ("serving_metrics", ["patient_id"], ["weight_kg", "height_cm", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl"]),
    "exercises": ("serving_exercises", ["patient_id", "physical_activity_level"], ["weekly_exercise_hours"]),
    "diets": (
        "serving_diets",
        ["patient_id", "dietary_restriction_id", "preferred_cuisine_id", "diet_recommendation_id"],
        ["daily_caloric_intake", "adherence_to_diet_plan", "dietary_nutrient_imbalance_score"],
    ),
    "exercise": ("serving_exercise", ["name", "level", "mechanic", "primary_muscle_ids", "secondary_muscle_ids", "category_id", "equipment_id"], []),
}


def _whole_sql(tables: dict, dims: tuple[str, ...]) -> str:
    """All rows of all tables, each with its columns as one text and its numbers weighted and added up."""
    parts = [f"SELECT dim, CAST(id AS VARCHAR) AS id, name AS cells, 0.0::DOUBLE AS numbers FROM ({QUERIES[q].sql})" for q in dims]
    for name, (of, texts, numbers) in tables.items():
        cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in texts)
        added = " + ".join(["0.0::DOUBLE", *[f"coalesce(CAST({c} AS DOUBLE), -1) * {i}" for i, c in enumerate(numbers, 1)]])
        parts.append(f"SELECT '{name}', CAST(id AS VARCHAR), concat_ws('|', {cells}), {added} FROM ({QUERIES[of].sql})")
    return " UNION ALL ".join(f"({p})" for p in parts)


def _whole(frames: dict[str, DataFrame], tables: dict) -> DataFrame:
    rows = []
    for name, df in frames.items():
        _, texts, numbers = tables.get(name, ("", ["name"], []))
        df = _widened(df, "id", *texts, *numbers)
        added = F.lit(0.0)
        for i, c in enumerate(numbers, 1):
            added = added + F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) * i
        cells = F.concat_ws("|", *[F.coalesce(_text(c), F.lit("~")) for c in texts])
        rows.append(df.select(F.lit(name).alias("dim"), _text("id").alias("id"), cells.alias("cells"), added.alias("numbers")))
    return merge.union_all(rows)


def _published(t: Tables, root: str, section: str, datasets: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: df for d in datasets for name, df in versions.read_tables(t.spark, root, section, d).items()}


@query("job_warehouse", _whole_sql(_WHOLE_WAREHOUSE, ("warehouse_diet_dims", "warehouse_exercise_dims")))
def _(t):
    # Source files to the lake, from there to the warehouse in one publication, and every published table read back.
    root, folder = f"{t.scratch}/lake", _written(t)
    runs.dump_external(t.spark, folder, root)
    runs.dump_exports(t.spark, {"workout_session": f"{folder}/workout_export.csv"}, root)
    runs.load_warehouse(t.spark, root, LOAD_TS, together=True)
    return _whole(_published(t, root, runs.WAREHOUSE, runs.WAREHOUSE_DATASETS), _WHOLE_WAREHOUSE)


@query("job_serving", _whole_sql(_WHOLE_SERVING, ("serving_diet_dims", "serving_exercise_dims")))
def _(t):
    # Into a store that holds some rows already, with ids of its own; loaded twice, the second time bucket by bucket.
    root = f"{t.scratch}/lake"
    versions.write_tables({"food_category": _known_categories(t)}, root, runs.SERVING, "food_item", "1")
    versions.write_tables({"patient": _known_patients(t), "metrics": _known_metrics(t)}, root, runs.SERVING, "diet", "1")
    runs.dump_external(t.spark, _written(t), root)
    for label in ("2", "3"):
        runs.load_serving(t.spark, root, LOAD_TS, label, together=True)
    return _whole(_published(t, root, runs.SERVING, runs.SERVING_DATASETS), _WHOLE_SERVING)


@query("job_land_export", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders")
def _(t):
    export = t.orders.select(_text("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    path, root = f"{t.scratch}/food.csv", f"{t.scratch}/lake"
    export.write.option("header", True).csv(path)
    runs.dump_exports(t.spark, {"food_item": path}, root)
    return versions.read_version(t.spark, root, runs.API, "food_item").select("id", "status")


# ── Models ───────────────────────────────────────────────────────────────────


@query(
    "scaled_linear_model",
    """SELECT l_orderkey, l_linenumber, round(f.b + f.a * l_quantity, 3) AS prediction FROM lineitem,
       (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) f""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = models.fit(models.scaled_linear(["l_quantity"], "l_extendedprice"), rows)
    return models.score(rows, model).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query("boosted_regression_model")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    trees = models.boosted_regression(
        ["l_quantity", "l_discount"], ["l_returnflag"], "l_extendedprice", trees=3, depth=3
    )
    return models.score(rows, models.fit(trees, rows)).select("l_orderkey", "l_linenumber", "prediction")


@query(
    "linear_model_with_holes",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN round(f.b + f.a * l_quantity, 3) END AS prediction
       FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
       FROM lineitem WHERE l_linenumber <> 3) f""",
)
def _(t):
    quantity = F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", quantity, "l_extendedprice")
    model = models.fit(models.scaled_linear(["l_quantity"], "l_extendedprice"), rows)
    return models.score(rows, model).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(
    "boosted_stump_model",
    """SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER (PARTITION BY l_quantity > 25), 3) AS prediction FROM lineitem""",
)
def _(t):
    # One tree of depth 1 on a number of two values predicts the mean of each.
    large = (F.col("l_quantity") > 25).cast("double").alias("large")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", large, "l_extendedprice")
    stump = models.fit(models.boosted_regression(["large"], [], "l_extendedprice", trees=1, depth=1), rows)
    return models.score(rows, stump).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(
    "boosted_decided_class",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS prediction FROM orders""",
)
def _(t):
    # The target follows from one text column; the model is saved, read again as the latest, and scores.
    soon = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "soon").otherwise("later").alias("when")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", soon)
    model = models.boosted_classes(rows, ["o_totalprice"], ["o_orderpriority"], "when", trees=2, depth=4)
    root = t.scratch
    models.save_model(t.spark, model, ["o_totalprice", "o_orderpriority"], root, "when")
    loaded, _features = models.load_model(t.spark, root, "when")
    return models.score(rows.drop("when"), loaded).select("o_orderkey", "prediction")


@query("boosted_classes_model")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    model = models.boosted_classes(rows, ["o_totalprice"], ["o_orderpriority"], "o_orderstatus", trees=2, depth=2)
    versions_root = t.scratch
    models.save_model(t.spark, model, ["o_totalprice", "o_orderpriority"], versions_root, "status")
    loaded, _features = models.load_model(t.spark, versions_root, "status")
    return models.score(rows, loaded).select("o_orderkey", "prediction")


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].build(Tables(spark, folder))


def priority_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the id and name of their priority, next to the size of that dimension."""
    t = Tables(spark, folder)
    dim = dims.build_dim(t.orders, "o_orderpriority", load_ts=LOAD_TS)
    return lookups.lookup(t.orders, dim, "o_orderpriority", "priority_id").select(
        "o_orderkey", "priority_id", F.col("o_orderpriority").alias("priority_name"), "o_totalprice"
    )
