"""Every registered query of the engine, with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import linalg as L
from tessera.operators import ordering as O
from tessera.operators import predicates as P
from tessera.operators import ranges as R
from tessera.operators import text as X
from tessera.operators import windows as W
from tessera.sources import files, shared, sinks
from tessera.streaming import changelog as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one directory, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a function of the tables under a name."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


c = F.col
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LINE_SQL = ", ".join(LINE)


def money_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


# --- filters ----------------------------------------------------------------------------

_SHORT = ["l_orderkey", "l_partkey", "l_quantity"]
for _name, _op, _column, _value in [
    ("filter_eq", "=", "l_quantity", 25.0), ("filter_ne", "!=", "l_quantity", 25.0), ("filter_lt", "<", "l_quantity", 5.0),
    ("filter_le", "<=", "l_quantity", 5.0), ("filter_gt", ">", "l_quantity", 45.0), ("filter_ge", ">=", "l_quantity", 45.0),
    ("filter_typed_long", ">", "l_orderkey", 7000), ("filter_typed_int", "=", "l_linenumber", 3), ("filter_typed_double", "<", "l_extendedprice", 9999.5),
]:
    query(_name, f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE {_column} {_op} {_value}")(
        lambda t, o=_op, k=_column, v=_value: t.lineitem.where(P.compare(c(k), o, v, isinstance(v, float))).select(*_SHORT)
    )
query("filter_typed_float", "SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0.1::FLOAT")(
    lambda t: t.embeddings.where(P.compare(c("embedding")[0], ">", F.lit(0.1).cast("float"), True)).select("vec_id", "label")
)
query("filter_typed_u32", "SELECT event_id FROM events WHERE CAST(user_id AS UINTEGER) >= 50")(lambda t: t.events.where(P.compare(c("user_id").cast("long"), ">=", 50)).select("event_id"))
query("filter_typed_u64", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS UBIGINT) < 500")(lambda t: t.orders.where(P.compare_unsigned(c("o_orderkey"), "<", 500)).select("o_orderkey"))
# every second key has the highest bit of an unsigned number set
_HIGH = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 9223372036854775807 - 1 ELSE o_orderkey END"
_HIGH_U = "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS UBIGINT) + 9223372036854775808::UBIGINT ELSE CAST(o_orderkey AS UBIGINT) END"
query("filter_unsigned_high", f"SELECT o_orderkey FROM orders WHERE {_HIGH_U} >= 9223372036854775900::UBIGINT OR {_HIGH_U} < 300::UBIGINT")(
    lambda t: t.orders.select("o_orderkey", F.expr(_HIGH).alias("k")).where(P.any_of(P.compare_unsigned(c("k"), ">=", 9223372036854775900), P.compare_unsigned(c("k"), "<", 300))).select("o_orderkey")
)
query("filter_str_eq", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")(lambda t: t.orders.where(P.compare(c("o_orderpriority"), "=", "1-URGENT")).select("o_orderkey"))
query("filter_str_range", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'N'")(
    lambda t: t.customer.where(P.all_of(c("c_mktsegment") >= "F", c("c_mktsegment") < "N")).select("c_custkey", "c_name")
)
query("filter_and", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03 AND l_returnflag = 'A'")(
    lambda t: t.lineitem.where(P.all_of(c("l_quantity") > 40, c("l_discount") < 0.03, c("l_returnflag") == "A")).select("l_orderkey", "l_partkey")
)
query("filter_or", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 49 OR l_discount < 0.01 OR l_returnflag = 'X'")(
    lambda t: t.lineitem.where(P.any_of(c("l_quantity") > 49, c("l_discount") < 0.01, c("l_returnflag") == "X")).select("l_orderkey", "l_partkey")
)
query("filter_literal_left", "SELECT l_orderkey FROM lineitem WHERE 45 < l_quantity")(lambda t: t.lineitem.where(F.lit(45) < c("l_quantity")).select("l_orderkey"))
query("filter_negative_literal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100.5")(lambda t: t.customer.where(c("c_acctbal") < -100.5).select("c_custkey", "c_acctbal"))
query("filter_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")(lambda t: t.lineitem.where(c("l_quantity") > 25).agg(F.count("*").alias("n")))
query("filter_between", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")(lambda t: t.lineitem.where(c("l_quantity").between(10, 12)).select("l_orderkey", "l_quantity"))
query("filter_nested_bool", "SELECT l_orderkey FROM lineitem WHERE (l_quantity < 3 OR l_quantity > 48) AND NOT (l_quantity = 50) AND (l_quantity <> 1 OR l_quantity = 2)")(
    lambda t: t.lineitem.where(P.all_of(P.any_of(c("l_quantity") < 3, c("l_quantity") > 48), ~(c("l_quantity") == 50), P.any_of(c("l_quantity") != 1, c("l_quantity") == 2))).select("l_orderkey")
)
query("filter_indices", "SELECT CAST(i AS BIGINT) AS i FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events) WHERE value > 20")(
    lambda t: R.row_index(t.events.select("event_id", "value"), "event_id", [], "i").where("value > 20").select("i")
)
query("filter_with_indices", "SELECT CAST(i AS BIGINT) AS i, value FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events) WHERE value <= 5")(
    lambda t: R.row_index(t.events.select("event_id", "value"), "event_id", [], "i").where("value <= 5").select("i", "value")
)
query("filter_mask", "SELECT event_id, coalesce(value > 10, false) AS m FROM events")(lambda t: t.events.select("event_id", P.mask(c("value") > 10).alias("m")))
query("mask_gather", "SELECT event_id, value FROM events WHERE value > 10")(lambda t: P.gather_by_mask(t.events.select("event_id", "value", P.mask(c("value") > 10).alias("m")), "m"))
query("multi_mask_and", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30 AND l_tax < 0.02 AND l_discount > 0.05 AND l_linenumber < 4")(
    lambda t: t.lineitem.where(P.mask(P.all_of(c("l_quantity") > 30, c("l_tax") < 0.02, c("l_discount") > 0.05, c("l_linenumber") < 4))).select("l_orderkey", "l_partkey")
)
query("multi_mask_or", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 49 OR l_tax < 0.01 OR l_discount > 0.09")(
    lambda t: t.lineitem.where(P.mask(P.any_of(c("l_quantity") > 49, c("l_tax") < 0.01, c("l_discount") > 0.09))).select("l_orderkey", "l_partkey")
)


def _hole():
    """event values with a null in every third row"""
    return F.when(c("event_id") % 3 != 0, c("value"))


query("filter_nullable", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) WHERE v > 8")(lambda t: t.events.select("event_id", _hole().alias("v")).where("v > 8").select("event_id"))
query("mask_nullable", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END > 8, false) AS m FROM events")(lambda t: t.events.select("event_id", P.mask(_hole() > 8).alias("m")))


def _nan():
    """event values with NaN in every fifth row"""
    return F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(c("value"))


query("filter_nan", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events) WHERE v > 8 AND NOT isnan(v)")(
    lambda t: t.events.select("event_id", _nan().alias("v")).where(P.compare(c("v"), ">", 8.0, True)).select("event_id")
)
query("compact_positions", "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events WHERE value > 15")(
    lambda t: R.row_index(t.events.where("value > 15").select("event_id"), "event_id", [], "pos")
)
query("gather", "WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events), x AS (SELECT o_orderkey AS q, (o_orderkey * 7) % 1000 AS i FROM orders) SELECT q, value FROM x JOIN s USING (i)")(
    lambda t: P.gather(R.row_index(t.events.select("event_id", "value"), "event_id", [], "i"), t.orders.select(c("o_orderkey").alias("q"), (c("o_orderkey") * 7 % 1000).alias("at")), "i", "at").select("q", "value")
)
query("project", "SELECT p_partkey, p_name, p_retailprice FROM part")(lambda t: t.part.select("p_partkey", "p_name", "p_retailprice"))
query("select_star", "SELECT * FROM nation")(lambda t: t.nation.select("*"))
query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t: t.orders.select("o_orderkey", "o_totalprice"))


# --- sources and sinks --------------------------------------------------------------------


def _rewritten(t: Tables, kind: str) -> DataFrame:
    """A table written as text in one format and read again with inferred types."""
    import uuid

    from tessera.sources.detect import read_any

    path = f"{shared.folder(t.spark)}/tessera-{uuid.uuid4().hex}-{kind}"
    df = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").json(path)
    return read_any(t.spark, path)


for _kind in ("csv", "json"):
    query(f"scan_{_kind}", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(lambda t, k=_kind: _rewritten(t, k).select(c("s_suppkey").cast("long"), "s_name", c("s_nationkey").cast("int"), "s_acctbal"))


@query("infer_schema", "SELECT 'csv' AS format, * FROM (VALUES ('s_acctbal', 'double'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_suppkey', 'int')) AS x(column_name, column_type) UNION ALL SELECT 'json', * FROM (VALUES ('s_acctbal', 'double'), ('s_name', 'string'), ('s_nationkey', 'bigint'), ('s_suppkey', 'bigint')) AS y")
def _infer_schema(t):
    # the types that the readers find in the text, without any cast
    rows = [(kind, *pair) for kind in ("csv", "json") for pair in _rewritten(t, kind).dtypes]
    return t.spark.createDataFrame(rows, "format string, column_name string, column_type string")


@query("list_tables", "SELECT unnest(['benchmark','conversations','customer','documents','embeddings','events','labels','lineitem','nation','orders','pages','part','region','supplier']) AS table_name")
def _list_tables(t):
    from tessera.sources.detect import _status

    fs, p = _status(t.spark, t.folder)
    names = sorted(s.getPath().getName().rsplit(".", 1)[0] for s in fs.listStatus(p))
    return t.spark.createDataFrame([(n,) for n in names], "table_name string")


query("dict_encode", "SELECT DISTINCT o_orderpriority AS word, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders")(
    lambda t: R.row_index(t.orders.select(c("o_orderpriority").alias("word")).distinct(), "word", [], "code")
)
query("csv_structure_counts", "SELECT count(*) AS n_lines, CAST(sum(length(l) - length(replace(l, ',', ''))) AS BIGINT) AS n_delimiters, CAST(sum(length(l)) AS BIGINT) AS n_chars FROM (SELECT text AS l FROM documents)")(
    lambda t: files.csv_structure(t.documents.select(c("text").alias("value")))
)
query("to_jsonl", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")(lambda t: sinks.to_jsonl(t.nation))
query("to_json_array", "SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY 1")(
    lambda t: sinks.to_json_array(t.nation, "n_regionkey", "n_nationkey")
)

# --- aggregates ---------------------------------------------------------------------------

query("headline", f"SELECT l_returnflag, count(*) AS n, {money_sql('l_quantity')} AS sum_qty, {money_sql('l_extendedprice')} AS sum_price FROM lineitem WHERE l_discount < 0.05 GROUP BY 1")(
    lambda t: t.lineitem.where("l_discount < 0.05").groupBy("l_returnflag").agg(F.count("*").alias("n"), A.money("l_quantity").alias("sum_qty"), A.money("l_extendedprice").alias("sum_price"))
)
query("agg_count_star", "SELECT count(*) AS n FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n")))
query("agg_count_col", "SELECT count(CASE WHEN event_id % 3 <> 0 THEN value END) AS n FROM events")(lambda t: t.events.agg(F.count(_hole()).alias("n")))
query("agg_sum", f"SELECT CAST(sum(l_orderkey) AS BIGINT) AS sum_key, {money_sql('l_extendedprice')} AS sum_price FROM lineitem")(lambda t: t.lineitem.agg(F.sum("l_orderkey").alias("sum_key"), A.money("l_extendedprice").alias("sum_price")))
query("agg_avg", "SELECT round(avg(l_quantity), 6) AS avg_qty, round(avg(l_linenumber), 6) AS avg_line FROM lineitem")(lambda t: t.lineitem.agg(F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_linenumber"), 6).alias("avg_line")))
query("agg_min_max", "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, min(l_extendedprice) AS lo_price, max(l_extendedprice) AS hi_price, min(l_returnflag) AS lo_flag, max(l_shipdate) AS hi_date FROM lineitem")(
    lambda t: t.lineitem.agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.min("l_extendedprice").alias("lo_price"), F.max("l_extendedprice").alias("hi_price"), F.min("l_returnflag").alias("lo_flag"), F.max("l_shipdate").alias("hi_date"))
)
query("group_by", f"SELECT o_orderpriority, count(*) AS n, {money_sql('o_totalprice')} AS total FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), A.money("o_totalprice").alias("total")))
query("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
)
query("groupby_stats", f"SELECT l_suppkey, {money_sql('l_extendedprice')} AS sum_v, count(l_extendedprice) AS n, min(l_extendedprice) AS min_v, max(l_extendedprice) AS max_v FROM lineitem GROUP BY 1")(lambda t: A.group_stats(t.lineitem, "l_suppkey", "l_extendedprice"))
query("group_boundaries", "SELECT event_id, CAST(coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS INTEGER) AS is_start FROM events")(
    lambda t: A.group_boundaries(t.events.select("event_id", "user_id", "event_type"), "event_type", ["event_id"], ["user_id"]).select("event_id", "is_start")
)
query("reduce_sum_min_max", "SELECT CAST(sum(event_id) AS BIGINT) AS s, min(event_id) AS lo, max(event_id) AS hi FROM events")(lambda t: t.events.agg(F.sum("event_id").alias("s"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")))
query("histogram_mod", "SELECT event_id % 100 AS bin, count(*) AS n FROM events GROUP BY 1")(lambda t: A.histogram_mod(t.events, "event_id", 100))
query("histogram_mask", "SELECT event_id & 255 AS bin, count(*) AS n FROM events GROUP BY 1")(lambda t: A.histogram_mod(t.events, "event_id", 256))
_GRID = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("column_sums", "SELECT " + ", ".join(f"{money_sql(x)} AS {x}" for x in _GRID) + " FROM lineitem")(lambda t: t.lineitem.agg(*[A.money(x).alias(x) for x in _GRID]))
query("column_avgs", "SELECT " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in _GRID) + " FROM lineitem")(lambda t: t.lineitem.agg(*[F.round(F.avg(x), 6).alias(x) for x in _GRID]))
query("count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")(lambda t: t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")))
query("describe_table", " UNION ALL ".join(f"SELECT '{x}' AS column_name, '{k}' AS column_type, count(*) AS n_rows, count(*) - count({x}) AS null_count, count(DISTINCT {x}) AS distinct_count, CAST(min({x}) AS VARCHAR) AS min_value, CAST(max({x}) AS VARCHAR) AS max_value FROM part" for x, k in [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]))(
    lambda t: A.describe_table(t.part)
)
query("conditional_agg", "SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE quality = 1) AS n_good FROM documents JOIN labels USING (doc_id) GROUP BY 1")(
    lambda t: t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("toxic = 1")).alias("n_toxic"), F.count_if(F.expr("quality = 1")).alias("n_good"))
)
query("having_dups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda t: t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"))
query("group_concat", "SELECT n_regionkey, string_agg('- ' || n_name || coalesce(' (' || n_nationkey || ')', ''), chr(10) ORDER BY n_name) AS listing FROM nation GROUP BY 1")(
    lambda t: t.nation.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda s: F.concat(F.lit("- "), s["n_name"], F.coalesce(F.concat(F.lit(" ("), s["n_nationkey"].cast("string"), F.lit(")")), F.lit("")))).alias("a")).select("n_regionkey", F.array_join("a", "\n").alias("listing"))
)
_cell = "greatest(0, least(63, CAST(floor(({x} - {lo}) / ({hi} - {lo}) * 64) AS BIGINT)))"
query("density_grid", f"SELECT {_cell.format(x='l_quantity', lo='0.0', hi='50.0')} AS cell_l_quantity, {_cell.format(x='l_extendedprice', lo='1000.0', hi='90000.0')} AS cell_l_extendedprice, {_cell.format(x='l_linenumber', lo='1.0', hi='8.0')} AS cell_l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")(
    lambda t: A.density_grid(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"], {"l_quantity": (0.0, 50.0), "l_extendedprice": (1000.0, 90000.0), "l_linenumber": (1.0, 8.0)})
)
query("iqr_stats", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), k AS (SELECT event_type, value FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_v, quantile_cont(value, 0.5) AS median_v, round(stddev_samp(value), 6) AS stddev_v, round(stddev_samp(value) / avg(value) * 100, 6) AS cv_percent, round(quantile_cont(value, 0.95), 6) AS p95 FROM k GROUP BY 1")(
    lambda t: A.iqr_stats(t.events.select("event_type", "value"), "event_type", "value")
)
query("rollup", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {money_sql('l_quantity')} AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), A.money("l_quantity").alias("qty")))
query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct())

# --- joins ----------------------------------------------------------------------------------

query("hash_join", "SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(
    lambda t: t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey").hint("shuffle_hash"), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey")
)
query("hash_join_dedup", "WITH b AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT c_custkey, event_id, value FROM customer JOIN b ON c_custkey = user_id")(
    lambda t: J.join_deduplicated(t.customer.select("c_custkey", c("c_custkey").alias("user_id")), t.events.select("user_id", "event_id", "value"), "user_id", "event_id").select("c_custkey", "event_id", "value")
)
query("hash_join_count", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(lambda t: t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey"), c("l_orderkey") == c("o_orderkey")).agg(F.count("*").alias("n")))
query("vlookup_asof", f"WITH k AS (SELECT o_totalprice AS k, min(o_orderkey) AS v FROM orders GROUP BY 1) SELECT {LINE_SQL}, CAST(coalesce(v, -1.0) AS DOUBLE) AS found FROM lineitem ASOF LEFT JOIN k ON l_extendedprice >= k")(
    lambda t: R.asof_lookup(t.lineitem.select(*LINE, "l_extendedprice"), "l_extendedprice", t.orders.groupBy("o_totalprice").agg(F.min("o_orderkey").cast("double").alias("v")), "o_totalprice", "v").select(*LINE, "found")
)
query("kv_upsert", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")(lambda t: J.latest_by_key(t.events.select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "value"))
query("kv_lookup", "WITH s AS (SELECT user_id, arg_max(event_id, event_id) AS v FROM events GROUP BY 1) SELECT c_custkey, coalesce(v, 4294967295) AS v FROM customer LEFT JOIN s ON c_custkey * 3 = user_id")(
    lambda t: J.kv_lookup(t.customer.select("c_custkey", (c("c_custkey") * 3).alias("user_id")), t.events.groupBy("user_id").agg(F.max("event_id").alias("v")), "user_id", "v").select("c_custkey", "v")
)
query("inner_join_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda t: t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"))
query("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")(
    lambda t: t.customer.select("c_custkey").join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
)
query("self_join_near_dup", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")(
    lambda t: t.supplier.select(c("s_suppkey").alias("a"), "s_nationkey", c("s_acctbal").alias("x")).join(t.supplier.select(c("s_suppkey").alias("b"), "s_nationkey", c("s_acctbal").alias("y")), "s_nationkey").where("a < b and abs(x - y) < 500").select("a", "b")
)
query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")(
    lambda t: t.customer.select("c_custkey").join(t.orders.where("o_orderpriority = '1-URGENT'"), c("c_custkey") == c("o_custkey"), "left_anti")
)
query("semi_join_tuple", f"SELECT {LINE_SQL} FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2)")(
    lambda t: t.lineitem.select(*LINE).join(t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 2"), ["l_orderkey", "l_linenumber"], "left_semi").select(*LINE)
)

# --- windows ----------------------------------------------------------------------------------

query("moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")(
    lambda t: W.moving_average(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("moving_avg", 6).alias("moving_avg"))
)
_ROWS20 = f"OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, {LINE_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
query("vwap", f"SELECT {LINE_SQL}, CAST(CASE WHEN sum(l_quantity) {_ROWS20} > 0 THEN sum(l_extendedprice * l_quantity) {_ROWS20} / sum(l_quantity) {_ROWS20} ELSE 0 END AS FLOAT) AS vwap FROM lineitem")(
    lambda t: W.vwap(t.lineitem.select(*LINE, "l_extendedprice", "l_quantity"), "l_suppkey", ["l_shipdate", *LINE], "l_extendedprice", "l_quantity").select(*LINE, c("vwap").cast("float").alias("vwap"))
)
query("prefix_sum", "SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM orders")(
    lambda t: R.prefix_sum(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", [], "o_custkey").select("o_orderkey", "prefix")
)
query("row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS row FROM orders")(lambda t: R.row_index(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "row"))

# --- order --------------------------------------------------------------------------------------

query("order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")(lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey"))
query("order_by_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")(
    lambda t: t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
)
query("limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 17)")(lambda t: t.lineitem.limit(17).agg(F.count("*").alias("n")))
query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))
for _kind, _table, _key in [("long", "orders", "o_custkey"), ("int", "part", "p_size"), ("double", "part", "p_retailprice"), ("string", "part", "p_name"), ("timestamp", "events", "ts")]:
    query(f"sort_{_kind}", f"SELECT {_key} FROM {_table} ORDER BY 1")(lambda t, x=_table, k=_key: getattr(t, x).select(k).orderBy(k))
query("sort_float", "SELECT vec_id, embedding[1] AS x FROM embeddings ORDER BY 2, 1")(lambda t: t.embeddings.select("vec_id", c("embedding")[0].alias("x")).orderBy("x", "vec_id"))
query("sort_u64", "SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders ORDER BY CAST(o_orderkey AS UBIGINT)")(lambda t: t.orders.select(c("o_orderkey").alias("k")).orderBy(*O.unsigned_order(c("k"))))
query("rank_u64", f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {_HIGH_U}) - 1 AS BIGINT) AS rank FROM orders")(
    lambda t: R.row_index(t.orders.select("o_orderkey", F.expr(_HIGH).alias("k")).withColumn("high", c("k") < 0), "high", ["k"], "rank").select("o_orderkey", "rank")
)
query("argsort", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey FROM orders")(lambda t: O.argsort(t.orders.select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey"))
query("sort_pairs", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2")(lambda t: t.orders.select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey"))


@query("sort_float_special", "SELECT id, CAST(row_number() OVER (ORDER BY x, signbit(x) DESC) - 1 AS BIGINT) AS rank FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 'NaN'::DOUBLE), (2, '-0.0'::DOUBLE), (3, 0.0::DOUBLE), (4, '-Infinity'::DOUBLE), (5, -1.0::DOUBLE), (6, 'Infinity'::DOUBLE)) AS v(id, x)")
def _sort_float_special(t):
    values = t.spark.range(7).select("id", F.expr("element_at(array(1.0D, double('NaN'), -0.0D, 0.0D, double('-Infinity'), -1.0D, double('Infinity')), int(id) + 1)").alias("x"))
    return R.row_index(values.withColumn("zero", O.zero_sign(c("x"))), "x", ["zero"], "rank").select("id", "rank")


query("pipeline_filter_sort_gather", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 ORDER BY l_extendedprice, l_orderkey, l_partkey")(
    lambda t: t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_partkey")
)
query("topk_groups", f"SELECT l_suppkey, {money_sql('l_extendedprice')} AS total FROM lineitem WHERE l_suppkey > 20 GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10")(
    lambda t: O.top_groups(t.lineitem.where("l_suppkey > 20"), "l_suppkey", A.money("l_extendedprice"), 10)
)
query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")(lambda t: t.nation.select(c("n_name").alias("name")).unionAll(t.region.select("r_name")))
query("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")(lambda t: t.customer.select(c("c_custkey").alias("k")).intersect(t.orders.select("o_custkey")))
query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")(lambda t: t.customer.select(c("c_custkey").alias("k")).exceptAll(t.orders.where("o_totalprice > 200000").select("o_custkey").distinct()))

# --- scalar functions -----------------------------------------------------------------------------

query("path_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://www.')")(lambda t: t.pages.where(c("url").startswith("https://www.")).select("page_id"))
query("path_parts", "SELECT page_id, list_last(string_split(url, '/')) AS name, regexp_extract(list_last(string_split(url, '/')), '\\.([^.]*)$', 1) AS ext, CAST(len(string_split(url, '/')) - 1 AS BIGINT) AS depth FROM pages")(
    lambda t: t.pages.select("page_id", S.file_name(c("url")).alias("name"), S.extension(c("url")).alias("ext"), S.depth(c("url")).alias("depth"))
)
query("substring", "SELECT doc_id, substring(text, 1, 80) AS head FROM documents")(lambda t: t.documents.select("doc_id", F.substring("text", 1, 80).alias("head")))
query("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing%'")(lambda t: t.part.where(c("p_name").like("%ing%")).select("p_partkey", "p_name"))
query("stale_rows", "SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 3600) AS BIGINT) AS age_hours FROM events WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR")(
    lambda t: t.events.where("ts < timestamp_ntz'2024-02-01' - interval 24 hours").select("event_id", F.expr("timestampdiff(HOUR, ts, timestamp_ntz'2024-02-01')").cast("long").alias("age_hours"))
)
_M = "4294967295::UBIGINT"


def _mix_sql(x: str, shift: int, k: int) -> str:
    return f"CAST((CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {k}) % 4294967296 AS UBIGINT)"


query("murmur_finalize", f"WITH a AS (SELECT event_id, {_mix_sql('CAST(event_id AS UBIGINT)', 16, 0x85EBCA6B)} AS h FROM events), b AS (SELECT event_id, {_mix_sql('h', 13, 0xC2B2AE35)} AS h FROM a) SELECT event_id, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM b")(
    lambda t: t.events.select("event_id", S.murmur_finalize(c("event_id")).alias("h"))
)
query("knuth_hash", "SELECT event_id, CAST((CAST(event_id AS UHUGEINT) * 2654435761 % 4294967296) // 4194304 AS BIGINT) AS h FROM events")(lambda t: t.events.select("event_id", S.knuth_hash(c("event_id"), 10).alias("h")))
query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("fuzzy_match", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 's.*r.*g')")(lambda t: t.part.where(S.fuzzy_match(c("p_name"), "SRG")).select("p_partkey"))
query("throughput", "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 6.5e9 * 1000, 9) AS scan_ms FROM documents GROUP BY 1")(
    lambda t: t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).select("source", "bytes", F.round(S.scan_ms(c("bytes")), 9).alias("scan_ms"))
)

# --- linear algebra --------------------------------------------------------------------------------

_VECTOR = [((i * 7 + 3) % 11 - 5) / 4 for i in range(64)]


def _dims(t: Tables) -> int:
    return len(t.embeddings.select("embedding").first()[0])


query("gemv", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * ((((i - 1) * 7 + 3) % 11 - 5) / 4.0))), 6) AS y FROM embeddings")(
    lambda t: L.gemv(t.embeddings, "vec_id", "embedding", [((i * 7 + 3) % 11 - 5) / 4 for i in range(_dims(t))]).select("vec_id", F.round("y", 6).alias("y"))
)


@query("gemm", "WITH a AS (SELECT label AS i, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT i, k, round(sum(v), 9) AS v FROM a GROUP BY 1, 2) SELECT x.i, y.i AS j, round(sum(x.v * y.v), 4) AS v FROM s x JOIN s y USING (k) GROUP BY 1, 2")
def _gemm(t):
    # label sums times their transpose
    a = L.coordinates(t.embeddings, "label", "embedding", "i", "k").groupBy("i", "k").agg(F.round(F.sum("v"), 9).alias("v"))
    return L.gemm(a, a.withColumnRenamed("i", "j")).select("i", "j", F.round("v", 4).alias("v"))


_ATTENTION = "WITH k AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY 1), ks AS (SELECT vec_id AS k_id, embedding::DOUBLE[] AS k FROM embeddings WHERE vec_id IN (SELECT id FROM k)), s AS (SELECT q.vec_id AS q_id, k, exp(list_dot_product(q.embedding::DOUBLE[], k) / sqrt(len(k))) AS w FROM embeddings q CROSS JOIN ks), l AS (SELECT q_id, generate_subscripts(k, 1) - 1 AS d, unnest(k) AS x, w FROM s) SELECT q_id, CAST(d AS INTEGER) AS d, CASE WHEN round(sum(w * x) / sum(w), 6) = 0 THEN 0.0::DOUBLE ELSE round(sum(w * x) / sum(w), 6) END AS y FROM l GROUP BY 1, 2"


@query("attention", _ATTENTION)
@query("attention_all", _ATTENTION)
def _attention_all(t):
    keys = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("k")).select(c("k").cast("array<double>").alias("k"))
    return L.attention(t.embeddings.select(c("vec_id").alias("q_id"), c("embedding").cast("array<double>").alias("q")), keys.withColumn("v", c("k")), _dims(t)).select("q_id", "d", F.round("y", 6).alias("r")).select("q_id", "d", F.when(c("r") == 0, 0.0).otherwise(c("r")).alias("y"))  # no negative zero


# --- text and path search ------------------------------------------------------------------------------

_OCCUR = "CAST(list_sum(list_transform(range(1, length(t) + 1), lambda i: CAST(substr(t, i, {n}) = '{p}' AS BIGINT))) AS BIGINT)"
query("search_count", f"SELECT doc_id, coalesce({_OCCUR.format(n=3, p='the')}, 0) AS n FROM (SELECT doc_id, text AS t FROM documents)")(lambda t: t.documents.select("doc_id", X.count_matches(c("text"), "the").alias("n")))
query("search_count_ci", f"SELECT doc_id, coalesce({_OCCUR.format(n=3, p='the')}, 0) AS n FROM (SELECT doc_id, lower(text) AS t FROM documents)")(lambda t: t.documents.select("doc_id", X.count_matches(c("text"), "tHe", ignore_case=True).alias("n")))
query("search_count_plain", "SELECT doc_id, CAST((length(text) - length(replace(text, 'anan', ''))) // 4 AS BIGINT) AS n FROM documents")(lambda t: t.documents.select("doc_id", X.count_matches(c("text"), "anan", overlapping=False).alias("n")))
query("byte_pattern_scan", f"SELECT doc_id, coalesce({_OCCUR.format(n=4, p='tion')}, 0) AS n FROM (SELECT doc_id, text AS t FROM documents)")(lambda t: t.documents.select("doc_id", X.count_matches(c("text"), "tion").alias("n")))
query("search_positions", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM l), h AS (SELECT doc_id, n AS line, ls[n] AS s, coalesce(list_sum(list_transform(ls[1:n-1], lambda x: length(x) + 1)), 0) AS before FROM e), p AS (SELECT doc_id, line, s, before, unnest(range(0, length(s))) AS col FROM h) SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS \"column\", CAST(before + col AS BIGINT) AS \"offset\" FROM p WHERE substr(s, col + 1, 5) = 'ingly'")(
    lambda t: X.positions(t.documents, "doc_id", "text", "ingly")
)
query("grep_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS s FROM l) SELECT doc_id, CAST(n AS BIGINT) AS line_number, rtrim(s, chr(13)) AS line_content FROM e WHERE contains(s, 'icensed')")(
    lambda t: X.grep(t.documents, "doc_id", "text", "icensed")
)
query("grep_context", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS s FROM l) SELECT doc_id, CAST(n AS BIGINT) AS line_number, s AS line_content, array_to_string(ls[greatest(n - 2, 1):n - 1], '|') AS before, array_to_string(ls[n + 1:n + 2], '|') AS after FROM e WHERE contains(s, 'icensed')")(
    lambda t: X.grep(t.documents, "doc_id", "text", "icensed", 2).select("doc_id", "line_number", "line_content", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))
)
query("filename_search", "WITH n AS (SELECT page_id, url, lower(list_last(string_split(url, '/'))) AS name FROM pages) SELECT page_id, round(100.0 / strlen(url) + CASE WHEN name = '4' THEN 10 ELSE 0 END + CASE WHEN starts_with(name, '4') THEN 5 ELSE 0 END, 6) AS score FROM n WHERE contains(name, '4')")(
    lambda t: X.search_names(t.pages, "url", "4").select("page_id", F.round("score", 6).alias("score"))
)
query("path_search", "SELECT page_id, contains(lower(list_last(string_split(url, '/'))), 'page') AS in_name FROM pages WHERE contains(lower(url), 'page')")(lambda t: X.search_paths(t.pages, "url", "page").select("page_id", "in_name"))
query("files_by_ext", "SELECT page_id FROM pages WHERE regexp_extract(list_last(string_split(url, '/')), '\\.([^.]*)$', 1) IN ('html', 'php')")(lambda t: t.pages.where(S.extension(c("url")).isin("html", "php")).select("page_id"))
query("total_size", "SELECT regexp_extract(list_last(string_split(url, '/')), '\\.([^.]*)$', 1) AS ext, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")(
    lambda t: t.pages.groupBy(S.extension(c("url")).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))
)
# 'http' is no prefix of 'http://...', which has no component of that name; one whole path is kept
query("exclude_paths", "SELECT page_id FROM pages WHERE url = 'https://thther.example.org/en/685' OR NOT (url = 'https:' OR starts_with(url, 'https:/') OR url = 'http' OR starts_with(url, 'http/') OR list_has_any(string_split(url, '/'), ['es', 'fr']))")(
    lambda t: X.exclude_paths(t.pages, "url", ["https:", "http"], ["es", "fr"], ["https://thther.example.org/en/685"]).select("page_id")
)
query("rank_paths", "SELECT page_id, url FROM pages ORDER BY length(url), url, page_id")(lambda t: t.pages.select("page_id", "url").orderBy(F.length("url"), "url", "page_id"))
_WORD = "regexp_matches(substr(s, {at}, 1), '^[A-Za-z0-9_]')"
query("rank_matches", f"WITH l AS (SELECT page_id, len(string_split(url, '/')) - 1 AS depth, string_split(html, chr(10)) AS ls FROM pages), e AS (SELECT page_id, depth, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS s FROM l), p AS (SELECT page_id, depth, line, s, unnest(range(0, length(s))) AS col FROM e), m AS (SELECT page_id, depth, line, col, NOT (col > 0 AND {_WORD.format(at='col')}) AND NOT {_WORD.format(at='col + 4')} AS w FROM p WHERE substr(s, col + 1, 3) = 'the') SELECT page_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS \"column\", w AS word_match, round(greatest(0.01, CASE WHEN w THEN 1.0 ELSE 0.5 END - 0.02 * depth), 6)::DOUBLE AS rank_score FROM m")(
    lambda t: X.rank_matches(t.pages, "page_id", "html", "url", "the")
)
query("matches_per_file", "SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT source, (length(text) - length(replace(text, 'tion', ''))) // 4 AS n FROM documents WHERE contains(text, 'tion')) GROUP BY 1")(
    lambda t: t.documents.where(c("text").contains("tion")).select("source", X.count_matches(c("text"), "tion", overlapping=False).alias("n")).groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))
)
query("verify_matches", "WITH f AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license')), g AS (SELECT doc_id FROM documents WHERE contains(text, 'License') OR doc_id % 50 = 0) SELECT count(*) FILTER (WHERE f.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS confirmed, count(*) FILTER (WHERE g.doc_id IS NULL) AS false_positive, count(*) FILTER (WHERE f.doc_id IS NULL) AS missed FROM f FULL JOIN g ON f.doc_id = g.doc_id")(
    lambda t: X.verify_matches(t.documents.where(F.lower("text").contains("license")).select("doc_id"), t.documents.where(c("text").contains("License") | (c("doc_id") % 50 == 0)).select("doc_id"), ["doc_id"])
)
query("profile_ratios", "SELECT round(count(*) FILTER (WHERE contains(text, 'License')) / count(*), 6) AS selectivity, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")(
    lambda t: t.documents.agg(F.round(F.count_if(c("text").contains("License")) / F.count("*"), 6).alias("selectivity"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
)
_BM = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(lower(source), '[^a-z0-9]+'), lambda t: t <> '') AS b FROM documents),
s AS (SELECT doc_id, len(a) + len(b) AS len, a, b FROM d), n AS (SELECT count(*) AS n, avg(len) AS av FROM s),
q AS (SELECT unnest(['license', 'public', 'src1']) AS term),
f AS (SELECT doc_id, len, term, 1.0 * len(list_filter(a, lambda x: x = term)) + 5.0 * len(list_filter(b, lambda x: x = term)) AS tf FROM s CROSS JOIN q),
g AS (SELECT * FROM f WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM g GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / av))), 6)::DOUBLE AS score FROM g JOIN df USING (term) CROSS JOIN n GROUP BY 1
"""
query("bm25_search", _BM)(lambda t: X.bm25(t.documents, "doc_id", {"text": 1.0, "source": 5.0}, ["license", "public", "src1"]))

# --- change logs -----------------------------------------------------------------------------------------

query("latest_generation", "SELECT event_id FROM events WHERE event_id // 1000 = (SELECT max(event_id // 1000) FROM events)")(lambda t: T.latest_generation(t.events.select("event_id", F.expr("event_id div 1000").alias("g")), "g").select("event_id"))
_STATE = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'"
query("cdc_latest_state", _STATE)(lambda t: T.latest_state(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type = 'error'").select("user_id", "event_type", "event_id"))
query("cdc_renames", "SELECT CASE WHEN event_type = 'click' THEN unnest(['deleted', 'created']) ELSE event_type END AS kind, CASE WHEN event_type = 'click' THEN unnest(['u' || user_id, 'n' || user_id]) ELSE 'u' || user_id END AS path, event_id AS seq FROM events WHERE event_type = 'click' UNION ALL SELECT event_type, 'u' || user_id, event_id FROM events WHERE event_type <> 'click'")(
    lambda t: T.split_renames(t.events.select(F.when(c("event_type") == "click", "renamed").otherwise(c("event_type")).alias("kind"), F.concat(F.lit("u"), "user_id").alias("path"), F.concat(F.lit("n"), "user_id").alias("new_path"), c("event_id").alias("seq")))
)
query("rescan_diff", "WITH s AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(s.k, f.k) AS k, CASE WHEN s.k IS NULL THEN 'insert' WHEN f.k IS NULL THEN 'delete' WHEN s.v <> f.v THEN 'update' ELSE 'keep' END AS action FROM s FULL JOIN f ON s.k = f.k")(
    lambda t: T.rescan_diff(t.customer.where("c_custkey % 3 <> 0").select(c("c_custkey").alias("k"), c("c_nationkey").alias("v")), t.customer.where("c_custkey % 4 <> 0").select(c("c_custkey").alias("k"), F.expr("if(c_custkey % 5 = 0, c_nationkey + 1, c_nationkey)").alias("v")), "k", "v")
)
query("compact_state", "SELECT event_id, event_type FROM events, (SELECT count(*) FILTER (WHERE event_type = 'error') * 5 > count(*) AS due FROM events) WHERE NOT due OR event_type <> 'error' ORDER BY 1")(lambda t: T.compact(t.events.select("event_id", "event_type"), "event_type = 'error'", "event_id"))
query("compact_state_due", "SELECT event_id FROM events, (SELECT count(*) FILTER (WHERE event_type <> 'view') * 5 > count(*) AS due FROM events) WHERE NOT due OR event_type = 'view'")(lambda t: T.compact(t.events.select("event_id", "event_type"), "event_type <> 'view'", "event_id").select("event_id"))
query("debounce", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) > 3600000000")(
    lambda t: T.debounce(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 3_600_000, ("event_id",)).select("event_id")
)
_PATHS = "SELECT '/n' || c_nationkey || '/' || c_custkey AS path, {v} AS v FROM customer WHERE c_custkey % {m} <> 0"
query("rescan_subtree", f"WITH s AS ({_PATHS.format(v='c_nationkey', m=3)}), f AS ({_PATHS.format(v='CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END', m=4)}), si AS (SELECT * FROM s WHERE starts_with(path, '/n1/')), fi AS (SELECT * FROM f WHERE starts_with(path, '/n1/')) SELECT coalesce(si.path, fi.path) AS path, CASE WHEN si.path IS NULL THEN 'insert' WHEN fi.path IS NULL THEN 'delete' WHEN si.v <> fi.v THEN 'update' ELSE 'keep' END AS action FROM si FULL JOIN fi ON si.path = fi.path UNION ALL SELECT path, 'keep' FROM s WHERE NOT starts_with(path, '/n1/')")(
    lambda t: T.rescan_subtree(
        t.customer.where("c_custkey % 3 <> 0").select(F.expr("'/n' || c_nationkey || '/' || c_custkey").alias("path"), c("c_nationkey").alias("v")),
        t.customer.where("c_custkey % 4 <> 0").select(F.expr("'/n' || c_nationkey || '/' || c_custkey").alias("path"), F.expr("if(c_custkey % 5 = 0, c_nationkey + 1, c_nationkey)").alias("v")),
        "path", "v", "/n1",
    )
)
query("needs_compaction", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_deleted, count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.2 AS compact FROM events")(lambda t: T.needs_compaction(t.events, "event_type = 'error'"))
query("windowed_counts", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, {money_sql('value')} AS total FROM events GROUP BY 1, 2")(
    lambda t: T.windowed_counts(t.events.withColumn("value", c("value").cast("decimal(18,2)")), "ts", "event_type", "value").select(c("w.start").alias("hour"), "event_type", "n", c("total").cast("double").alias("total"))
)


@query("cdc_stream_state", _STATE)
def _cdc_stream(t):
    """The same state as cdc_latest_state, kept by a stream of micro-batches."""
    import uuid

    folder = f"{shared.folder(t.spark)}/tessera-state-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    state = T.StateTable(t.spark, folder, "user_id", "event_id", "event_type = 'error'")
    T.run_stream(source.select("user_id", "event_id", "event_type"), state.merge, f"{folder}/checkpoint")
    return state.current().select("user_id", "event_type", "event_id")


# --- knowledge base ------------------------------------------------------------------------------------------

# every document's whole text, in chunks of ids, so that a hot source is not one row
_EXPORT = "SELECT source, doc_id // 100 AS chunk, string_agg(doc_id || ': ' || text, chr(10) ORDER BY doc_id) AS listing FROM documents GROUP BY 1, 2"
for _name in ("kb_export", "kb_export_all"):
    query(_name, _EXPORT)(
        lambda t: t.documents.groupBy("source", F.expr("doc_id div 100").alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: F.concat(r["doc_id"].cast("string"), F.lit(": "), r["text"])), "\n").alias("listing"))
    )
query("kb_unverified", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti"))
query("kb_verify_checks", "SELECT 'short' AS check_name, count(*) AS n FROM documents WHERE n_chars < 100 UNION ALL SELECT 'no_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'no_text', count(*) FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'length_mismatch', count(*) FROM documents WHERE n_chars <> length(text)")(
    lambda t: t.documents.join(t.labels.select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "left")
    .agg(F.array(*[F.struct(F.lit(n).alias("check_name"), F.count_if(F.expr(e)).alias("n")) for n, e in [("short", "n_chars < 100"), ("no_label", "known is null"), ("no_text", "text is null or text = ''"), ("length_mismatch", "n_chars <> length(text)")]]).alias("x"))
    .select(F.explode("x").alias("x")).select("x.*")
)
query("kb_exact_dups", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")(lambda t: t.documents.groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n"))
query("kb_fix_confidence", "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 0 ELSE quality END AS quality FROM labels")(lambda t: t.labels.select("doc_id", F.when((c("toxic") == 1) & (c("quality") == 1), 0).otherwise(c("quality")).alias("quality")))
query("kb_stats", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS avg_chars, max(n_chars) AS longest FROM documents GROUP BY 1")(lambda t: t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.max("n_chars").alias("longest")))
