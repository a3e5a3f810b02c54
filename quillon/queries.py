"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import sources, sql
from quillon.functions import columns as C
from quillon.operators import advisor, aggregates as A, construct
from quillon.plans import reader as R
from quillon.sources import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become documents."""
    return sources.spread(_t(spark, sf_dir, name))


# documents derived from the tables


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts and doc {event_id, event_type, props: {k}, user_id} as text."""
    e = _wide(spark, sf_dir, "events")
    text = F.concat(
        F.lit('{"user_id":'), F.col("user_id"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"),
        F.lit(',"event_id":'), F.col("event_id"), F.lit("}"),
    )
    return e.select("event_id", "user_id", "event_type", "ts", text.alias("doc"))


_EVENT = (
    "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"props\":{\"k\":' || (props->>'$.k') || '},\"user_id\":' || user_id || '}'"
)


def order_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct per order: key, priority, status and items in line order, an empty array for orders without lines."""
    line = _t(spark, sf_dir, "lineitem")
    item = F.struct(
        F.col("l_linenumber").alias("n"),
        F.struct(
            F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag")
        ).alias("i"),
    )
    items = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    orders = _wide(spark, sf_dir, "orders")
    joined = orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left")
    none = F.array().cast(items.schema["items"].dataType)
    body = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"), F.coalesce("items", none).alias("items")
    )
    return joined.select("o_orderkey", "o_custkey", body.alias("s"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_structs(spark, sf_dir)
    return df.select("o_orderkey", "o_custkey", construct.plain(F.col("s"), df.schema["s"].dataType).alias("doc"))


_ITEMS = "to_json(list({'flag': l_returnflag, 'part': l_partkey, 'qty': CAST(l_quantity AS BIGINT)} ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_returnflag) FILTER (l_orderkey IS NOT NULL))"
_ORDER = f"""
o AS (
  SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderstatus) AS status, any_value(o_orderpriority) AS prio,
         coalesce(CAST({_ITEMS} AS VARCHAR), '[]') AS items, count(l_orderkey) AS n_items, sum(CAST(l_quantity AS BIGINT)) AS qty,
         arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
), od AS (
  SELECT *, '{{"items":' || items || ',"key":' || o_orderkey || ',"prio":"' || prio || '","status":"' || status || '"}}' AS doc FROM o
)
"""


# construction, rendering


@query(f"SELECT event_id, {_EVENT} AS doc FROM events")
def parse_canonical(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    return d.select("event_id", C.doc("doc").alias("doc"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS good FROM events GROUP BY event_type")
def try_parse(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    text = F.when(F.col("event_id") % 3 == 0, F.concat("doc", F.lit("]"))).otherwise(F.col("doc"))
    return d.withColumn("d", C.try_doc(text)).groupBy("event_type").agg(F.count("*").alias("n"), F.count("d").alias("good"))


@query(f"WITH {_ORDER} SELECT o_orderkey, doc FROM od")
def construct_struct(spark, sf_dir):
    d = order_structs(spark, sf_dir)
    kind = d.schema["s"].dataType
    made = d.select("o_orderkey", construct.document(F.col("s"), kind).alias("doc"))
    return made.select("o_orderkey", R.Reader(made, "doc").plain.alias("doc"))


@query(
    """SELECT c_custkey, '{"acct":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"name":"' || c_name || '"}' AS m,
       '[' || c_custkey || ',' || c_nationkey || ']' AS l FROM customer"""
)
def construct_map_list(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumns(
        {
            "l": F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long")),
            "n": F.create_map(F.lit("acct"), F.round(F.col("c_acctbal") * 100).cast("long")),
        }
    )
    name = construct.plain(F.create_map(F.lit("name"), F.col("c_name")), _map("string", "string"))
    return c.select(
        "c_custkey",
        C.merge_patch(construct.plain(F.col("n"), _map("string", "bigint")), name).alias("m"),
        construct.plain(F.col("l"), c.schema["l"].dataType).alias("l"),
    )


def _map(k: str, v: str) -> T.DataType:
    return T.StructType.fromDDL(f"m map<{k},{v}>")["m"].dataType


@query("SELECT conv_id, turn, CAST(to_json(text) AS VARCHAR) AS quoted FROM conversations")
def quote_text(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", C.quote("text").alias("quoted"))


# extraction


@query(
    """SELECT event_type, max(CAST(props->>'$.k' AS BIGINT)) AS max_k, min(CAST(props->>'$.k' AS BIGINT)) AS min_k,
       CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n FROM events GROUP BY event_type"""
)
def extract_typed(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = C.transform("props", {"k": "BIGINT"})["k"]
    return (
        e.select("event_type", k.alias("k"))
        .groupBy("event_type")
        .agg(F.max("k").alias("max_k"), F.min("k").alias("min_k"), F.sum("k").alias("sum_k"), F.count("*").alias("n"))
    )


@query(f"WITH {_ORDER} SELECT o_orderkey, items AS items, CAST(first_part AS VARCHAR) AS part, prio, NULL::VARCHAR AS none FROM od")
def extract_paths(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    reads = {
        "items": C.doc_at("items"),
        "part": C.text_at("$.items[0].part"),
        "prio": C.text_at("prio"),
        "none": C.doc_at("$.items[99]"),
    }
    return d.select("o_orderkey", C.read("doc", reads).alias("x")).select("o_orderkey", "x.*")


@query(f"WITH {_ORDER} SELECT prio, status, count(*) AS n FROM od GROUP BY prio, status")
def extract_many_group(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    got = d.select(C.extract_many("doc", {"prio": "prio", "status": "$.status"}).alias("x"))
    return got.groupBy(F.col("x.prio").alias("prio"), F.col("x.status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b, props->>'$.k' AS c FROM events")
def extract_list(spark, sf_dir):
    d = event_docs(spark, sf_dir).withColumn("x", C.extract_strings("doc", ["event_type", "$.user_id", "$.props.k"]))
    return d.select("event_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))


@query(
    f"""WITH {_ORDER} SELECT o_orderkey, status, CAST(json_array_length(items) AS BIGINT) AS n,
        CAST(from_json(json_extract(items, '$[*].part'), '["BIGINT"]') AS VARCHAR) AS parts,
        array_to_string(items->>'$[*].flag', '|') AS flags, TRY_CAST(prio AS BIGINT) AS bad FROM od"""
)
def transform_fields(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    spec = {
        "status": "VARCHAR",
        "parts": {"type": ["BIGINT"], "path": "$.items[*].part"},
        "flags": {"type": "VARCHAR", "path": "$.items[*].flag", "join_separator": "|"},
        "prio": "BIGINT",
    }
    x = d.select("o_orderkey", C.transform("doc", spec).alias("x"))
    return x.select(
        "o_orderkey",
        "x.status",
        F.size("x.parts").cast("long").alias("n"),
        F.concat(F.lit("["), F.array_join(F.transform("x.parts", lambda p: p.cast("string")), ", "), F.lit("]")).alias("parts"),
        "x.flags",
        F.col("x.prio").alias("bad"),
    )


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, NULL::BIGINT AS type_null, CAST(user_id AS VARCHAR) AS as_text FROM events")
def transform_modes(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    strict = C.transform("doc", {"k": {"type": "BIGINT", "path": "$.props.k"}}, "fail")
    null = C.transform("doc", {"event_type": "BIGINT"}, "null")
    text = C.transform("doc", {"user_id": "VARCHAR"})
    return d.select("event_id", strict["k"].alias("k"), null["event_type"].alias("type_null"), text["user_id"].alias("as_text"))


# flattening


@query(
    """WITH e AS (
         SELECT event_id, unnest([{'key': '$.event_id', 'value': CAST(event_id AS VARCHAR)}, {'key': '$.event_type', 'value': event_type},
           {'key': '$.props.k', 'value': props->>'$.k'}, {'key': '$.user_id', 'value': CAST(user_id AS VARCHAR)}]) AS x FROM events)
       SELECT x.key AS key, count(*) AS n, count(DISTINCT x.value) AS n_values, max(x.value) AS top FROM e GROUP BY x.key"""
)
def entries_flatten(spark, sf_dir):
    d = event_docs(spark, sf_dir).select(F.inline(C.entries("doc")))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max("value").alias("top"))


@query(f"WITH {_ORDER} SELECT o_orderkey, unnest(['items', 'key', 'prio', 'status']) AS key, unnest([items, CAST(o_orderkey AS VARCHAR), prio, status]) AS value FROM od")
def entries_whole_arrays(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    return d.select("o_orderkey", F.inline(C.entries("doc", key_style="dotted", array_style="whole_json")))


@query(
    f"""WITH {_ORDER} SELECT p_brand, count(*) AS n, CAST(sum(CAST(i.x->>'$.qty' AS BIGINT)) AS BIGINT) AS qty
        FROM (SELECT unnest(from_json(items, '["JSON"]')) AS x FROM od) i JOIN part ON p_partkey = CAST(i.x->>'$.part' AS BIGINT) GROUP BY p_brand"""
)
def array_elements_join(spark, sf_dir):
    d = order_docs(spark, sf_dir).select(F.explode(C.array_elements("doc", "items")).alias("i"))
    x = d.select(C.transform("i", {"part": "BIGINT", "qty": "BIGINT"}).alias("x")).select("x.*")
    p = _t(spark, sf_dir, "part")
    return x.join(p, x["part"] == p["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


# introspection


@query(
    f"""WITH {_ORDER} SELECT o_orderkey, 'ARRAY' AS t, 'BIGINT' AS k, NULL::VARCHAR AS none, 'items,key,prio,status' AS keys,
        CASE WHEN n_items > 0 THEN 'flag,part,qty' END AS inner_keys, CAST(n_items AS BIGINT) AS n, NULL::BIGINT AS not_array FROM od"""
)
def introspection(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    reads = {
        "t": C.type_at("items"),
        "k": C.type_at("$.key"),
        "none": C.type_at("nothing"),
        "keys": C.keys_at(),
        "inner_keys": C.keys_at("$.items[0]"),
        "n": C.length_at("items"),
        "not_array": C.length_at("key"),
    }
    x = d.select("o_orderkey", C.read("doc", reads).alias("x")).select("o_orderkey", "x.*")
    return x.withColumns({"keys": F.array_join("keys", ","), "inner_keys": F.array_join("inner_keys", ",")})


EVENT_SPEC = {"event_type": "VARCHAR", "user_id": "BIGINT", "$.props.k": "BIGINT"}


def shredded_events(spark: SparkSession, sf_dir: str, spec: dict = EVENT_SPEC) -> DataFrame:
    d = event_docs(spark, sf_dir)
    return d.select("event_id", "ts", C.shred("doc", spec).alias("j"))


@query(
    """SELECT count(*) AS n, count(*) AS valid, CAST(sum(length(event_type) + 16) AS BIGINT) AS shreds,
       1 AS version, '$.props.k BIGINT,event_type VARCHAR,user_id BIGINT' AS manifest FROM events"""
)
def diagnostics(spark, sf_dir):
    d = shredded_events(spark, sf_dir)
    m = F.array_join(F.transform(C.shred_manifest("j", EVENT_SPEC), lambda x: F.concat_ws(" ", x["path"], x["type"])), ",")
    return d.agg(
        F.count("*").alias("n"),
        F.count_if(C.validate("j", EVENT_SPEC)).alias("valid"),
        F.sum(C.storage_size("j", EVENT_SPEC)["shreds"]).alias("shreds"),
        F.max(C.version()).alias("version"),
        F.max(m).alias("manifest"),
    )


# merge and diff


@query(
    """SELECT event_id, '{"event_id":' || event_id || ',"props":{"k":' || (props->>'$.k') || ',"x":[1,null]},"seen":true,"user_id":' || user_id || '}' AS doc
       FROM events"""
)
def merge_patch(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    patch = F.lit('{"event_type":null,"props":{"x":[1,null],"none":null},"seen":true}')
    return d.select("event_id", C.merge_patch("doc", patch).alias("doc"))


@query(
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":{"k":' || (props->>'$.k') ||
       ',"z":0},"seen":1,"user_id":' || user_id || '}' AS doc FROM events"""
)
def overlay(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    return d.select("event_id", C.overlay("doc", F.lit('{"event_type":"no","gone":null,"props":{"k":-1,"z":0},"seen":1}')).alias("doc"))


@query(
    """WITH s AS (
         SELECT o_custkey, o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, lag(o_orderstatus) OVER w AS pst, lag(o_orderpriority) OVER w AS ppr
         FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
       SELECT o_custkey, o_orderkey, '{' || array_to_string(list_filter(
         [CASE WHEN pr IS DISTINCT FROM ppr THEN '"prio":"' || pr || '"' END, CASE WHEN st IS DISTINCT FROM pst THEN '"status":"' || st || '"' END],
         lambda x: x IS NOT NULL), ',') || '}' AS change FROM s"""
)
def diff_snapshots(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    body = F.concat(F.lit('{"prio":"'), "o_orderpriority", F.lit('","status":"'), "o_orderstatus", F.lit('"}'))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = o.withColumn("doc", body).withColumn("prev", F.lag("doc").over(w))
    return d.select("o_custkey", "o_orderkey", C.diff("prev", "doc").alias("change"))


@query(
    f"""WITH {_ORDER}, l AS (SELECT o_orderkey, o_custkey, list_transform(from_json(items, '["JSON"]'), lambda x: x->>'$.flag') AS f FROM od),
        p AS (SELECT *, lag(f) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM l),
        c AS (SELECT o_orderkey, u.v AS v, len(list_filter(f, lambda x: x = u.v)) AS a, len(list_filter(coalesce(g, []), lambda x: x = u.v)) AS b
              FROM p, (SELECT unnest(['A', 'N', 'R']) AS v) u)
        SELECT o_orderkey, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS added, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS removed FROM c GROUP BY o_orderkey"""
)
def diff_array_counts(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    flags = C.transform("doc", {"f": {"type": ["VARCHAR"], "path": "$.items[*].flag"}})["f"]
    text = F.concat(F.lit('{"f":['), F.array_join(F.transform(flags, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]}"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = d.select("o_orderkey", "o_custkey", text.alias("t"))
    d = d.withColumn("c", C.diff(F.lag("t").over(w), F.col("t"), "counts"))
    x = C.transform("c", {"added": {"type": "BIGINT", "path": "$.f.added"}, "removed": {"type": "BIGINT", "path": "$.f.removed"}})
    return d.select("o_orderkey", F.coalesce(x["added"], F.lit(0)).alias("added"), F.coalesce(x["removed"], F.lit(0)).alias("removed"))


# aggregates


def event_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _wide(spark, sf_dir, "events")
    text = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":{"id":'), F.col("event_id"), F.lit(',"none":null},"last":'), F.col("event_id"), F.lit("}"))
    return e.select("user_id", "ts", "event_id", "event_type", text.alias("doc"))


def _merged_sql(fn: str) -> str:
    return f"""WITH p AS (SELECT user_id, event_type, {fn}(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2),
      l AS (SELECT user_id, {fn}(event_id, (ts, event_id)) AS last FROM events GROUP BY 1),
      a AS (SELECT user_id, event_type AS k, '{{"id":' || id || '}}' AS v FROM p UNION ALL SELECT user_id, 'last', CAST(last AS VARCHAR) FROM l)
      SELECT user_id, '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}}' AS merged FROM a GROUP BY user_id"""


@query(_merged_sql("arg_max"))
def group_merge_ordered(spark, sf_dir):
    return A.group_merge(event_patches(spark, sf_dir), ["user_id"], "doc", ["ts", "event_id"])


@query(_merged_sql("arg_max"))
def group_merge_max(spark, sf_dir):
    return A.group_merge_max(event_patches(spark, sf_dir), ["user_id"], "doc", F.struct("ts", "event_id"))


@query(_merged_sql("arg_min"))
def group_merge_min(spark, sf_dir):
    return A.group_merge_min(event_patches(spark, sf_dir), ["user_id"], "doc", F.struct("ts", "event_id"))


@query(f"SELECT user_id, '[' || string_agg({_EVENT}, ',' ORDER BY event_id) || ']' AS docs FROM events GROUP BY user_id")
def group_array_ordered(spark, sf_dir):
    d = event_docs(spark, sf_dir).withColumn("doc", C.doc("doc"))
    return d.groupBy("user_id").agg(A.group_array("doc", ["event_id"]).alias("docs"))


@query(
    """WITH p AS (SELECT user_id, event_type, max(event_id) AS id FROM events GROUP BY 1, 2)
       SELECT user_id, '{' || string_agg('"' || event_type || '":' || id, ',' ORDER BY event_type) || '}' AS object FROM p GROUP BY user_id"""
)
def group_object(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("doc", F.col("event_id").cast("string"))
    return A.group_object(e, ["user_id"], "event_type", "doc", "event_id")


@query("SELECT user_id, '[' || string_agg(d, ',' ORDER BY d) || ']' AS types FROM (SELECT DISTINCT user_id, '\"' || event_type || '\"' AS d FROM events) GROUP BY user_id")
def group_array_distinct(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("doc", C.quote("event_type"))
    return e.groupBy("user_id").agg(A.group_array_distinct("doc").alias("types"))


@query(
    """SELECT event_id, '[' || array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') || ']' AS recent
       FROM events"""
)
def group_array_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("doc", F.col("event_id").cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return e.select("event_id", A.group_array_over("doc", w).alias("recent"))


@query(
    """WITH p AS (SELECT event_id, event_type, list(event_type) OVER w AS ts, list(event_id) OVER w AS ids
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
       SELECT event_id, len(list_distinct(ts)) + 1 AS n_keys, CAST(event_id AS VARCHAR) AS last FROM p"""
)
def group_merge_window(spark, sf_dir):
    d = event_patches(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    d = d.select("event_id", F.collect_list("doc").over(w).alias("docs")).withColumn("m", A.fold_list("docs"))
    return d.select("event_id", F.size(C.keys("m")).cast("long").alias("n_keys"), C.extract_string("m", "last").alias("last"))


@query("SELECT '{\"$.props.k\": ''BIGINT'', event_id: ''BIGINT'', event_type: ''VARCHAR'', user_id: ''BIGINT''}' AS spec")
def suggest_shredding(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    return spark.createDataFrame([(advisor.suggest_shredding(d, "doc"),)], "spec string")


@query(
    """SELECT unnest(['$.props.k', 'event_type']) AS path, unnest(['BIGINT', 'BIGINT']) AS type, unnest([1.0, 0.0]) AS lane_rate, unnest([0.0, 1.0]) AS divert_rate"""
)
def shred_stats(spark, sf_dir):
    spec = {"event_type": "BIGINT", "$.props.k": "BIGINT"}
    return shredded_events(spark, sf_dir, spec).agg(advisor.shred_stats(F.col("j"), spec).alias("s")).select(F.inline("s"))


# shredded reads


@query(f"SELECT event_id, {_EVENT} AS doc FROM events")
def shred_round_trip(spark, sf_dir):
    d = shredded_events(spark, sf_dir)
    return d.select("event_id", C.to_json("j", EVENT_SPEC).alias("doc"))


@query("SELECT event_type AS kind, CAST(sum(user_id) AS BIGINT) AS users, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 20 AND 40 GROUP BY 1")
def shred_filter_group(spark, sf_dir):
    d = shredded_events(spark, sf_dir)
    r = R.Reader(d, "j")
    got = d.where(r.where("$.props.k", ">=", 20) & r.where("$.props.k", "<=", 40))
    return got.groupBy(r.get_text("event_type").alias("kind")).agg(F.sum(r.get("user_id", "BIGINT")).alias("users"), F.count("*").alias("n"))


@query(
    """SELECT event_id, event_type AS lane, CAST(event_id AS VARCHAR) AS residual, '{"k":' || (props->>'$.k') || '}' AS whole,
       'OBJECT' AS t, CAST(user_id AS VARCHAR) AS misfit FROM events"""
)
def shred_read_kinds(spark, sf_dir):
    d = shredded_events(spark, sf_dir, {"event_type": "VARCHAR", "user_id": "VARCHAR", "$.props.k": "BIGINT"})
    r = R.Reader(d, "j")
    reads = {"residual": C.text_at("event_id"), "whole": C.text_at("$.props"), "t": C.type_at("$.props"), "misfit": C.text_at("user_id")}
    return d.select("event_id", r.get_text("event_type").alias("lane"), r.read(reads).alias("x")).select("event_id", "lane", "x.*")


@query(
    """SELECT event_id, event_type AS kind, CAST(event_id AS VARCHAR) AS id, 'OBJECT' AS t, 1 AS n FROM events"""
)
def extract_single_reads(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    n = F.size(C.keys("doc", "$.props")).alias("n")
    return d.select("event_id", C.extract_string("doc", "event_type").alias("kind"), C.extract("doc", "event_id").alias("id"), C.type_of("doc", "props").alias("t"), n)


@query(f"SELECT event_id, {_EVENT} AS doc FROM events UNION SELECT event_id, {_EVENT} FROM events WHERE event_id % 2 = 0")
def shred_union_distinct(spark, sf_dir):
    one = shredded_events(spark, sf_dir).select("event_id", "j")
    two = shredded_events(spark, sf_dir, {"event_id": "BIGINT", "user_id": "VARCHAR"}).where("event_id % 2 = 0").select("event_id", "j")
    return R.align(one, "j", None).union(R.align(two, "j", None)).distinct().withColumnRenamed("j", "doc")


@query(f"SELECT event_id, {_EVENT} AS doc FROM events WHERE event_id % 2 = 0")
def shred_intersect(spark, sf_dir):
    one = R.align(shredded_events(spark, sf_dir).select("event_id", "j"), "j", None)
    two = R.align(shredded_events(spark, sf_dir, {"event_id": "BIGINT"}).where("event_id % 2 = 0").select("event_id", "j"), "j", None)
    return one.intersect(two).withColumnRenamed("j", "doc")


@query(f"SELECT event_id, {_EVENT} AS doc FROM events WHERE event_id % 2 <> 0")
def shred_except(spark, sf_dir):
    one = R.align(shredded_events(spark, sf_dir).select("event_id", "j"), "j", None)
    two = R.align(shredded_events(spark, sf_dir, {"user_id": "BIGINT"}).where("event_id % 2 = 0").select("event_id", "j"), "j", None)
    return one.exceptAll(two).withColumnRenamed("j", "doc")


@query(f"SELECT event_id, {_EVENT} AS doc, event_type AS kind FROM events UNION ALL SELECT event_id, {_EVENT}, event_type FROM events WHERE event_id % 5 = 0")
def shred_union_lanes(spark, sf_dir):
    one = shredded_events(spark, sf_dir).select("event_id", "j")
    two = shredded_events(spark, sf_dir, {"event_id": "BIGINT"}).where("event_id % 5 = 0").select("event_id", "j")
    both = R.union(one, two, "j")
    r = R.Reader(both, "j")
    return both.select("event_id", r.plain.alias("doc"), r.get_text("event_type").alias("kind"))


@query(f"WITH {_ORDER} SELECT o_orderkey, doc FROM od")
def shred_array_lanes(spark, sf_dir):
    spec = {"items": "STRUCT(part BIGINT, flag VARCHAR)[]", "key": "BIGINT"}
    d = order_docs(spark, sf_dir)
    return d.select("o_orderkey", C.reconstruct(C.shred("doc", spec), spec).alias("doc"))


@query(f"SELECT event_id, {_EVENT} AS doc FROM events")
def reshred(spark, sf_dir):
    new = {"event_id": "BIGINT", "$.props.k": "VARCHAR"}
    d = shredded_events(spark, sf_dir).select("event_id", C.reshred("j", EVENT_SPEC, new).alias("j"))
    return d.select("event_id", C.reconstruct("j", new).alias("doc"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '{"event_type":"changed"}' END AS diff FROM events"""
)
def diff_shredded(spark, sf_dir):
    d = event_docs(spark, sf_dir)
    other = F.when(F.col("event_id") % 2 == 0, F.col("doc")).otherwise(C.merge_patch("doc", F.lit('{"event_type":"changed"}')))
    d = d.select("event_id", C.shred("doc", EVENT_SPEC).alias("a"), C.shred(other, EVENT_SPEC).alias("b"))
    return R.diff(d, "a", "b").select("event_id", "diff")


# with the rest of the engine


@query(
    f"""WITH {_ORDER} SELECT prio, status, count(*) AS n, grouping(prio) + 2 * grouping(status) AS g FROM od GROUP BY CUBE (prio, status)"""
)
def cube_on_fields(spark, sf_dir):
    d = order_docs(spark, sf_dir).select(C.extract_many("doc", {"prio": "prio", "status": "status"}).alias("x")).select("x.*")
    return d.cube("prio", "status").agg(
        F.count("*").alias("n"), (F.grouping("prio").cast("long") + 2 * F.grouping("status").cast("long")).alias("g")
    )


@query("SELECT min(event_type) AS low, max(event_type) AS high, min(props->>'$.k') AS low_k, max(props->>'$.k') AS high_k FROM events")
def text_extrema(spark, sf_dir):
    d = shredded_events(spark, sf_dir)
    r = R.Reader(d, "j")
    return d.agg(
        A.text_min(r.get_text("event_type")).alias("low"),
        A.text_max(r.get_text("event_type")).alias("high"),
        A.text_min(r.get_text("$.props.k")).alias("low_k"),
        A.text_max(r.get_text("$.props.k")).alias("high_k"),
    )


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events ORDER BY k DESC, event_id LIMIT 25")
def top_k_by_field(spark, sf_dir):
    d = shredded_events(spark, sf_dir)
    k = R.Reader(d, "j").get("$.props.k", "BIGINT")
    return d.select("event_id", k.alias("k")).orderBy(F.desc("k"), "event_id").limit(25)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_on_lane(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).alias("s"))
    d = o.select(construct.document(F.col("s"), o.schema["s"].dataType).alias("j"))
    r = R.Reader(d, "j", clean=True)
    keys = d.where(r.where("status", "=", "F")).select(r.get("cust", "BIGINT").alias("k"))
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    return c.join(keys, F.col("c_custkey") == F.col("k"), "left_semi")


@query("SELECT event_type, count(*) AS n, max(CAST(props->>'$.k' AS BIGINT)) AS k FROM events GROUP BY event_type")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    event_docs(spark, sf_dir).createOrReplaceTempView("quillon_event_docs")
    return spark.sql(
        """SELECT doc_extract_string(doc, '$.event_type') AS event_type, count(*) AS n,
           max(CAST(doc_extract_string(doc, '$.props.k') AS BIGINT)) AS k FROM quillon_event_docs GROUP BY 1"""
    )


# merges in one aggregation


def wide_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts and a flat document with two thirds of the keys k00 to k99."""
    e = _wide(spark, sf_dir, "events")
    entry = lambda j: F.when(
        (F.col("event_id") + j) % 3 != 0, F.concat(F.lit('"k'), F.lpad(j.cast("string"), 2, "0"), F.lit('":'), F.col("event_id") * 100 + j)
    )
    keys = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(99)), entry))
    return e.select("user_id", "event_id", "ts", F.concat(F.lit("{"), F.array_join(keys, ","), F.lit("}")).alias("doc"))


WIDE_SPEC = {f"k{j:02}": "BIGINT" for j in range(100)}


def _wide_sql(fn: str, group: str, name: str) -> str:
    return f"""WITH w AS (SELECT {group} AS g, j, {fn}(event_id * 100 + j, (ts, event_id)) AS v FROM events, range(100) r(j) WHERE (event_id + j) % 3 <> 0 GROUP BY 1, 2)
      SELECT g AS {name}, '{{' || string_agg('"k' || lpad(CAST(j AS VARCHAR), 2, '0') || '":' || v, ',' ORDER BY j) || '}}' AS merged FROM w GROUP BY g"""


@query(_wide_sql("arg_max", "event_id % 10000", "g"))
def wide_merge_max_many(spark, sf_dir):
    d = wide_docs(spark, sf_dir).withColumn("g", F.col("event_id") % 10000)
    return A.group_merge_max(d, ["g"], "doc", F.struct("ts", "event_id"))


@query(_wide_sql("arg_min", "event_id % 10000", "g"))
def wide_merge_min_many(spark, sf_dir):
    d = wide_docs(spark, sf_dir).withColumn("g", F.col("event_id") % 10000)
    return A.group_merge_min(d, ["g"], "doc", F.struct("ts", "event_id"))


@query(_wide_sql("arg_max", "user_id", "user_id"))
def wide_merge_max_few(spark, sf_dir):
    return A.group_merge_max(wide_docs(spark, sf_dir), ["user_id"], "doc", F.struct("ts", "event_id"))


@query(_wide_sql("arg_max", "user_id", "user_id"))
def wide_merge_shredded(spark, sf_dir):
    """Shredded documents in, a shredded document out, read as a whole."""
    d = wide_docs(spark, sf_dir).select("user_id", "ts", "event_id", C.shred("doc", WIDE_SPEC).alias("j"))
    out = A.group_merge_max(d, ["user_id"], "j", F.struct("ts", "event_id"))
    return out.select("user_id", R.Reader(out, "merged").plain.alias("merged"))


@query(
    f"""WITH a AS ({_merged_sql("arg_min")}),
        b AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT a.user_id, a.merged AS earliest, '{{"last":' || id || ',"purchase":{{"id":' || id || '}}}}' AS bought FROM a LEFT JOIN b USING (user_id)"""
)
def merge_pair(spark, sf_dir):
    """Two merges in one aggregation, one of them over some rows only."""
    key = F.struct("ts", "event_id")
    return A.merges(
        event_patches(spark, sf_dir), ["user_id"], earliest=A.Merge("doc", key, "min"), bought=A.Merge("doc", key, where=F.col("event_type") == "purchase")
    )


# SQL names with NULLs


@query(
    """WITH s AS (SELECT event_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
       SELECT event_id, CASE WHEN p = t THEN '{}' ELSE '{"t":"' || t || '"}' END AS forth,
         CASE WHEN p IS NULL THEN '{"t":null}' WHEN p = t THEN '{}' ELSE '{"t":"' || p || '"}' END AS back,
         '{"n":1,"t":"' || t || '"}' AS patched, CASE WHEN p IS NOT NULL THEN '{"t":"' || p || '"}' END AS unpatched,
         '{"t":"' || coalesce(p, t) || '"}' AS laid, p AS text FROM s"""
)
def sql_null_rules(spark, sf_dir):
    sql.register(spark)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = _wide(spark, sf_dir, "events").withColumn("cur", F.concat(F.lit('{"t":"'), "event_type", F.lit('"}')))
    d.withColumn("prev", F.lag("cur").over(w)).createOrReplaceTempView("quillon_event_steps")
    return spark.sql(
        """SELECT event_id, doc_diff(prev, cur) AS forth, doc_diff(cur, prev) AS back, doc_merge_patch(prev, cur, '{"n":1}') AS patched,
           doc_merge_patch(cur, prev) AS unpatched, doc_overlay(prev, cur) AS laid, doc_extract_string(prev, '$.t') AS text FROM quillon_event_steps"""
    )


# documents with escapes, fractions, misfits, nulls and repeated keys

ODD_SPEC = {"conv": "BIGINT", "half": "DOUBLE", "role": "VARCHAR", "text": "VARCHAR", "turn": "BIGINT", "tags": "VARCHAR[]"}
_ODD = """'{"conv":' || conv_id || ',"half":' || turn || '.50,"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"tags":['
  || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',null,7],"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":'
  || CASE WHEN role = 'assistant' THEN '"t' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}'"""


def odd_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and JSON texts: turns are misfits in some rows, keys are unordered and one is repeated."""
    c = _wide(spark, sf_dir, "conversations")
    text, role = (F.coalesce(C.quote(n), F.lit("null")) for n in ("text", "role"))
    turn = F.when(F.col("role") == "assistant", F.concat(F.lit('"t'), "turn", F.lit('"'))).otherwise(F.col("turn").cast("string"))
    body = F.concat(
        F.lit('{ "turn": '), turn, F.lit(', "role": "gone", "text": '), text, F.lit(',"half":'), "turn", F.lit('.50, "tags" :['), role,
        F.lit(', null,7],"conv":'), "conv_id", F.lit(', "role":'), role, F.lit("}"),
    )
    return c.select("conv_id", "turn", "role", "text", body.alias("doc"))


@query(f"SELECT conv_id, turn, {_ODD} AS plain, {_ODD} AS whole FROM conversations")
def odd_round_trip(spark, sf_dir):
    d = odd_docs(spark, sf_dir).select("conv_id", "turn", C.doc("doc").alias("plain"), C.shred("doc", ODD_SPEC).alias("j"))
    return d.select("conv_id", "turn", "plain", R.Reader(d, "j").plain.alias("whole"))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 't' || turn ELSE CAST(turn AS VARCHAR) END AS misfit,
       CASE WHEN role IS DISTINCT FROM 'assistant' THEN turn END AS typed, text AS body, turn || '.50' AS half, role AS tag,
       CASE WHEN role = 'assistant' THEN 'VARCHAR' ELSE 'BIGINT' END AS kind, 3 AS n FROM conversations"""
)
def odd_reads(spark, sf_dir):
    d = odd_docs(spark, sf_dir).select("conv_id", "turn", C.shred("doc", ODD_SPEC).alias("j"))
    r = R.Reader(d, "j")
    reads = {"tag": C.text_at("$.tags[0]"), "kind": C.type_at("turn"), "n": C.length_at("tags")}
    x = d.select(
        "conv_id", d["turn"], r.get_text("turn").alias("misfit"), r.get("turn", "BIGINT").alias("typed"), r.get_text("text").alias("body"),
        r.extract("half").alias("half"), r.read(reads).alias("x"),
    )
    return x.select("conv_id", "turn", "misfit", "typed", "body", "half", "x.*")


@query(
    """SELECT unnest(['conv', 'role', 'text', 'turn']) AS path, unnest([1.0, avg(CAST(role IS NOT NULL AS INT)), avg(CAST(text IS NOT NULL AS INT)),
       avg(CAST(role IS DISTINCT FROM 'assistant' AS INT))]) AS lane_rate, unnest([0.0, 0.0, 0.0, avg(CAST(coalesce(role = 'assistant', false) AS INT))]) AS divert_rate
       FROM conversations"""
)
def odd_stats(spark, sf_dir):
    spec = {k: v for k, v in ODD_SPEC.items() if k not in ("half", "tags")}
    d = odd_docs(spark, sf_dir).select(C.shred("doc", spec).alias("j"))
    return d.agg(advisor.shred_stats(F.col("j"), spec).alias("s")).select(F.inline("s")).drop("type")


@query(
    f"""SELECT conv_id, turn, replace({_ODD}, ',"half":' || turn || '.50', ',"half":"x"') AS patched,
        CASE WHEN role IS NOT NULL THEN '{{"half":"x","role":null}}' ELSE '{{"half":"x"}}' END AS change FROM conversations"""
)
def odd_changes(spark, sf_dir):
    d = odd_docs(spark, sf_dir).withColumn("doc", C.doc("doc"))
    gone = F.when(F.col("role").isNotNull(), F.lit('{"half":"x","role":null}')).otherwise(F.lit('{"half":"x"}'))
    return d.select("conv_id", "turn", C.merge_patch("doc", F.lit('{"half":"x"}')).alias("patched"), C.diff("doc", C.merge_patch("doc", gone)).alias("change"))


# stored tables

_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The path of a table that is written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch.new_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type and doc, shredded, with files ordered by a lane; read back from Parquet."""
    path = stored(
        spark, sf_dir, "events", lambda p: sources.write_shredded(event_docs(spark, sf_dir), p, "doc", EVENT_SPEC, cluster_by=["$.props.k"], row_group_bytes=1 << 18)
    )
    return sources.read_documents(spark, path)


def native_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values in columns of their own, ordered alike."""

    def write(path: str) -> None:
        x = C.transform("doc", {"event_type": "VARCHAR", "user_id": "BIGINT", "k": {"type": "BIGINT", "path": "$.props.k"}})
        d = event_docs(spark, sf_dir).select(x.alias("x")).select("x.*")
        d.sortWithinPartitions("k").write.option("parquet.block.size", 1 << 18).parquet(path)

    return spark.read.parquet(stored(spark, sf_dir, "native", write))


_STORED_SQL = "SELECT event_type AS kind, CAST(sum(user_id) AS BIGINT) AS users, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 20 AND 22 GROUP BY 1"


@query(_STORED_SQL)
def stored_filter(spark, sf_dir):
    """A band on a lane of a stored table whose rows all fit: the filter reaches the scan as it is."""
    d = stored_events(spark, sf_dir)
    r = R.Reader(d, "doc", clean=R.prove_clean(d, "doc"))
    got = d.where(r.where("$.props.k", ">=", 20) & r.where("$.props.k", "<=", 22))
    return got.groupBy(r.get_text("event_type").alias("kind")).agg(F.sum(r.get("user_id", "BIGINT")).alias("users"), F.count("*").alias("n"))


@query(_STORED_SQL)
def stored_filter_native(spark, sf_dir):
    """The same over native columns, for comparison."""
    d = native_events(spark, sf_dir).where("k between 20 and 22")
    return d.groupBy(F.col("event_type").alias("kind")).agg(F.sum("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT event_id % 7 AS g, count(*) AS n FROM events GROUP BY 1")
def stored_residual(spark, sf_dir):
    """A read that no lane serves."""
    d = stored_events(spark, sf_dir)
    return d.groupBy((R.Reader(d, "doc").get("event_id", "BIGINT") % 7).alias("g")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {_EVENT} AS doc FROM events")
def stored_whole(spark, sf_dir):
    d = stored_events(spark, sf_dir)
    return d.select("event_id", R.Reader(d, "doc").plain.alias("doc"))


@query(
    """SELECT event_type AS kind, CAST(k AS BIGINT) AS k, count(*) AS n FROM (SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events
       UNION ALL SELECT event_type, CAST(props->>'$.k' AS BIGINT) FROM events) WHERE k >= 90 GROUP BY 1, 2"""
)
def stored_mixed_lanes(spark, sf_dir):
    """One table of files with different lanes: the marker keeps rows of files that lack a lane."""

    def write(path: str) -> None:
        sources.write_shredded(event_docs(spark, sf_dir), f"{path}/part=1", "doc", {"event_type": "VARCHAR", "$.props.k": "BIGINT"})
        sources.write_shredded(event_docs(spark, sf_dir), f"{path}/part=2", "doc", {"event_type": "VARCHAR", "user_id": "BIGINT"})

    d = sources.read_documents(spark, stored(spark, sf_dir, "mixed", write))
    r = R.Reader(d, "doc")
    got = d.where(r.where("$.props.k", ">=", 90))
    return got.groupBy(r.get_text("event_type").alias("kind"), r.get("$.props.k", "BIGINT").alias("k")).agg(F.count("*").alias("n"))
