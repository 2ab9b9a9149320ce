"""The record and catalog queries over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import gate
from .functions import payload as p
from .functions.shared import shared_folder
from .operators import catalog, fixtures, identity, ladder, lens, nodes, overlay, vocabulary
from .plans import documents, projection
from .plans import schemas as s
from .sources import store
from .sources import types as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _object(properties: dict, required: list[str] | None = None, **more) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties) if required is None else required, **more}


def _text(column: str, key: str):
    return p.text(p.get(F.col(column), key)).alias(key)


def _number(column: str, key: str, to: str = "double"):
    return p.number(p.get(F.col(column), key)).cast(to).alias(key)


def _gated(df: DataFrame, schema: dict, keys: list[str], *names: str) -> DataFrame:
    """keys and whether the columns of these names, as a payload, are accepted."""
    rows = df.select(*keys, p.from_frame(df, *names).alias("_payload"))
    return rows.select(*keys, gate.accepts(schema, F.col("_payload")).alias("accepted"))


EVENT = _object({
    "kind": {"type": "string", "minLength": 5, "x-source": {"path": "event_type", "cast": "trim"}},
    "k": {"type": "integer", "x-source": {"path": "props.k", "cast": "int", "default": -1}},
    "who": {"type": "string", "x-source": {"path": "props.user.name", "default": "anon"}},
    "note": {"type": "string"},
}) | {"$id": "https://example.org/event/1"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = F.to_variant_object(F.create_map(F.lit("event_type"), F.col("event_type").cast("variant"), F.lit("props"), F.try_parse_json("props")))
    return _table(spark, sf_dir, "events").select("event_id", "event_type", foreign.alias("foreign"))


@query("""
SELECT event_id, NOT (length(trim(event_type)) >= 5) AS quarantined, CASE WHEN length(trim(event_type)) >= 5 THEN 'source-projection' END AS rung,
  CASE WHEN length(trim(event_type)) >= 5 THEN trim(event_type) END AS kind,
  CASE WHEN length(trim(event_type)) >= 5 THEN coalesce(json_extract_string(props, '$.k')::BIGINT, -1) END AS k,
  CASE WHEN length(trim(event_type)) >= 5 THEN 'anon' END AS who, CASE WHEN length(trim(event_type)) >= 5 THEN '' END AS note FROM events""")
def source_projection_events(spark, sf_dir):
    out = ladder.Ladder.default().project(_events(spark, sf_dir), "foreign", EVENT).select("event_id", "result.*")
    return out.select("event_id", "quarantined", "rung", _text("migrated", "kind"), _number("migrated", "k", "bigint"), _text("migrated", "who"), _text("migrated", "note"))


def _cast_all(df: DataFrame, key: str, column: str) -> DataFrame:
    v = F.col(column).cast("variant")
    return df.select(key, *[p.text(p.cast(c, v)).alias(f"as_{c}") if c in ("string", "trim") else p.number(p.cast(c, v)).alias(f"as_{c}") if c != "bool" else F.try_variant_get(p.cast(c, v), "$", "boolean").alias("as_bool") for c in ("string", "int", "float", "bool", "trim")])


@query("""
SELECT o_orderkey, o_orderpriority AS as_string, trim(o_orderpriority) AS as_trim,
  coalesce(nullif(regexp_extract(o_orderpriority, '^\\s*([0-9]+)', 1), '')::DOUBLE, 0) AS as_int,
  coalesce(nullif(regexp_extract(o_orderpriority, '^\\s*([0-9]+)', 1), '')::DOUBLE, 0) AS as_float,
  lower(trim(o_orderpriority)) NOT IN ('', '0', 'false', 'no', 'off') AS as_bool FROM orders""")
def source_cast_orders(spark, sf_dir):
    return _cast_all(_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")


ORDER_1 = _object({"o_orderkey": {"type": "integer"}, "o_orderstatus": {"type": "string"}, "o_totalprice": {"type": "number"}})
ORDER_2 = _object({**ORDER_1["properties"], "currency": {"type": "string", "default": "EUR"}, "tags": {"type": "array"}})


@query("SELECT o_orderkey, 'structural' AS rung, o_orderstatus, o_totalprice, 'EUR' AS currency, 0 AS tags FROM orders")
def structural_add_default_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", p.from_frame(orders, "o_orderkey", "o_orderstatus", "o_totalprice").alias("payload"))
    out = ladder.Ladder.default().migrate(rows, "payload", ORDER_1, ORDER_2).select("o_orderkey", "result.*")
    return out.select("o_orderkey", "rung", _text("migrated", "o_orderstatus"), _number("migrated", "o_totalprice"), _text("migrated", "currency"), F.size(p.as_array(p.get(F.col("migrated"), "tags"))).alias("tags"))


LINE_1 = _object({k: {"type": "number"} for k in ("l_orderkey", "l_linenumber", "l_quantity", "l_tax")})
LINE_2 = _object({k: {"type": "number"} for k in ("l_orderkey", "l_linenumber", "l_quantity")}, additionalProperties=False)


@query("SELECT l_orderkey, l_linenumber, l_quantity, 3 AS n_keys, 'structural' AS rung FROM lineitem")
def structural_drop_lineitem(spark, sf_dir):
    names = list(LINE_1["properties"])
    lines = _table(spark, sf_dir, "lineitem")
    rows = lines.select(p.from_frame(lines, *names).alias("payload"))
    out = ladder.Ladder.default().migrate(rows, "payload", LINE_1, LINE_2).select("result.*")
    return out.select(_number("migrated", "l_orderkey", "bigint"), _number("migrated", "l_linenumber", "int"), _number("migrated", "l_quantity"), F.size("migrated").alias("n_keys"), "rung")


PART_1 = _object({"p_partkey": {"type": "integer"}, "p_size": {"type": "integer"}})
PART_2 = _object({"p_partkey": {"type": "integer"}, "p_size": {"type": "number", "maximum": 40}, "colour": {"type": ["null", "string"]}, "stock": {"type": "integer"}, "box": {"type": "object"}})


@query("""
SELECT p_partkey, p_size > 40 AS quarantined, CASE WHEN p_size <= 40 THEN p_size::DOUBLE END AS p_size, CASE WHEN p_size <= 40 THEN '' END AS colour,
  CASE WHEN p_size <= 40 THEN 0::DOUBLE END AS stock, CASE WHEN p_size <= 40 THEN '{}' END AS box FROM part""")
def structural_widen_part(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rows = part.select("p_partkey", p.from_frame(part, "p_partkey", "p_size").alias("payload"))
    out = ladder.Ladder.default().migrate(rows, "payload", PART_1, PART_2).select("p_partkey", "result.*")
    return out.select("p_partkey", "quarantined", _number("migrated", "p_size"), _text("migrated", "colour"), _number("migrated", "stock"), F.to_json(p.get(F.col("migrated"), "box")).alias("box"))


CUSTOMER_1 = _object({"c_custkey": {"type": "integer"}, "full_name": {"type": ["string", "null"]}, "segment": {"type": "string"}}, ["c_custkey"]) | {"$id": "https://example.org/customer/1"}
CUSTOMER_2 = _object({
    "c_custkey": {"type": "integer"}, "displayName": {"type": "string", "minLength": 1, "x-migrate-from": "full_name"}, "segment": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE", "NONE"], "default": "NONE"},
}, ["c_custkey", "displayName"]) | {"$id": "https://example.org/customer/2"}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are present, null or absent, by key modulo 3; records already renamed have displayName."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("full_name")))).when(F.col("c_custkey") % 3 == 1, F.lit('{"full_name":null}')).otherwise(F.to_json(F.struct(F.col("c_name").alias("displayName"))))
    base = p.from_json(F.to_json(F.struct("c_custkey", F.col("c_mktsegment").alias("segment"))))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.map_concat(base, p.from_json(name)).alias("payload"))


_CUSTOMER_RUNGS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'NONE') THEN NULL
  WHEN c_custkey % 3 = 0 THEN 'declared-mapping' ELSE 'structural' END AS rung, c_name FROM customer"""


@query(f"SELECT c_custkey, rung, rung IS NULL AS quarantined, CASE WHEN rung IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN rung IS NOT NULL AND rung <> 'structural' THEN c_name END AS \"displayName\" FROM ({_CUSTOMER_RUNGS})")
def ladder_customer_v1_to_v2(spark, sf_dir):
    """Structural fills an added displayName with an empty text, which minLength refuses."""
    out = ladder.Ladder.default().migrate(_customers(spark, sf_dir), "payload", CUSTOMER_1, CUSTOMER_2).select("c_custkey", "result.*")
    return out.select("c_custkey", "rung", "quarantined", "confidence", _text("migrated", "displayName"))


ORACLE_SQL["ladder_customer_v1_to_v2"] = """
SELECT c_custkey, rung, rung IS NULL AS quarantined, CASE WHEN rung IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN rung IS NOT NULL THEN c_name END AS "displayName" FROM (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'NONE') THEN 'declared-mapping' END AS rung FROM customer)"""


@query("""
SELECT coalesce(rung, 'quarantine') AS rung, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 3 <> 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'NONE') THEN 'declared-mapping' END AS rung FROM customer) GROUP BY 1""")
def ladder_rung_counts(spark, sf_dir):
    return ladder_customer_v1_to_v2(spark, sf_dir).groupBy(F.coalesce("rung", F.lit("quarantine")).alias("rung")).agg(F.count("*").alias("n"))


def _renamed(spark, sf_dir, name: str, columns: list[str], renames: dict[str, str]) -> DataFrame:
    old = _object({c: {} for c in columns})
    new = _object({k: ({"x-migrate-from": renames[k]} if k in renames else {}) for k in dict.fromkeys([*(c for c in columns if c not in renames.values()), *renames])})
    found = _table(spark, sf_dir, name)
    rows = found.select(p.from_frame(found, *columns).alias("payload"))
    return ladder.Ladder.default().migrate(rows, "payload", old, new).select("result.*")


@query("SELECT s_suppkey, s_name AS b, s_nationkey::DOUBLE AS c, 'declared-mapping' AS rung FROM supplier")
def rename_chain_supplier(spark, sf_dir):
    """a becomes b while b becomes c, at once."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("a"), F.col("s_nationkey").alias("b"))
    old, new = _object({"s_suppkey": {}, "a": {}, "b": {}}), _object({"s_suppkey": {}, "b": {"x-migrate-from": "a"}, "c": {"x-migrate-from": "b"}})
    out = ladder.Ladder.default().migrate(rows.select(p.from_frame(rows).alias("payload")), "payload", old, new).select("result.*")
    return out.select(_number("migrated", "s_suppkey", "bigint"), _text("migrated", "b"), _number("migrated", "c"), "rung")


@query("SELECT n_regionkey::DOUBLE AS n_nationkey, n_nationkey::DOUBLE AS n_regionkey, n_name, 'declared-mapping' AS rung FROM nation")
def rename_swap_nation(spark, sf_dir):
    out = _renamed(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey", "n_name"], {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})
    return out.select(_number("migrated", "n_nationkey"), _number("migrated", "n_regionkey"), _text("migrated", "n_name"), "rung")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AS accepted FROM orders")
def gate_orders_enum(spark, sf_dir):
    schema = _object({"o_orderstatus": {"type": "string", "enum": ["F", "O"]}, "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 200_000}})
    return _gated(_table(spark, sf_dir, "orders"), schema, ["o_orderkey"], "o_orderstatus", "o_totalprice")


@query("SELECT count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS quarantined FROM (SELECT l_quantity = floor(l_quantity) AND l_quantity >= 1 AND l_discount <= 0.05 AND l_returnflag <> 'R' AS ok FROM lineitem)")
def gate_lineitem_range(spark, sf_dir):
    schema = _object({"l_quantity": {"type": "integer", "minimum": 1}, "l_discount": {"maximum": 0.05}, "l_returnflag": {"not": {"const": "R"}}})
    ok = _gated(_table(spark, sf_dir, "lineitem"), schema, [], "l_quantity", "l_discount", "l_returnflag")
    return ok.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("quarantined"))


@query("SELECT doc_id, length(text) BETWEEN 100 AND 2000 AND lang IN ('en', 'fr') AS accepted FROM documents")
def gate_documents_length(spark, sf_dir):
    schema = _object({"text": {"type": "string", "minLength": 100, "maxLength": 2000}, "lang": {"oneOf": [{"const": "en"}, {"const": "fr"}]}})
    return _gated(_table(spark, sf_dir, "documents"), schema, ["doc_id"], "text", "lang")


@query("SELECT vec_id, len(embedding) >= 8 AND list_max(embedding) <= 0.45 AS accepted FROM embeddings")
def gate_embeddings_items(spark, sf_dir):
    schema = _object({"embedding": {"type": "array", "minItems": 8, "items": {"type": "number", "maximum": 0.45}}})
    typed = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return _gated(typed, schema, ["vec_id"], "embedding")


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json(F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"tags":["a","b","c"],"items":[{"id":"x","n":1},{"id":"y","n":2}]}'))).alias("v"))


def _overlay(*actions: dict) -> list[dict]:
    return [{"overlay": "1.0.0", "actions": list(actions)}]


@query("SELECT event_id, 'click2' AS \"type\", json_extract_string(props, '$.k')::DOUBLE AS k, '[9,9]' AS ns, 'deep' AS made, 'z' AS second FROM events")
def overlay_override_events(spark, sf_dir):
    patch = _overlay({"target": "$.type", "override": "click2"}, {"target": "$.items[*].n", "override": 9}, {"target": "$.new.path", "override": "deep"}, {"target": "$.tags[1]", "override": "z"})
    out = _event_documents(spark, sf_dir).withColumn("v", overlay.apply(F.col("v"), patch))
    m = p.as_map(F.col("v"))
    numbers = F.to_json(F.transform(p.as_array(p.get(m, "items")), lambda x: p.number(p.get(p.as_map(x), "n")).cast("int")))
    return out.select("event_id", p.text(p.get(m, "type")).alias("type"), p.number(p.path(F.col("v"), "props.k")).alias("k"), numbers.alias("ns"), p.text(p.path(F.col("v"), "new.path")).alias("made"), p.text(p.path(F.col("v"), "tags.1")).alias("second"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, 1.0::DOUBLE AS added, true AS has_null, '[\"q\"]' AS tags, 7.0::DOUBLE AS y, 1.0::DOUBLE AS x FROM events")
def overlay_merge_events(spark, sf_dir):
    patch = _overlay({"target": "$.props", "merge": {"added": 1, "none": None}}, {"target": "$", "merge": {"tags": ["q"]}}, {"target": "$.items[?(@.id=='y')]", "merge": {"n": 7}}, {"target": "$.absent", "merge": {"a": 1}})
    out = _event_documents(spark, sf_dir).withColumn("v", overlay.apply(F.col("v"), patch))
    props = p.as_map(p.path(F.col("v"), "props"))
    return out.select("event_id", p.number(p.get(props, "k")).alias("k"), p.number(p.get(props, "added")).alias("added"), (p.kind(p.get(props, "none")) == "null").alias("has_null"), F.to_json(p.path(F.col("v"), "tags")).alias("tags"),
                      p.number(p.path(F.col("v"), "items.1.n")).alias("y"), p.number(p.path(F.col("v"), "items.0.n")).alias("x"))


@query("""
SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, 'last' AS a, 19::DOUBLE AS n, '["a","z","c"]' AS tags, false AS has_type FROM events""")
def overlay_order_last_wins(spark, sf_dir):
    """Two documents of twelve actions in all: each action sees what the ones before made."""
    first = [{"target": "$.x.a", "override": "first"}, {"target": "$.x", "merge": {"n": 1}}, *[{"target": "$.x.n", "override": 10 + i} for i in range(4)], {"target": "$.type", "unset": True}]
    second = [{"target": "$.x.n", "override": 19}, {"target": "$.x", "merge": {"a": "last"}}, {"target": "$.tags[1]", "override": "z"}, {"target": "$.tags[9]", "override": "never"}, {"target": "$.props.more", "override": {}}]
    v = overlay.apply(F.col("v"), [*_overlay(*first), *_overlay(*second)])
    out = _event_documents(spark, sf_dir).withColumn("v", v)
    text = lambda at: p.text(p.path(F.col("v"), at))
    return out.select("event_id", p.number(p.path(F.col("v"), "props.k")).alias("k"), text("x.a").alias("a"), p.number(p.path(F.col("v"), "x.n")).alias("n"), F.to_json(p.path(F.col("v"), "tags")).alias("tags"), p.path(F.col("v"), "type").isNotNull().alias("has_type"))


@query("SELECT event_id, false AS has_props, '[\"a\",\"c\"]' AS tags, 1 AS items, 'y' AS id FROM events")
def overlay_unset_events(spark, sf_dir):
    patch = _overlay({"target": "$.props", "unset": True}, {"target": "$.tags[1]", "unset": True}, {"target": "$.items[?(@.id=='x')]", "unset": True}, {"target": "$.absent.key", "unset": True})
    out = _event_documents(spark, sf_dir).withColumn("v", overlay.apply(F.col("v"), patch))
    return out.select("event_id", p.has(p.as_map(F.col("v")), "props").alias("has_props"), F.to_json(p.path(F.col("v"), "tags")).alias("tags"), F.size(p.as_array(p.path(F.col("v"), "items"))).alias("items"), p.text(p.path(F.col("v"), "items.0.id")).alias("id"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'base' ELSE 'base' END AS theme, CASE c_mktsegment WHEN 'BUILDING' THEN 'large' ELSE 'small' END AS size FROM customer""")
def overlay_tenant_keys(spark, sf_dir):
    """Each row's ordered keys pick the documents; the last writer wins, so the order is part of the meaning."""
    registry = {"base": _overlay({"target": "$.theme", "override": "base"}), "BUILDING": _overlay({"target": "$.theme", "override": "b"}, {"target": "$.size", "override": "large"}), "MACHINERY": _overlay({"target": "$.theme", "override": "m"})}
    keys = F.when(F.col("c_mktsegment") == "MACHINERY", F.array("c_mktsegment", F.lit("base"))).otherwise(F.array(F.lit("base"), F.col("c_mktsegment")))
    out = _table(spark, sf_dir, "customer").select("c_custkey", overlay.apply_by_keys(p.literal({"size": "small"}), keys, registry).alias("v"))
    return out.select("c_custkey", p.text(p.path(F.col("v"), "theme")).alias("theme"), p.text(p.path(F.col("v"), "size")).alias("size"))


def _overlay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlay for each order, under its key, and two for each priority: rows (key, n, body)."""
    orders = _table(spark, sf_dir, "orders")
    total = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    own = F.concat(F.lit('{"actions":[{"target":"$.total","override":'), total, F.lit('},{"target":"$.notes[0]","override":"'), F.col("o_orderkey").cast("string"), F.lit('"},{"target":"$.flags","merge":{"seen":{"by":"o"},"none":{}}}'), F.when(F.col("o_orderkey") % 2 == 0, ',{"target":"$.draft","unset":true}').otherwise(""), F.lit("]}"))
    by_key = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.lit(0).alias("n"), own.alias("body"))
    priorities = orders.select(F.col("o_orderpriority").alias("key")).distinct()
    first = priorities.select("key", F.lit(0).alias("n"), F.concat(F.lit('{"actions":[{"target":"$.flags.level","override":"'), F.substring("key", 1, 1), F.lit('"},{"target":"$.items[?(@.id==\'b\')].n","override":9}]}')).alias("body"))
    second = priorities.select("key", F.lit(1).alias("n"), F.lit('{"actions":[{"target":"$.items[*]","merge":{"seen":true}},{"target":"$.flags","merge":{"seen":{"by":"p"}}}]}').alias("body"))
    return by_key.unionByName(first).unionByName(second)


@query("""
SELECT o_orderkey, o_totalprice::DECIMAL(20,2)::VARCHAR AS total, o_orderkey::VARCHAR AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'o' ELSE 'p' END AS by, substr(o_orderpriority, 1, 1) AS level,
  '[1,9]' AS ns, 2 AS seen, o_orderkey % 2 = 1 AS draft, CASE WHEN o_orderkey % 3 = 0 THEN '{}' END AS none FROM orders""")
def overlay_table_keys(spark, sf_dir):
    """Every order's own overlay and those of its priority, from a table with a key for each order; the order of keys tells who writes last."""
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    keys = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority", key, F.lit("unknown"))).otherwise(F.array(key, "o_orderpriority"))
    base = F.parse_json(F.lit('{"draft":true,"items":[{"id":"a","n":1},{"id":"b","n":2}]}'))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", keys.alias("keys"), base.alias("v"))
    v = F.col("v")
    out = overlay.apply_stacks(rows, "v", "keys", _overlay_table(spark, sf_dir))
    items = p.as_array(p.path(v, "items"))
    number = lambda x: p.number(p.get(p.as_map(x), "n")).cast("int")
    return out.select(
        "o_orderkey", p.path(v, "total").cast("decimal(20,2)").cast("string").alias("total"), p.text(p.path(v, "notes.0")).alias("note"), p.text(p.path(v, "flags.seen.by")).alias("by"), p.text(p.path(v, "flags.level")).alias("level"),
        F.to_json(F.transform(items, number)).alias("ns"), F.size(F.filter(items, lambda x: p.has(p.as_map(x), "seen"))).alias("seen"), p.has(p.as_map(v), "draft").alias("draft"), F.to_json(p.path(v, "flags.none")).alias("none"),
    )


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("https://example.org/"), F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("id"), "p_brand", "p_size", "p_partkey")


@query("SELECT DISTINCT p_size::BIGINT AS version FROM part WHERE lower(p_brand) = (SELECT min(lower(p_brand)) FROM part)")
def versions_for_stem(spark, sf_dir):
    frozen = _ids(spark, sf_dir)
    stem = frozen.agg(F.min(F.lower("p_brand"))).first()[0]
    return catalog.versions(frozen, f"https://example.org/{stem}")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS f FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS f FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, CASE WHEN b.f IS NULL THEN 'missing' WHEN a.f IS NULL THEN 'orphaned' WHEN a.f <> b.f THEN 'drifted' ELSE 'same' END AS status FROM a FULL JOIN b USING (id)""")
def catalog_diff(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("fingerprint"))
    changed = orders.withColumn("fingerprint", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("fingerprint")))
    return catalog.compare(orders.filter("id % 5 <> 0"), changed.filter("id % 3 <> 0"))


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'fallback' END AS body, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS tier FROM supplier""")
def registry_chain_first_wins(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("body"))
    return catalog.chain(rows.filter("id % 2 = 0"), rows.withColumn("body", F.lit("fallback")))


@query("SELECT p_brand || '/' || p_size AS path, list(p_name ORDER BY p_partkey) AS classes FROM part GROUP BY 1 HAVING count(*) > 1")
def path_collisions(spark, sf_dir):
    written = _table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), F.col("p_name").alias("class_name"), F.col("p_partkey").alias("n"))
    return catalog.path_collisions(written)


ORACLE_SQL["path_collisions"] = "SELECT path, array_to_string(classes, ',') AS classes FROM (" + ORACLE_SQL["path_collisions"] + ")"
_collisions = QUERIES["path_collisions"]
QUERIES["path_collisions"] = lambda spark, sf_dir: _collisions(spark, sf_dir).withColumn("classes", F.array_join("classes", ","))


@query("""
WITH f AS (SELECT 'src/' || lower(p_brand) || '/' || p_size || '/' || p_partkey AS path, lower(p_brand) AS brand, p_size FROM part)
SELECT CASE WHEN p_size >= 25 AND brand <> (SELECT min(brand) FROM f) THEN brand WHEN brand = (SELECT min(brand) FROM f) THEN 'vendor' ELSE 'app' END AS owner, count(*) AS files FROM f GROUP BY 1""")
def owner_attribution(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.lower("p_brand").alias("brand"), "p_size", "p_partkey")
    files = part.select(F.concat_ws("/", F.lit("src"), "brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("path"))
    least = part.agg(F.min("brand")).first()[0]
    roots = part.filter((F.col("p_size") >= 25) & (F.col("brand") != least)).select(F.concat_ws("/", F.lit("src"), "brand", F.col("p_size").cast("string")).alias("root"), F.col("brand").alias("owner")).distinct()
    roots = roots.unionByName(spark.createDataFrame([(f"src/{least}", "vendor")], "root string, owner string"))
    return catalog.owners(files, roots)


@query("SELECT c_mktsegment AS class_name, 0 AS source FROM customer GROUP BY 1 UNION ALL SELECT DISTINCT o_orderpriority, 1 FROM orders WHERE o_orderpriority NOT IN (SELECT c_mktsegment FROM customer)")
def union_first_source(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("class_name"))
    b = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class_name"))
    return catalog.union_of_sources(a, b.unionByName(a))


@query(r"SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS origin, sha256(url)[1:16] AS tail FROM pages")
def identity_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", catalog.origin_of(F.col("url")).alias("origin"), F.regexp_extract(catalog.artifact_name(F.col("url")), r"\.([0-9a-f]{16})\.schema\.json$", 1).alias("tail"))


DROP_BALANCE = lens.Lens("customer-view", get=lambda v: F.map_filter(v, lambda k, _: k != "c_acctbal"), put=lambda v, prior, kept: F.map_concat(F.map_filter(v, lambda k, _: k != "c_acctbal"), kept), complement=lambda prior: F.map_filter(prior, lambda k, _: k == "c_acctbal"))


@query("SELECT c_custkey, c_name || '!' AS c_name, c_acctbal, true AS get_put, true AS put_get FROM customer")
def lens_asymmetric_roundtrip(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    rows = customers.select("c_custkey", p.from_frame(customers, "c_custkey", "c_name", "c_acctbal").alias("prior"))
    edited = rows.withColumn("view", F.transform_values(DROP_BALANCE.get(F.col("prior")), lambda k, x: F.when(k == "c_name", F.concat(p.text(x), F.lit("!")).cast("variant")).otherwise(x)))
    out = edited.withColumn("put", DROP_BALANCE.put_back(F.col("view"), F.col("prior")))
    return out.select("c_custkey", _text("put", "c_name"), _number("put", "c_acctbal"), DROP_BALANCE.get_put(F.col("prior")).alias("get_put"), DROP_BALANCE.put_get(F.col("view"), F.col("prior")).alias("put_get"))


@query("SELECT 'lossless' AS fidelity, count(*) AS samples, 'kept' AS lens FROM supplier UNION ALL SELECT 'lossy', count(*), 'lost' FROM supplier UNION ALL SELECT 'lossy', 0, 'none'")
def lens_certify(spark, sf_dir):
    names = ("s_suppkey", "s_acctbal")
    suppliers = _table(spark, sf_dir, "supplier")
    rows = suppliers.select(p.from_frame(suppliers, *names).alias("prior"), p.from_frame(suppliers, "s_suppkey").alias("view"))
    drop = lambda v: F.map_filter(v, lambda k, _: k != "s_acctbal")
    kept = lens.Lens("kept", get=drop, put=lambda v, prior, c: F.map_concat(v, c), complement=lambda prior: F.map_filter(prior, lambda k, _: k == "s_acctbal"))
    lost = lens.Lens("lost", get=drop)
    certified = [(kept, rows, "kept"), (lost, rows, "lost"), (kept, rows.limit(0), "none")]
    parts = [x.certify(e, "prior", "view").withColumn("lens", F.lit(name)) for x, e, name in certified]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _document(*properties: tuple[str, object]) -> object:
    """A schema document as a JSON text for each row; a property's schema is a text, or null for no property."""
    entries = [F.when(F.lit(True) if isinstance(x, str) else x.isNotNull(), F.concat(F.lit(f'"{k}":'), F.lit(x) if isinstance(x, str) else x)) for k, x in properties]
    return F.concat(F.lit('{"$id":"https://example.org/part/'), F.col("p_partkey").cast("string"), F.lit('/1","type":"object","properties":{'), F.concat_ws(",", *entries), F.lit("}}"))


@query("""
SELECT 'https://example.org/part/' || p_partkey || '/1' AS id,
  CASE p_partkey % 5 WHEN 0 THEN 'checked' WHEN 1 THEN 'refreezable' WHEN 2 THEN 'refreezable' WHEN 3 THEN 'drifted' ELSE 'unfrozen' END AS status FROM part""")
def drift_classify(spark, sf_dir):
    """A catalog of a document for each part against an edited frozen copy: every status, by key modulo 5."""
    turn = F.col("p_partkey") % 5
    part = _table(spark, sf_dir, "part")
    name, size = '{"type":"string"}', F.concat(F.lit('{"maximum":'), F.col("p_size").cast("string"), F.lit("}"))
    now = F.when(turn == 1, '{"type":"string","default":""}').when(turn == 3, '{"type":["string","null"]}').otherwise(name)
    then = F.when(turn == 2, '{"type":"string","x-optional":true}').otherwise(name)
    current = catalog.of_bodies(part.select(_document(("p_name", now), ("p_size", size)).alias("body")))
    frozen = catalog.of_bodies(part.filter(turn != 4).select(_document(("p_name", then), ("p_size", size)).alias("body")))
    return catalog.drift(current, frozen)


@query("""
WITH p AS (SELECT 'https://example.org/part/' || p_partkey || '/1' AS id, p_partkey % 4 AS t FROM part)
SELECT id, 'p_size' AS field, CASE t WHEN 0 THEN 'widened' ELSE 'changed' END AS kind, 'integer' AS "from", CASE t WHEN 0 THEN 'null,number' ELSE 'string' END AS "to", t <> 0 AS breaking FROM p WHERE t < 2
UNION ALL SELECT id, 'p_type', 'dropped', '$ref:#/$defs/t', NULL, true FROM p WHERE t = 2
UNION ALL SELECT id, 'p_brand', 'added', NULL, 'integer,null,string', false FROM p WHERE t = 3""")
def schema_diff_documents(spark, sf_dir):
    """A document for each part against its next version: what is added, dropped, widened and changed."""
    turn = F.col("p_partkey") % 4
    part = _table(spark, sf_dir, "part")
    of_type, none = '{"$ref":"#/$defs/t"}', F.lit(None).cast("string")
    new_size = F.when(turn == 0, '{"type":["number","null"]}').when(turn == 1, '{"type":"string"}').otherwise('{"type":"integer","title":"Size"}')
    old = part.select(_document(("p_size", '{"type":"integer"}'), ("p_type", of_type)).alias("body"))
    new = part.select(_document(("p_size", new_size), ("p_type", F.when(turn != 2, of_type)), ("p_brand", F.when(turn == 3, '{"anyOf":[{"type":"string"},{"type":["integer","null"]}]}').otherwise(none))).alias("body"))
    found = catalog.diff(catalog.of_bodies(old), catalog.of_bodies(new))
    return found.select("id", "field", "kind", *[F.array_join(c, ",").alias(c) for c in ("from", "to")], "breaking")


@query(None)
def schema_diff_tables(spark, sf_dir):
    """Each table's schema against the next table's: what is added, dropped, widened and changed, and whether the whole is breaking."""
    documents = {n: {"properties": {f.name.split("_", 1)[-1]: {"type": f.dataType.typeName()} for f in _table(spark, sf_dir, n).schema}} for n in TABLES}
    rows = []
    for a, b in zip(TABLES, TABLES[1:]):
        d = s.diff(documents[a], documents[b])
        rows += [(a, b, kind, x if isinstance(x, str) else x["field"], d["breaking"]) for kind in ("added", "dropped", "widened", "changed") for x in d[kind]]
    return spark.createDataFrame(rows, "old string, new string, kind string, field string, breaking boolean")


def _with_metadata(schema: T.StructType, **metadata: dict) -> T.StructType:
    """The fields that have metadata, in the table's order, required unless a key `null` says otherwise."""
    return T.StructType([T.StructField(f.name, f.dataType, metadata[f.name].get("null", False), metadata[f.name]) for f in schema if f.name in metadata])


_JSON_TYPE = "CASE WHEN column_type LIKE '%[]' THEN 'array' WHEN column_type LIKE '%INT%' THEN 'integer' WHEN column_type LIKE 'DECIMAL%' OR column_type IN ('DOUBLE', 'FLOAT') THEN 'number' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END"


@query(" UNION ALL ".join(f"SELECT '{n}' AS class_name, column_name AS property, {_JSON_TYPE} AS json_type FROM (DESCRIBE {n})" for n in TABLES))
def schema_of_tables(spark, sf_dir):
    """Each table's declared type as a schema document: one row for each property."""
    kinds = sources.of_tables(spark, sf_dir, TABLES)()
    made = projection.Projector(projection.Types(*kinds), base_uri=False)
    rows = [(k.name, name, next(t for t in ([x["type"]] if isinstance(x["type"], str) else x["type"]) if t != "null")) for k in kinds for name, x in made.document(k.name)["properties"].items()]
    return spark.createDataFrame(rows, "class_name string, property string, json_type string")


BIG = 1 << 53


@query(f"SELECT o_orderkey, o_orderkey + {BIG} AS as_int, o_orderkey + {BIG} AS as_text, CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775807 ELSE -9223372036854775808 END AS beyond FROM orders")
def cast_big_integers(spark, sf_dir):
    """Keys that doubles cannot tell apart, as numbers and as texts, and numbers that 64 bits do not hold."""
    big = F.col("o_orderkey") + F.lit(BIG)
    beyond = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("-"), F.lit("99999999999999999999"))
    cast = lambda c: F.try_variant_get(p.cast("int", c.cast("variant")), "$", "bigint")
    return _table(spark, sf_dir, "orders").select("o_orderkey", cast(big).alias("as_int"), cast(F.concat(F.lit(" "), big.cast("string"), F.lit(".9 pieces"))).alias("as_text"), cast(beyond).alias("beyond"))


@query("SELECT o_orderkey, o_orderkey = 33 OR o_orderkey >= 1001 AND o_orderkey % 2 = 0 AS accepted FROM orders")
def gate_big_integers(spark, sf_dir):
    """const, minimum and multipleOf above what doubles tell apart."""
    schema = _object({"key": {"anyOf": [{"const": BIG + 33}, {"minimum": BIG + 1001, "multipleOf": 2}]}})
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(BIG)).alias("key"))
    return _gated(rows, schema, ["o_orderkey"], "key")


@query("SELECT event_id, event_id % 3 <> 1 AS accepted FROM events")
def gate_recursive_events(spark, sf_dir):
    """Chains of events, two deep, against a schema that refers to itself: a text where a number belongs is found at any depth."""
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "next": {"$ref": "#"}}}
    inner = F.when(F.col("event_id") % 3 == 1, F.lit('"x"')).otherwise(F.col("event_id").cast("string"))
    made = F.concat(F.lit('{"n":1,"next":{"n":2,"next":{"n":'), inner, F.lit("}}}"))
    return _table(spark, sf_dir, "events").select("event_id", gate.accepts(schema, p.from_json(made)).alias("accepted"))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 5 AND 40 AND l_discount <= 0.08 AND l_returnflag IN ('A', 'N') AND length(l_linestatus) <= 1 AS accepted FROM lineitem")
def gate_declared_lineitem(spark, sf_dir):
    """The rules of a declared type, as keywords, as a gate."""
    lines = _table(spark, sf_dir, "lineitem")
    rules = {"l_quantity": [["between", 5, 40]], "l_discount": [["max", 0.08]], "l_returnflag": [["in", "A", "N"]], "l_linestatus": [["max", 1]]}
    kind = projection.RecordType("Line", _with_metadata(lines.schema, **{k: {"rules": v} for k, v in rules.items()}))
    schema = projection.Projector(projection.Types(kind)).document("Line")
    return _gated(lines, schema, ["l_orderkey", "l_linenumber"], *rules)


@query("SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AS accepted FROM supplier")
def gate_registry_supplier(spark, sf_dir):
    """A live vocabulary as the enum of a property; nations are few by definition."""
    live = lambda: [r[0] for r in _table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey").collect()]
    rows = _table(spark, sf_dir, "supplier")
    kind = projection.RecordType("Supplier", _with_metadata(rows.schema, s_nationkey={"rules": [["exists_in", "nations"]]}))
    schema = projection.Projector(projection.Types(kind, vocabularies={"nations": live})).document("Supplier")
    return _gated(rows, schema, ["s_suppkey"], "s_nationkey")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice >= 50000 WHEN 'O' THEN length(o_orderpriority) <= 6 ELSE false END AS accepted FROM orders")
def gate_union_orders(spark, sf_dir):
    """Finished orders and open ones are arms of a union, told apart by their status; others are neither."""
    rows = _table(spark, sf_dir, "orders")
    names = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    base = _with_metadata(rows.schema, o_orderstatus={})
    arm = lambda **m: _with_metadata(rows.schema, **({n: {} for n in names} | m))
    types = projection.Types(
        projection.RecordType("Order", base, union=projection.MorphUnion("o_orderstatus", {"F": "Finished", "O": "Open"}), abstract=True),
        projection.RecordType("Finished", arm(o_totalprice={"rules": [["min", 50000]]})), projection.RecordType("Open", arm(o_orderpriority={"rules": [["max", 6]]})),
    )
    schema = documents.dereference(projection.Projector(types).document("Order"))
    return _gated(rows, schema, ["o_orderkey"], *names)


@query("SELECT r AS n, 'fixture' AS name, CASE r % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind, true AS archived, 7.0::DOUBLE AS size FROM range(1000) t(r)")
def fixtures_sequence(spark, sf_dir):
    """A thousand fixtures: an example, a state, a cycling sequence and an override."""
    schema = {"properties": {"name": {"examples": ["fixture"]}, "kind": {"examples": ["x"]}, "size": {"examples": [1]}}}
    index = fixtures.Fixtures().shape("thing", schema=schema).state("thing", "isArchived", {"archived": True, "kind": "old"})
    made = index.factory("thing").state("is_archived").sequence({"kind": "a"}, {"kind": "b"}, {"kind": "c"}).count(1000).make(spark, size=7)
    return made.select("n", _text("payload", "name"), _text("payload", "kind"), F.try_variant_get(p.get(F.col("payload"), "archived"), "$", "boolean").alias("archived"), _number("payload", "size"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part that refers to one below and one above it, in chains and cycles, to a definition of its own, and, for some, to nothing known."""
    key = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("https://example.org/part/"), k.cast("string"), F.lit("/1"))
    ref = lambda k: F.concat(F.lit('{"$ref":"'), name(k), F.lit('"}'))
    parts = _table(spark, sf_dir, "part")
    body = F.concat(
        F.lit('{"$id":"'), name(key), F.lit('","properties":{"a":'), ref(F.floor(key / 3).cast("bigint")), F.lit(',"b":{"anyOf":[{"type":"null"},'), ref(key + F.when(key % 4 == 3, -3).otherwise(1)), F.lit(']},"own":{"$ref":"https://example.org/own/1"}},'),
        F.lit('"$defs":{"mine":{"$id":"https://example.org/own/1","items":'), F.when(key % 5 == 0, '{"$ref":"https://example.org/gone/1"}').otherwise('{"type":"string"}'), F.lit("}}}"),
    )
    return parts.select(name(key).alias("id"), body.alias("body"))


_CLOSURE = """
WITH RECURSIVE k AS (SELECT DISTINCT p_partkey AS k FROM part),
edges AS (SELECT k, unnest([k // 3, CASE WHEN k % 4 = 3 THEN k - 3 ELSE k + 1 END]) AS t FROM k),
reach(root, t) AS (SELECT k, t FROM edges UNION SELECT root, e.t FROM reach JOIN edges e ON e.k = reach.t)
"""
_PART = "'https://example.org/part/' || {} || '/1'"


@query(_CLOSURE + f"SELECT {_PART.format('root')} AS id, count(*) FILTER (t IN (SELECT k FROM k)) + 1 AS n_defs, bool_or(t = root) AS cyclic FROM reach GROUP BY root")
def schema_bundles(spark, sf_dir):
    """The bundles of all documents of a table: how many documents each has inside, and whether it is inside of itself."""
    documents = _linked(spark, sf_dir)
    defs = F.map_filter(p.as_map(F.try_variant_get(F.parse_json("body"), "$['$defs']", "variant")), lambda k, _: k != "mine")
    bundled = nodes.References(documents, documents).bundles()
    told = p.let(defs, lambda d: F.struct(F.size(d).cast("bigint").alias("n_defs"), F.map_contains_key(d, F.col("id")).alias("cyclic")))
    return bundled.select("id", told.alias("told")).select("id", "told.n_defs", "told.cyclic")


@query(_CLOSURE + f"""
, within AS (SELECT k AS root, k AS t FROM k UNION SELECT root, t FROM reach)
SELECT {_PART.format('root')} AS id, {_PART.format('t')} AS ref FROM reach WHERE t NOT IN (SELECT k FROM k)
UNION SELECT {_PART.format('root')}, 'https://example.org/gone/1' FROM within WHERE t % 5 = 0 AND t IN (SELECT k FROM k)""")
def schema_unresolved(spark, sf_dir):
    """What no document of the table answers, of all that each document refers to, directly or not."""
    documents = _linked(spark, sf_dir)
    return nodes.References(documents, documents).unresolved()


@query("""
SELECT 'https://example.org/part/' || p_partkey || '/1' AS id, sha256('{"properties":{"p_name":' || CASE p_partkey % 3 WHEN 0 THEN '{"type":["string","null"]}' WHEN 1 THEN '{"anyOf":[{"$ref":"#/$defs/t"},{"type":"null"}]}' ELSE '{"type":"string"}' END
  || ',"p_size":{"enum":[' || p_size || ',null],"type":["integer","null"]}},"type":"object"}') AS fingerprint FROM part""")
def schema_fingerprints(spark, sf_dir):
    """Fingerprints of a document for each part, with titles left out and `nullable` written out."""
    turn = F.col("p_partkey") % 3
    name = F.when(turn == 0, '{"nullable":true,"type":"string","title":"Name"}').when(turn == 1, '{"nullable":true,"$ref":"#/$defs/t"}').otherwise('{"nullable":false,"description":"d","type":"string"}')
    size = F.concat(F.lit('{"type":"integer","nullable":true,"enum":['), F.col("p_size").cast("string"), F.lit("]}"))
    return catalog.of_bodies(_table(spark, sf_dir, "part").select(_document(("p_size", size), ("p_name", name)).alias("body"))).select("id", "fingerprint")


@query("""
SELECT 'https://example.org/part/' || p_partkey || '/1' AS id, 'p_size' AS field, CASE p_partkey % 3 WHEN 0 THEN 'changed' ELSE 'widened' END AS kind, '$ref:#/$defs/t,integer,null,string' AS "from",
  CASE p_partkey % 3 WHEN 0 THEN '$ref:#/$defs/t,boolean,integer,null' ELSE '$ref:#/$defs/t,boolean,integer,null,string' END AS "to", p_partkey % 3 = 0 AS breaking FROM part WHERE p_partkey % 3 < 2""")
def schema_diff_unions(spark, sf_dir):
    """Unions five deep whose innermost member changes or gains a type."""
    turn = F.col("p_partkey") % 3
    part = _table(spark, sf_dir, "part")

    def document(inner) -> DataFrame:
        opened = '{"anyOf":[{"$ref":"#/$defs/t"},' + '{"anyOf":[{"type":["integer","null"]},' * 4
        return part.select(_document(("p_size", F.concat(F.lit(opened), inner, F.lit("]}" * 5)))).alias("body"))

    old, new = document(F.lit('{"type":"string"}')), document(F.when(turn == 0, '{"type":"boolean"}').when(turn == 1, '{"type":["string","boolean"]}').otherwise('{"title":"t","type":"string"}'))
    found = catalog.diff(catalog.of_bodies(old), catalog.of_bodies(new))
    return found.select("id", "field", "kind", *[F.array_join(c, ",").alias(c) for c in ("from", "to")], "breaking")


@query("""
SELECT l_orderkey, l_linenumber, (l_orderkey % 4 = 0 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000))
  AND (l_returnflag = 'N' OR l_returnflag IN (SELECT o_orderstatus FROM orders)) AS accepted FROM lineitem""")
def gate_live_vocabularies(spark, sf_dir):
    """Two vocabularies that are tables: keys of dear orders, which may be null, and statuses; a field that is missing is not checked."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("l_orderkey").cast("variant"))
    flag = F.create_map(F.lit("flag"), F.col("l_returnflag").cast("variant"))
    payload = F.map_concat(F.create_map(F.lit("order"), F.coalesce(key, p.literal(None))), F.when(F.col("l_returnflag") == "N", p.literal_map({})).otherwise(flag))
    rows = lines.select("l_orderkey", "l_linenumber", payload.alias("payload"))
    dear = vocabulary.Vocabulary("order", orders.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("value")), nullable=True)
    found = vocabulary.conforms(rows, "payload", dear, vocabulary.Vocabulary("flag", orders.select(F.col("o_orderstatus").alias("value"))), into="accepted")
    return found.select("l_orderkey", "l_linenumber", "accepted")


@query("""
SELECT 'https://example.org/part/' || p_partkey || '/1' AS id, CASE WHEN p_partkey % 3 = 0 THEN 'frozen' WHEN p_partkey % 3 = 1 THEN 'out of scope' ELSE 'frozen before' END AS action,
  CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE -1 END::BIGINT AS commit FROM part""")
def store_freeze(spark, sf_dir):
    """A document for each part: a third is frozen in a first commit, a third within the scope in a second, a third belongs to others; the second freeze runs twice."""
    part = _table(spark, sf_dir, "part")
    documents = catalog.of_bodies(part.select("p_partkey", _document(("p_size", '{"type":"integer"}')).alias("body")))
    current = documents.withColumn("owner", F.when(F.col("p_partkey") % 3 == 1, "other/package"))
    kept = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    kept.put(current.filter("p_partkey % 3 = 2"))
    frozen = kept.freeze(current)
    kept.freeze(current)
    commits = [kept.spark.read.parquet(f"{kept.folder}/commits/{n:020d}").select("id", F.lit(n).cast("bigint").alias("commit")) for n in kept.commits()]
    known = commits[0].unionByName(commits[1])
    return current.select("id").join(frozen.report, "id", "left").join(known, "id", "left").select("id", F.coalesce("action", F.lit("frozen before")).alias("action"), F.coalesce("commit", F.lit(-1)).cast("bigint").alias("commit"))


NOTED = lens.Lens("noted-view", get=DROP_BALANCE.get, put=lambda v, prior, kept: F.map_concat(F.map_filter(v, lambda k, _: ~k.isin("c_acctbal", "note")), F.coalesce(kept, p.literal_map({}))), complement=DROP_BALANCE.complement,
                  private=lambda v: F.map_filter(v, lambda k, _: k == "note"), restore=lambda v, state: F.map_concat(F.map_filter(v, lambda k, _: k != "note"), state))


@query("SELECT c_custkey, c_name || '!' AS c_name, 'n' || c_custkey AS note, c_acctbal, false AS leaked FROM customer")
def lens_private_state(spark, sf_dir):
    """Two runs: the first edits renderings that have a note of their own; the second gets the note back, and puts without a prior payload."""
    customers = _table(spark, sf_dir, "customer")
    kept = lens.Kept(NOTED, store.Log(spark, f"{shared_folder(spark)}/lens-{uuid.uuid4().hex}"))
    rows = customers.select("c_custkey", p.from_frame(customers, "c_custkey", "c_name", "c_acctbal").alias("prior"))
    edited = F.map_concat(F.transform_values(NOTED.get(F.col("prior")), lambda k, x: F.when(k == "c_name", F.concat(p.text(x), F.lit("!")).cast("variant")).otherwise(x)), F.create_map(F.lit("note"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).cast("variant")))
    first = kept.put(rows.withColumn("view", edited), "c_custkey", "view", "prior").select("c_custkey", "payload")
    second = kept.get(first, "c_custkey", "payload").withColumn("prior", F.lit(None).cast(p.MAP))
    back = kept.put(second, "c_custkey", "rendering", "prior", into="back")
    return back.select("c_custkey", _text("back", "c_name"), _text("rendering", "note"), _number("back", "c_acctbal"), p.has(F.col("payload"), "note").alias("leaked"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://other.org/x/' || p_size WHEN 1 THEN 'https://example.org/base/part/' || p_partkey || '/1' WHEN 2 THEN 'https://brands.org/' || lower(p_brand) || '/' || p_size END AS id,
  CASE p_partkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE -1 END AS grammar, p_partkey % 4 = 3 AS unresolved, p_partkey % 4 IN (0, 2) AS kept FROM part""")
def identity_resolved(spark, sf_dir):
    """References of four spellings: absolute, relative, of a grammar of their own, and of one that needs what is not declared; and whether a document keeps such an id."""
    turn, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    ref = F.when(turn == 0, F.concat(F.lit(" https://other.org/x/"), size)).when(turn == 1, F.concat(F.lit("//part/"), F.col("p_partkey").cast("string"), F.lit("/1 "))).when(turn == 2, F.concat(F.lit("brand:"), "p_brand", F.lit(":"), size)).otherwise("later:x")
    brand = identity.Grammar(lambda r: r.startswith("brand:"), lambda r, base: F.concat(F.lit("https://brands.org/"), F.lower(F.split_part(r, F.lit(":"), F.lit(2))), F.lit("/"), F.split_part(r, F.lit(":"), F.lit(3))))
    later = identity.Grammar(lambda r: r.rlike("^(later|brand):"), lambda r, base: F.lit(None).cast("string"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", identity.resolved(ref, "https://example.org/base/ ", [brand, later]).alias("r"), turn.alias("turn"))
    named = F.when(F.col("turn").isin(0, 2), F.col("r.id")).otherwise("part/1")
    document = identity.without_relative_id(F.to_variant_object(F.create_map(F.lit("$id"), named.cast("variant"), F.lit("type"), F.lit("object").cast("variant"))))
    return rows.select("p_partkey", "r.id", "r.grammar", F.col("r.problem").isNotNull().alias("unresolved"), p.has(p.as_map(document), "$id").alias("kept"))
