"""The models of the bundled test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern.sources.models import Database, Model, Registry


def registry() -> Registry:
    r = Registry()
    r.add(Model("Region", "region", ("r_regionkey",), {"r_regionkey": "int", "r_name": "string"}))
    r.add(Model("Nation", "nation", ("n_nationkey",), {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}))
    r.add(Model("Customer", "customer", ("c_custkey",), {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}))
    r.add(Model("Supplier", "supplier", ("s_suppkey",), {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}))
    r.add(Model("Part", "part", ("p_partkey",), {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}))
    r.add(Model("Order", "orders", ("o_orderkey",), {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}))
    r.add(Model("Lineitem", "lineitem", ("l_orderkey", "l_linenumber")))
    r.add(Model("Event", "events", ("event_id",), {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}, json=("props",)))
    r.add(Model("Document", "documents", ("doc_id",)))
    r.add(Model("Embedding", "embeddings", ("vec_id",)))
    r.add(Model("Page", "pages", ("page_id",)))
    r.add(Model("Item", "benchmark", ("item_id",)))
    r.add(Model("Label", "labels", ("doc_id",)))
    r.add(Model("Turn", "conversations", ("conv_id", "turn")))
    r.foreign_key("Nation", "region", "Region", "n_regionkey", "nations")
    r.foreign_key("Customer", "nation", "Nation", "c_nationkey", "customers")
    r.foreign_key("Supplier", "nation", "Nation", "s_nationkey", "suppliers")
    r.foreign_key("Order", "customer", "Customer", "o_custkey", "orders")
    r.foreign_key("Lineitem", "order", "Order", "l_orderkey", "lines")
    r.foreign_key("Lineitem", "part", "Part", "l_partkey", "lines")
    r.foreign_key("Lineitem", "supplier", "Supplier", "l_suppkey", "lines")
    r.foreign_key("Event", "user", "Customer", "user_id", "events")
    r.foreign_key("Label", "document", "Document", "doc_id", "label", unique=True)
    r.many_to_many("Part", "suppliers", "Supplier", "lineitem", "l_partkey", "l_suppkey", "parts")
    return r


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, registry(), sf_dir)
