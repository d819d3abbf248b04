"""Nested records to flat child tables, from Arrow's list offsets.

Text columns that hold JSON become nested columns in the JVM first. Then each record batch is flattened a level at a time:
a list column's offsets give its children's values in one buffer and each child's parent row; keys follow by take. No row
is visited in Python.

Nulls, empty lists and JSON that can't be read give no children; an entry without its child key gives no row but keeps its
position. Repeated rows are one; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.tables import load

LINKS = "link_kind string, parent_key string, child_pos bigint, child_key string"


def json_value(c: Column) -> Column:
    """The variant that a JSON text holds, also where the text is a JSON string of the JSON text; null if it can't be read."""
    outer = F.try_parse_json(c)
    return F.when(F.ltrim(c).startswith('"'), F.try_parse_json(F.try_variant_get(outer, "$", "string"))).otherwise(outer)


def path_entries(c: Column) -> Column:
    return F.try_variant_get(json_value(c), "$", "array<string>")


def children(lists: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(values, parent row, position in the parent's list) of a list column; the last tells which parents are null."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
    position = np.arange(len(parent), dtype=np.int64) - first[parent]
    return pc.list_flatten(lists), parent, position


def _ids(a: pa.Array) -> pa.Array:
    a = pc.if_else(pc.match_substring_regex(a, "^[0-9A-Fa-f]{64}$"), pc.utf8_lower(a), a)
    return pc.if_else(pc.equal(a, ""), pa.scalar(None, pa.string()), a)


def _hexes(a: pa.Array) -> pa.Array:
    return pc.if_else(pc.match_substring_regex(a, "^(?:[0-9A-Fa-f]{2}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6})$"), pc.utf8_lower(a), pa.scalar(None, pa.string()))


def _rows(kind: str, parent: pa.Array, position: np.ndarray, child: pa.Array) -> pa.RecordBatch:
    keep = pc.and_(child.is_valid(), parent.is_valid())
    columns = [pa.repeat(pa.scalar(kind), len(child)), parent, pa.array(position, pa.int64()), child]
    return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["link_kind", "parent_key", "child_pos", "child_key"])


def flatten_packets(batches):
    """Batches of (id string, receptions list<struct<observer_id, path list<string>>>, advert, legs list<string>)."""
    for b in batches:
        ids = b.column("id")
        receptions, parent, position = children(b.column("receptions"))
        key = ids.take(pa.array(parent))
        yield _rows("reception", key, position, _ids(receptions.field("observer_id")))
        below = pc.binary_join_element_wise(key, pc.cast(pa.array(position), pa.string()), "/")
        hops, of, at = children(receptions.field("path"))
        yield _rows("hop", below.take(pa.array(of)), at, _hexes(hops))
        advert = b.column("advert")
        yield _rows("advert", ids, np.zeros(len(ids), np.int64), advert)
        legs, parent, position = children(b.column("legs"))
        yield _rows("leg", ids.take(pa.array(parent)), position, pc.if_else(pc.equal(legs, ""), pa.scalar(None, pa.string()), legs))


def flatten_cells(batches):
    """Batches of (cell string, sources list<string>)."""
    for b in batches:
        sources, parent, position = children(b.column("sources"))
        sources = pc.if_else(pc.equal(sources, ""), pa.scalar(None, pa.string()), sources)
        yield _rows("cell_source", b.column("cell").take(pa.array(parent)), position, sources)


def nested_packets(packets: DataFrame) -> DataFrame:
    """Packets with their JSON texts as nested columns, as flatten_packets takes them."""
    path = lambda parsed, text: F.coalesce(parsed, path_entries(text))
    own = F.array(F.struct(F.col("observer_id"), path(F.col("parsed_path"), F.col("path_json")).alias("path")))
    each = F.transform(
        F.filter("observations", lambda o: F.lit(True)),
        lambda o: F.struct(o["observer_id"].alias("observer_id"), path(o["parsed_path"], o["path_json"]).alias("path")),
    )
    decoded = packets.withColumn("__v", json_value(F.col("decoded_json")))
    hop = lambda x: F.try_variant_get(x, "$.hop", "string")
    legs_at = lambda at: F.coalesce(
        F.transform(F.try_variant_get("__v", at, "array<variant>"), hop),
        F.when(F.try_variant_get("__v", at + ".hop", "string").isNotNull(), F.array(F.try_variant_get("__v", at + ".hop", "string"))),
    )
    key = F.try_variant_get("__v", "$.pubKey", "string")
    return decoded.select(
        F.col("id").cast("string").alias("id"),
        F.when(F.size("observations") > 0, each).otherwise(own).alias("receptions"),
        F.when((F.col("payload_type") == 4) & key.rlike("^[0-9A-Fa-f]{64}$"), F.lower(key)).alias("advert"),
        F.coalesce(legs_at("$.legs"), legs_at("$.trace.legs")).alias("legs"),
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: link_kind, parent_key, child_pos, child_key."""
    packets = nested_packets(load(spark, sf_dir, "packets")).mapInArrow(flatten_packets, LINKS)
    cells = load(spark, sf_dir, "coverage").select(
        F.concat_ws("/", "job_id", F.col("index").cast("string")).alias("cell"), F.transform("sources", lambda s: s["source_id"]).alias("sources")
    )
    return packets.unionByName(cells.mapInArrow(flatten_cells, LINKS)).distinct()
