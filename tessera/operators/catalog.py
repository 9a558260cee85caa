"""Catalogue operators: identity, first wins, upsert, sharding, paging, decoding of packed columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import GENERATIONS
from tessera.operators.tables import stored

IDENTITY = ("asset_id", "capture", "lane", "model")


def first_wins(rows: DataFrame, keys: tuple[str, ...] = IDENTITY, position: str = "position") -> DataFrame:
    """The row of each key with the smallest position; map-side combined, so that a hot key moves little."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = IDENTITY, position: str = "position") -> DataFrame:
    """table and those rows whose key it lacks; existing rows stay as they are."""
    return table.unionByName(first_wins(rows, keys, position).join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows in range partitions of the order, each row with its partition's number in _part."""
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")


#: How values before a row combine: within a partition, over partitions, and the two of them.
_PREFIX = {
    "sum": (F.sum, lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), F.coalesce),
}


def with_prefix(rows: DataFrame, order: list[Column], how: str, value: Column, name: str) -> DataFrame:
    """rows with the sum, max, min or last value of all rows before, in an order, without a single-task window.

    Rows are range-partitioned; each partition runs its own window and takes in one value for all partitions before it, of
    which there are as many as partitions.
    """
    over, both = _PREFIX[how]
    ranged = _ranged(rows.withColumn("_value", value), order)
    w = Window.partitionBy("_part").orderBy(*order)
    own = ranged.withColumn("_own", over("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    total = F.max_by("_value", "_at") if how == "last" else over("_value")
    numbered = ranged.withColumn("_at", F.row_number().over(w)).where("_value IS NOT NULL") if how == "last" else ranged
    parts = ranged.select("_part").distinct().join(numbered.groupBy("_part").agg(total.alias("_total")), "_part", "left")
    before = parts.select("_part", over("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return own.join(before, "_part").withColumn(name, both(F.col("_own"), F.col("_before"))).drop("_value", "_own", "_before", "_part")


def synthetic_import(table: DataFrame, records: DataFrame, limit: int = 100_000, prefix: str = "synthetic:", request: Column | None = None) -> DataFrame:
    """table and the records whose identity it lacks; invented assets only, and no more than limit of them in a request, else an error.

    request numbers the requests in which records come, in order of their position; without it they are one.
    """
    sizes = records.groupBy((F.lit(0) if request is None else request).alias("request")).agg(F.count("*").alias("n"))
    if not sizes.where(F.col("n") > limit).isEmpty():
        raise ValueError("too many records")
    fit = F.when(F.col("asset_id").startswith(prefix), F.col("asset_id")).otherwise(F.raise_error(F.lit("synthetic_prefix_required")).cast("string"))
    return upsert(table, records.withColumn("asset_id", fit))


def indexed(rows: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """rows with a dense index from 0 in order of a unique column."""
    return with_prefix(rows, [F.col(order)], "sum", F.lit(1), name)


def shard_manifest(lines: DataFrame, rows_per_shard: int, index: str = "row_index", line: str = "line", pano: str = "pano_id") -> DataFrame:
    """A row per shard of consecutive lines: rows, bytes, row_start, first and last panorama, checksum.

    The checksum is that of the ordered line digests, so that no task ever holds a shard's text.
    """
    shard = F.floor(F.col(index) / rows_per_shard)
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.sha2(line, 256).alias("d")))), lambda x: x["d"]), "")
    return lines.groupBy(shard.alias("shard_id")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(line) + 1).alias("bytes"), F.min(index).alias("row_start"),
        F.min_by(pano, index).alias("first_pano"), F.max_by(pano, index).alias("last_pano"), F.sha2(digests, 256).alias("sha256"),
    )


def window_of_tail(rows: DataFrame, tail: int, skip_last: int, index: str = "row_index") -> DataFrame:
    """The last tail rows without the last skip_last ones."""
    total = rows.count()
    return rows.where((F.col(index) >= total - tail) & (F.col(index) < total - skip_last))


def decoded_flags(flags: Column) -> Column:
    """(camera_generation, road_name_state) of a packed byte: three bits of camera code, one of road name."""
    names = F.array(*map(F.lit, (*GENERATIONS, "unknown", "unknown")))
    road = F.when(flags.bitwiseAND(8) > 0, "has road name").otherwise("no road name")
    return F.struct(F.element_at(names, flags.bitwiseAND(7).cast("int") + 1).alias("camera_generation"), road.alias("road_name_state"))


def with_bad_cameras(rows: DataFrame, bad_ids: DataFrame, key: str = "location_id") -> DataFrame:
    """Rows whose id is in the set are badcam whatever their flags say."""
    bad = bad_ids.select(key).distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, key, "left").withColumn("camera_generation", F.when(F.col("_bad"), "badcam").otherwise(F.col("camera_generation"))).drop("_bad")


def bit_is_set(bytes_: Column, bit: Column) -> Column:
    """Whether a bit of a little-endian bitset is set; beyond the end it is not."""
    one = F.conv(F.substr(F.hex(bytes_), F.floor(bit / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.coalesce(F.getbit(one.cast("long"), (bit % 8).cast("int")) == 1, F.lit(False))


def page(rows: DataFrame, after: int, limit: int, key: str = "location_id") -> DataFrame:
    """One keyset page and, on each row, next_after: the last key if more rows follow, else null."""
    limit = min(500, max(1, limit))
    ahead = rows.where(F.col(key) > max(0, after)).orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)
    numbered = ahead.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("_n") <= limit, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_after", F.when(F.col("_all") > limit, last)).where(F.col("_n") <= limit).drop("_n", "_all")


def running_start(rows: DataFrame, count: str, order: str) -> DataFrame:
    """rows with start: the sum of count over the rows before."""
    return with_prefix(rows, [F.col(order)], "sum", F.col(count), "start")


def overlaps_before(ranges: DataFrame) -> DataFrame:
    """Ranges (id, start, stop) that begin before the one before them, in order of start and id, has ended."""
    return with_prefix(ranges, [F.col("start"), F.col("id")], "last", F.col("stop"), "_prior").where("start < _prior").drop("_prior")


def disjoint_ranges(official: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered ranges (id, start, stop), in order of start and id, that overlap neither official ones nor accepted ones.

    Ranges are not empty. An offered one goes if an official one that starts no later ends after its start, or the next
    one starts before its end: two running values. The others fall into islands of ranges that touch through one another;
    an island's ranges are accepted in order, as a stream that remembers one end, so islands run in parallel and none is held.
    """
    both = official.select(F.lit(None).cast("long").alias("id"), "start", "stop").unionByName(offered.select("id", "start", "stop")).withColumn("_official", F.col("id").isNull())
    up = [F.col("start"), F.col("_official").desc(), F.col("id")]
    ended = with_prefix(both, up, "max", F.when(F.col("_official"), F.col("stop")), "_ended")
    down = [F.col("start").desc(), F.col("_official"), F.col("id").desc()]
    begun = with_prefix(ended, down, "min", F.when(F.col("_official"), F.col("start")), "_next")
    free = begun.where(~F.col("_official") & ~F.coalesce(F.col("_ended") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("_next") < F.col("stop"), F.lit(False))).select("id", "start", "stop")
    order = [F.col("start"), F.col("id")]
    edge = with_prefix(free, order, "max", F.col("stop"), "_reach").withColumn("_new", F.coalesce(F.col("start") >= F.col("_reach"), F.lit(True)).cast("long"))
    islands = with_prefix(edge.select("id", "start", "stop", "_new"), order, "sum", F.col("_new"), "_islands").withColumn("island", F.col("_islands") + F.col("_new"))

    def accept(batches):
        island, end = None, None
        for batch in batches:
            keep = []
            for number, start, stop in zip(*(batch.column(c).to_pylist() for c in ("island", "start", "stop")), strict=True):
                if number != island:
                    island, end = number, None
                keep.append(end is None or start >= end)
                if keep[-1]:
                    end = stop
            yield batch.select(["id", "start", "stop"]).filter(pa.array(keep, pa.bool_()))

    ordered = islands.select("island", "id", "start", "stop").repartition("island").sortWithinPartitions("island", "start", "id")
    return ordered.mapInArrow(accept, "id long, start long, stop long")


def replaced_lane(table: DataFrame, rows: DataFrame, lane: str) -> DataFrame:
    """table with the rows of one lane replaced; rows of another lane among the new ones are an error."""
    fit = F.when(F.col("lane") == lane, F.col("lane")).otherwise(F.raise_error(F.lit("a row of another lane")).cast("string"))
    return table.where(~F.col("lane").eqNullSafe(lane)).unionByName(rows.withColumn("lane", fit).select(*table.columns))


def with_first_tag(rows: DataFrame, names: DataFrame, key: str = "location_id", tags: str = "tags", name: str = "country") -> DataFrame:
    """(key, name): the first non-empty name of a row's tags, or an empty text; names (tag, name) is a table of any size."""
    each = rows.select(key, F.posexplode_outer(tags).alias("_place", "tag"))
    named = each.join(names.where(F.col("name") != "").select("tag", "name"), "tag", "left")
    return named.groupBy(key).agg(F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("_place"))), F.lit("")).alias(name))
