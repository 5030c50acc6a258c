"""K-d tree sharding of a corpus by bytes (operator 8, DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import free_names, number_rows, stored

#: Bins of one histogram pass over a node's widest dimension.
BINS = 1024
#: A cut may miss its weight by this part of a leaf's target bytes.
TOLERANCE = 0.002
#: Passes after which a cut is as sharp as its keys: each narrows the range BINS times.
MOST_PASSES = 7
#: Rows numbered by one task within a shard.
SLOT_ROWS = 50_000
#: Fixed size of a row besides its text.
ROW_BYTES = 16


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _position(value: Column, row: Column) -> Column:
    """A dimension as a 62-bit key: 31 bits of the value, then 31 bits that tell rows of one value apart."""
    return F.shiftleft(value.cast("long"), 31) + F.shiftrightunsigned(row, 33)


def _leaf(node: dict) -> Column:
    """The first leaf below a row's node, by the cuts made so far."""
    if "left" not in node:
        return F.lit(node["first"])
    return F.when(F.col("dims")[node["dim"]] > node["cut"], _leaf(node["right"])).otherwise(_leaf(node["left"]))


def _narrow(node: dict, sums: list[tuple[int, int]], miss: float) -> None:
    """Cuts the node at the edge of a bin if that misses its weight by `miss` at most, else goes on within the bin."""
    width, run = (node["hi"] - node["lo"]) // BINS + 1, node["below"]
    for i, w in sums:
        if run + w < node["want"]:
            run += w
            continue
        before, after = node["want"] - run, run + w - node["want"]
        if min(before, after) <= miss or width == 1:
            node["cut"] = node["lo"] + (i + (after <= before)) * width - 1
        else:
            node |= {"lo": node["lo"] + i * width, "hi": node["lo"] + (i + 1) * width - 1, "below": run}
        return
    node["cut"] = node["hi"]


def kd_shards(
    docs: DataFrame, *, shards: int, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), tolerance: float = TOLERANCE
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): leaves of a k-d tree over metadata, near equal in bytes.

    A row per row of docs.
    Dimensions are the size, the id, and the categories by their hash.  A node of n leaves is split n // 2 to the rest
    at the weighted quantile of its widest dimension, width counting as the part of the whole table's range, so rows
    with like metadata meet.  Rows of one value are told apart by a hash of the id, the text and the row's number in a
    stored table, so a hot value is split too, and so are rows that are equal.  A quantile comes from histograms of BINS bins, pass after pass, for all nodes of a level at once, until the
    cut is within `tolerance` of a leaf's bytes.  The driver sees only BINS sums a node.  Slots number a shard's
    rows from 0 without gaps.

    size is the text's UTF-8 bytes (null: none) plus ROW_BYTES.  Null ids and categories count as the smallest value.
    The sizes of shards differ by the largest row at most plus the tolerance.  An empty table gives an empty result; with fewer rows than shards some stay empty.
    Other columns are not read.
    """
    return _placed(docs, shards, id_col, text_col, categories, tolerance).drop("number")


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, categories: tuple[str, ...], tolerance: float, number: str | None = None) -> DataFrame:
    """kd_shards' rows with number, that of the column `number` or one of its own."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    head = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_size(F.col(f"`{text_col}`")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("like"), (F.col(number) if number else F.monotonically_increasing_id()).alias("number"),
        *[F.shiftrightunsigned(F.xxhash64(F.col(f"`{c}`")), 34).alias(f"c{i}") for i, c in enumerate(categories) if c in docs.columns],
    )
    head = stored(head, "heads").withColumn("row", F.xxhash64("like", "number")).drop("like")
    cats = [c for c in head.columns if c[0] == "c" and c[1:].isdigit()]
    lo_id, hi_id, hi_size, total, rows = head.agg(F.min("doc_id"), F.max("doc_id"), F.max("size"), F.sum("size"), F.count(F.lit(1))).first()
    span = max(1, (hi_id or 0) - (lo_id or 0))
    by_id = F.floor(F.coalesce((F.col("doc_id") - F.lit(lo_id or 0)).cast("double"), F.lit(0.0)) / span * (2**30 - 1))
    by_size = F.floor(F.log2(F.col("size").cast("double")) / max(1.0, len(bin(hi_size or 1)) - 2.0) * (2**30 - 1))
    dims = [_position(by_size, F.col("row")), _position(by_id, F.col("row")), *[_position(F.col(c), F.col("row")) for c in cats]]
    state = head.select("doc_id", "size", "text_crc32", "row", "number", F.array(*dims).alias("dims"))
    leaf_bytes = max(1, (total or 0) / shards)
    tree: dict = {"first": 0, "leaves": shards}
    level, wide = [tree] if shards > 1 and rows else [], None
    while level:
        at = {node["first"]: node for node in level}
        located = state.select("size", "dims", _leaf(tree).alias("node"))
        low, high = ([f(F.col("dims")[i]).alias(f"{p}{i}") for i in range(len(dims))] for p, f in (("lo", F.min), ("hi", F.max)))
        stats = located.where(F.col("node").isin(list(at))).groupBy("node").agg(F.sum("size").alias("w"), *low, *high).collect()  # a row a node
        if wide is None:
            wide = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(len(dims))]
        for s in stats:
            node = at[s["node"]]
            d = max(range(len(dims)), key=lambda i: (s[f"hi{i}"] - s[f"lo{i}"]) / wide[i])
            node |= {"dim": d, "lo": s[f"lo{d}"], "hi": s[f"hi{d}"], "below": 0, "want": s["w"] * (node["leaves"] // 2) / node["leaves"]}
        level = [node for node in level if "dim" in node]  # the others have no rows
        for _ in range(MOST_PASSES):
            todo = [node for node in level if "cut" not in node]
            if not todo:
                break
            ask = number_rows(spark, [(n["first"], n["dim"], n["lo"], (n["hi"] - n["lo"]) // BINS + 1) for n in todo], "node int, dim int, lo long, step long")
            # at most one row a shard, so its size is bound whatever the input
            key = F.expr("(element_at(dims, dim + 1) - lo) div step").alias("bin")
            sums = located.join(F.broadcast(ask), "node").select("node", "size", key).where(F.col("bin").between(0, BINS - 1)).groupBy("node", "bin").agg(F.sum("size")).collect()
            for node in todo:
                _narrow(node, sorted((i, w) for k, i, w in sums if k == node["first"]), tolerance * leaf_bytes)
        for node in level:
            half = node["leaves"] // 2
            node["left"] = {"first": node["first"], "leaves": half}
            node["right"] = {"first": node["first"] + half, "leaves": node["leaves"] - half}
        level = [child for node in level for child in (node["left"], node["right"]) if child["leaves"] > 1]
    state = state.withColumn("node", _leaf(tree))

    placed = state.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), "row", "number")
    parts = max(1, -(-(rows or 0) // (shards * SLOT_ROWS)))
    placed = stored(placed.withColumn("part", F.pmod(F.col("row"), F.lit(parts)).cast("int")), "placed")
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    """placed with slots: each part of a shard goes on where the parts before it end."""
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for every SLOT_ROWS rows
    offsets = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "row", "number"))
    joined = placed.withColumn("nth", nth).join(offsets, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), "number")


def write_shards(
    docs: DataFrame, path: str, *, shards: int, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), tolerance: float = TOLERANCE
) -> DataFrame:
    """Writes docs as Parquet under path/shard=N, each row in its own shard, and returns kd_shards' placement of them.

    Rows are stored with a number first, so that rows with one id, or equal ones, go where the placement says.  A column
    `shard` that docs has is replaced.
    """
    number, at = free_names(docs, "number", "at")
    rows = stored(docs.drop("shard").withColumn(number, F.monotonically_increasing_id()), "numbered")
    placement = stored(_placed(rows, shards, id_col, text_col, categories, tolerance, number), "placement")
    where = placement.select(F.col("number").alias(at), "shard")
    rows.join(where, F.col(number) == F.col(at)).drop(number, at).write.partitionBy("shard").parquet(path)
    return placement.drop("number")
