"""Sharding by Hilbert-curve order, with DataFrame functions only.

Several metadata columns are quantised into 2^bits cells each, by cut points that are quantiles over all rows (strings: by
their whole values), the cell's index along the Hilbert curve is computed once for each cell that has rows, rows are sorted by it and the
sorted rows are cut into runs, the shards. Neighbours on the curve are neighbours in every dimension, so a shard spans a narrow range of
each and a reader that filters on some of them skips most files by their min-max statistics.

The law that holds is ``rows``: shards' counts are at most one apart. A row's place in the whole order is its
place in its part of a cell plus the rows of all earlier parts. Cells are split by a hash of id, size and checksum into parts of
``part_rows`` rows or more, and parts that equal rows fill once more by the rows' places, so that a cell or an id with most rows is ordered
by many tasks; the table of parts has at most 2^(bits * dimensions) + 2 * 65,536 rows, which bounds what is broadcast and what one task sums.

Cases: null texts have no bytes (and size 8, checksum 0), null or missing metadata sort in the first cell; rows with the same id are
ordered by checksum, then size, and equal rows by chance, with no effect on the result; an empty table gives an empty result; other
columns are ignored by ``shard_rows`` and kept by ``write_shards``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import checkpointed, unused

#: Rows of a part of a cell, unless there would be over 65,536 parts.
PART_ROWS = 20_000
MOST_PARTS = 65_536


def _is_text(frame: DataFrame, name: str) -> bool:
    return isinstance(frame.schema[name].dataType, T.StringType)


def text_cuts(frame: DataFrame, name: str, bits: int) -> list[str]:
    """At most 2^bits - 1 rising strings that cut the rows into near equal parts, by whole values of any length.

    Rows are counted by value first; the values are dealt by ranges, each task adds up its own, and the running share of all rows gives the cuts.
    """
    values = frame.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    # computed once: the ranges are drawn from a sample
    dealt = checkpointed(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("in_part")).withColumn("earlier", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    total = sums.agg(F.sum("in_part").alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("earlier")
    places = dealt.join(sums, "part").crossJoin(total).withColumn("upto", upto)
    # the cell that a value's last row falls in
    step = F.ceil(F.col("upto") * (1 << bits) / F.col("total")).cast("int")
    ends = places.groupBy(step.alias("step")).agg(F.max("v").alias("v")).filter(F.col("step") < (1 << bits))
    return sorted({r.v for r in ends.select("v").collect()}, key=lambda v: v.encode("utf-8", "surrogatepass"))


def cut_points(frame: DataFrame, dimensions: list[str], bits: int) -> dict[str, list]:
    """For each dimension, at most 2^bits - 1 rising values that cut its rows into near equal parts."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dimensions if not _is_text(frame, d)]
    row = frame.agg(*(F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numbers)).first() if numbers else {}
    return {d: text_cuts(frame, d, bits) if d not in numbers else sorted(set(row[d] or [])) for d in dimensions}


def cell(value: Column, cuts: list) -> Column:
    """How many cut points are below the value; 0 for null."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)), F.lit(0)).cast("int")


def _step(exchange, i: int, q: int):
    return lambda state: exchange(state, i, q)


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The index along the Hilbert curve of a point with integer coordinates of so many bits.

    The transpose form: from the highest bit down, what the lower bits mean is inverted or exchanged by each coordinate's bit;
    then the coordinates are Gray-coded and their bits interleaved.
    """
    n = len(coordinates)

    def bit(state: Column, i: int, q: int) -> Column:
        return F.shiftright(state[f"x{i}"], q.bit_length() - 1).bitwiseAND(1) == 1

    def exchange(state: Column, i: int, q: int) -> Column:
        x0, xi, low = state["x0"], state[f"x{i}"], q - 1
        other = x0.bitwiseXOR(xi).bitwiseAND(low)
        one = F.when(bit(state, i, q), x0.bitwiseXOR(low)).otherwise(x0.bitwiseXOR(other))
        two = xi if i == 0 else F.when(bit(state, i, q), xi).otherwise(xi.bitwiseXOR(other))
        fields = [one.alias("x0"), *((two if k == i else state[f"x{k}"]).alias(f"x{k}") for k in range(1, n))]
        return F.struct(*fields)

    def then(state: Column, step) -> Column:
        """The step's result, with the state computed once: a lambda over an array of one."""
        return F.transform(F.array(state), step)[0]

    state = F.struct(*(c.cast("int").alias(f"x{i}") for i, c in enumerate(coordinates)))
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            state = then(state, _step(exchange, i, 1 << b))

    def gray(s: Column) -> Column:
        xs = [s["x0"]]
        for i in range(1, n):
            xs.append(s[f"x{i}"].bitwiseXOR(xs[-1]))
        t = reduce(lambda t, q: t.bitwiseXOR(F.when(F.shiftright(xs[-1], q).bitwiseAND(1) == 1, (1 << q) - 1).otherwise(0)), range(bits - 1, 0, -1), F.lit(0))
        xs = [x.bitwiseXOR(t) for x in xs]
        parts = [F.shiftleft(F.shiftright(x, b).bitwiseAND(1).cast("long"), b * n + n - 1 - i) for b in range(bits) for i, x in enumerate(xs)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return then(state, gray)


def with_curve(frame: DataFrame, dimensions: list[str], bits: int, name: str = "curve", cuts: dict | None = None) -> DataFrame:
    """The frame with the curve index of each row."""
    return frame.withColumn(name, hilbert_index(_cells(frame, dimensions, bits, cuts), bits))


def _cells(frame: DataFrame, dimensions: list[str], bits: int, cuts: dict | None) -> list[Column]:
    cuts = cuts if cuts is not None else cut_points(frame, dimensions, bits)
    return [cell(F.col(d) if _is_text(frame, d) else F.col(d).cast("double"), cuts[d]) for d in dimensions]


def _placed(rows: DataFrame, shards: int, dimensions: list[str], bits: int, cuts: dict | None) -> DataFrame:
    """Rows (id, size, crc, the dimensions, and any others whose names begin with ``all``) with shard, slot and curve."""
    at = _cells(rows, dimensions, bits, cuts)
    packed = F.lit(0)
    for i, c in enumerate(at):
        packed = packed + F.shiftleft(c, i * bits)
    rows = rows.select("id", "size", "crc", *(c for c in rows.columns if c.startswith("all")), packed.alias("cell"))

    # the curve of each cell that has rows, at most 2^(bits * dimensions), and its parts
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    part_rows = max(PART_ROWS, -(-total // MOST_PARTS))
    back = [F.shiftright("cell", i * bits).bitwiseAND((1 << bits) - 1) for i in range(len(at))]
    curve = hilbert_index(back, bits) if at else F.lit(0).cast("long")
    split = cells.select("cell", curve.alias("curve"), F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "size", "crc"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(split), "cell").withColumn("part", part).drop("parts", "cell")

    # parts that rows with one id, size and checksum fill are split by the rows' places; each has twice part_rows at least
    sizes = rows.groupBy("curve", "part").agg(F.count("*").alias("n"))
    full = sizes.filter(F.col("n") > 2 * part_rows).select("curve", "part", F.ceil(F.col("n") / part_rows).cast("int").alias("turns"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(full), ["curve", "part"], "left")
    turn = F.pmod(F.xxhash64("row"), F.coalesce("turns", F.lit(1))).cast("int")
    rows = rows.withColumn("turn", turn).drop("row", "turns")

    key = ["curve", "part", "turn"]
    before = Window.partitionBy(F.lit(0)).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*key).orderBy("id", "crc", "size")
    placed = rows.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(offsets), key)
    placed = placed.withColumn("place", (F.col("offset") + F.col("place")).cast("long"))
    # shard s takes the places from ceil(s N / shards) on
    placed = placed.withColumn("shard", F.expr(f"CAST((place * {shards}L) DIV {max(total, 1)}L AS INT)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) DIV {shards}L")
    return placed.withColumn("slot", (F.col("place") - first).cast("long")).drop("offset", "place", "part", "turn")


def _measured(docs: DataFrame, id_column: str, text_column: str, dimensions: tuple[str, ...]) -> tuple[list[Column], list[str]]:
    """The columns that rows are placed by, and the dimensions that there are."""
    text, present = docs[text_column].cast("string"), [d for d in dimensions if d in docs.columns]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return [docs[id_column].alias("id"), size.alias("size"), crc.alias("crc"), *(docs[d].alias(f"d_{d}") for d in present)], present


def shard_rows(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    bits: int = 4,
    cuts: dict | None = None,
) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve."""
    columns, present = _measured(docs, id_column, text_column, dimensions)
    # texts are read once
    slim = checkpointed(docs.select(*columns))
    named = {f"d_{d}": cuts.get(d) for d in present} if cuts is not None else None
    placed = _placed(slim, shards, [f"d_{d}" for d in present], bits, named)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none, "curve")


def write_shards(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text", dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, cuts: dict | None = None, files: int | None = None) -> None:
    """Writes the documents with all columns, one folder for each shard, each in files of rising slots, so that no task has to hold a shard.

    ``files``: how many ranges of (shard, slot) are written, one task each (as a rule, as Spark shuffles). Rows go with their places, so ids may repeat."""
    columns, present = _measured(docs, id_column, text_column, dimensions)
    rows = docs.select(*columns, F.struct(*(docs[c] for c in docs.columns)).alias("all"))
    placed = _placed(rows, shards, [f"d_{d}" for d in present], bits, {f"d_{d}": cuts.get(d) for d in present} if cuts is not None else None)
    shard = unused(docs, "_shard")
    order = ["shard", "slot"]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).select("all.*", F.col("shard").alias(shard))
    out.write.partitionBy(shard).parquet(path)
