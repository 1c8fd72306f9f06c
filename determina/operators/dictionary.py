"""Dictionary encoding: words to dense ids, cells to ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from determina.functions import cells
from determina.operators.checks import is_fixed_width
from determina.operators.tables import vocabulary
from determina.sources.staging import stage

# monotonically_increasing_id() holds the partition above these bits and the row
# within the partition below them.
_ROW_BITS = 33

# A word with more than this part of all cells is looked up by broadcast, if it is short.
FREQUENT = 10_000
FREQUENT_BYTES = 256

# Bytes of one column's different values up to which they are broadcast.
MOST_BYTES = 4 << 20


def build_dictionary(df: DataFrame) -> DataFrame:
    """``word STRING, n BIGINT, id BIGINT``: ids ``0 .. size-1`` in word order.

    The words are range-partitioned and sorted, numbered within each partition, and
    shifted by the size of the partitions before it. Only one count per partition
    meets in a single task. The numbered words are staged so that the partition sizes
    and the words are of one and the same partitioning.
    """
    row = F.monotonically_increasing_id()
    numbered = stage(
        vocabulary(df)
        .repartitionByRange("word")
        .sortWithinPartitions("word")
        .select(
            "word",
            "n",
            F.shiftright(row, _ROW_BITS).cast("int").alias("part"),
            row.bitwiseAND((1 << _ROW_BITS) - 1).alias("pos"),
        ),
        "numbered-words",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    # One row per shuffle partition: bounded by the session's partition setting.
    return numbered.join(F.broadcast(offsets), "part").select(
        "word", "n", (F.col("pos") + F.col("offset")).alias("id")
    )


def frequent_words(dictionary: DataFrame) -> DataFrame:
    """``word, id`` of the words that are more than one in ``FREQUENT`` of all cells, without
    those of more than ``FREQUENT_BYTES``: less than ``FREQUENT`` rows, as a local table."""
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    short = F.coalesce(F.octet_length("word"), F.lit(0)) <= FREQUENT_BYTES
    rows = dictionary.where((F.col("n") * FREQUENT > total) & short).select("word", "id")
    return dictionary.sparkSession.createDataFrame(rows.toArrow(), "word string, id bigint")


def encode(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every cell replaced by its id; a missing cell finds the missing word, and one that is in no
    word's place is null. ``dictionary(word, n, id)``.

    Frequent words are found where the rows are, by broadcast. Rows are staged with the ids found
    and the cells still open; those alone meet the rest of the dictionary, in one join for all
    columns, and return to the row numbers that were staged.
    """
    names = df.columns
    frequent = frequent_words(dictionary)
    rows = df.select([cells.quoted(n).cast("string").alias(f"cell{i}") for i, n in enumerate(names)])
    for i in range(len(names)):
        known = frequent.select(F.col("word").alias("word"), F.col("id").alias(f"id{i}"))
        rows = rows.join(F.broadcast(known), F.col(f"cell{i}").eqNullSafe(F.col("word")), "left").drop("word")
    missed = [
        F.when(F.col(f"id{i}").isNull(), F.struct(F.lit(i).alias("at"), F.col(f"cell{i}").alias("cell")))
        for i in range(len(names))
    ]
    ids = [f"id{i}" for i in range(len(names))]
    rows = stage(
        rows.select(F.monotonically_increasing_id().alias("row"), *ids, F.array_compact(F.array(*missed)).alias("open")),
        "half-encoded",
    )
    found = (
        rows.select("row", F.inline("open"))
        .join(dictionary.select("word", "id"), F.col("cell").eqNullSafe(F.col("word")))
        .groupBy("row")
        .agg(*[F.max(F.when(F.col("at") == i, F.col("id"))).alias(f"late{i}") for i in range(len(names))])
    )
    whole = rows.join(found, "row", "left")
    return whole.select([F.coalesce(f"id{i}", f"late{i}").alias(n) for i, n in enumerate(names)])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def encode_short_columns(df: DataFrame, sizes: dict[str, int], limit: int) -> DataFrame:
    """Texts of columns with at most ``limit`` different values replaced by numbers,
    column by column; the other columns as they are.

    ``sizes`` has the number of different values of the columns to look at. The values
    of one column are what is broadcast: no more than ``limit`` rows, and no more than
    ``MOST_BYTES`` of them; columns with longer values stay as they are. So do columns
    with maps, which have no order to number them in.
    """
    out = df
    for name, n in sizes.items():
        kind = df.schema[name].dataType
        if n > limit or is_fixed_width(kind) or _has_map(kind):
            continue
        value = cells.quoted(name)
        wide = F.coalesce(F.octet_length(value.cast("string")), F.lit(0)).cast("bigint")
        if (df.select(value).distinct().agg(F.sum(wide)).head()[0] or 0) > MOST_BYTES:
            continue
        words = df.select(value.alias("_word")).distinct().orderBy("_word").toArrow().column(0)
        if len(words) > limit:
            raise ValueError(f"{name} has {len(words)} values, {n} were announced")
        ids = pa.table([words, pa.array(range(len(words)), pa.int64())], names=["_word", "_id"])
        table = df.sparkSession.createDataFrame(
            ids, T.StructType([T.StructField("_word", df.schema[name].dataType),
                               T.StructField("_id", T.LongType())])
        )
        out = (
            out.join(F.broadcast(table), value.eqNullSafe(F.col("_word")), "left")
            .withColumn(name, F.col("_id"))
            .select([cells.quoted(c) for c in df.columns])
        )
    return out
