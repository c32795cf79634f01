"""What each filter removes, wherever it stands in the order of the filters.

Every document gets a mask with one bit for each filter that it fails. All later work is
on counts of equal (part, mask, labels), so the texts are read once. A recursive query
lists the orders: it starts from the empty prefix and every mask, adds each letter that
the prefix does not hold, and carries the bits that were applied; each level of the
recursion gives that step's outcome for each mask. Its size is fixed by the filters: 120
orders of five steps over 32 masks. Joined to the counts it gives the metrics.

The last filter fails a text that a smaller id has too. Texts are told apart by SHA-256,
and a text's documents are counted by (text, id) first, so that a text that fills a third
of the table leaves one row for each id and label before it is gathered.

Defined results: a null text is an empty one and a null part is the empty string; a row
without an id has no labels, is no copy and is nobody's smaller id; rows with equal ids
are judged each for itself and none is the copy of another one; several label rows of one
id count as quality 1 or toxic 1 where any says so; parts without a document have no rows,
so an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
LETTERS = "ABCDE"
BLANKS = " \t\n\x0b\f\r"


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: few words, few distinct words, many capitals, a symbol."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    some = trimmed != ""
    n = F.when(some, F.size(words)).otherwise(0).cast("long")
    distinct = F.when(some, F.size(F.array_distinct(words))).otherwise(0).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failing = [
        n < MIN_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))


def mask_cells(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Documents counted by ``part``, ``mask``, ``good`` and ``toxic``, as ``n``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
        text_failures(text).alias("mask"),
    )
    rows = rows.groupBy("text_key", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id find no labels; their own key spreads them.
    rows = rows.withColumn(
        "label_key",
        F.coalesce(
            F.concat(F.lit("id "), F.col("id").cast("string")),
            F.concat(F.lit("text "), F.hex("text_key")),
        ),
    )
    judged = labels.groupBy(F.concat(F.lit("id "), F.col(id_col).cast("string")).alias("label_key"))
    judged = judged.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    rows = rows.join(judged, "label_key", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")}
    )
    known = F.col("id").isNotNull()
    held = rows.groupBy("text_key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_known"),
        F.min(F.when(known, F.struct("id", "n"))).alias("first"),
    )
    # A text's cells are few: its parts by its labels.
    least = F.min("first.id").over(Window.partitionBy("text_key"))
    stays = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = held.withColumn("least", least).withColumn("copies", F.col("n_known") - stays)
    split = F.array(
        F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")),
    )
    cells = copies.select("part", "good", "toxic", F.inline(split))
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


ORDERS = """
WITH RECURSIVE steps(prefix, step, letter, own, before, applied, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, 0, mask
  FROM (SELECT explode(sequence(0, {masks} - 1)) AS mask)
  UNION ALL
  SELECT /*+ BROADCAST(f) */ concat(s.prefix, f.letter), s.step + 1, f.letter, f.bit,
         s.applied, s.applied | f.bit, s.mask
  FROM steps s JOIN (VALUES {filters}) AS f(letter, bit) ON (s.applied & f.bit) = 0),
outcomes AS (
  SELECT prefix, step, letter, mask,
    CAST((applied & mask) = 0 AS INT) AS kept,
    CAST((own & mask) <> 0 AND (before & mask) = 0 AS INT) AS removed,
    CAST((own & mask) <> 0 AND (before & mask) <> 0 AS INT) AS redundant,
    CAST(own = mask AS INT) AS unique_fails
  FROM steps WHERE step > 0)
SELECT o.prefix AS filter_order, s.step, s.letter, s.mask, s.kept, s.removed, s.redundant,
       s.unique_fails
FROM outcomes o JOIN outcomes s ON o.mask = s.mask AND startswith(o.prefix, s.prefix)
WHERE o.step = {last}
"""


def order_outcomes(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """What each step of each order does with each mask, as 0 and 1."""
    filters = ", ".join(f"('{letter}', {1 << k})" for k, letter in enumerate(letters))
    return spark.sql(
        ORDERS.format(masks=1 << len(letters), filters=filters, last=len(letters))
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Counts for every part, order of the filters and step.

    Columns: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley`` (what the step's filter
    removes, summed over all orders).
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    # 120 orders, five steps and 32 masks: 19,200 rows whatever the tables hold.
    outcomes = F.broadcast(order_outcomes(docs.sparkSession))
    counted = cells.join(outcomes, "mask").groupBy("part", "filter_order", "step", "letter")

    def count(flag: str, *also: str) -> Column:
        product = F.col("n") * F.col(flag)
        for other in also:
            product *= F.col(other)
        return F.sum(product)

    metrics = counted.agg(
        *[count(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        count("removed", "good").alias("good_lost"),
        count("removed", "toxic").alias("toxic_lost"),
    )
    # The 120 orders of a part and filter.
    own = Window.partitionBy("part", "letter")
    return metrics.withColumn("shapley", F.sum("removed").over(own)).drop("letter")
