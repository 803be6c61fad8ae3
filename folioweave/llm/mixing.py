"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.shared import BLANKS, SharedTables

#: Digits of the 15 hexadecimal hash digits that each histogram level adds.
LEVELS = (3, 6, 10, 15)


def word_count(text: str) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text; null counts 0. One pass, no array of words."""
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(inner, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def mix_hash(doc_id: str, text: str, seed: str = "") -> Column:
    """15 hexadecimal digits that decide a document's place; equal rows share one place."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed), F.coalesce(F.col(text), F.lit(""))]
    return F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15)


def measure(docs: DataFrame, seed: str = "") -> DataFrame:
    """docs with size (words) and place (hash). Columns of these names are replaced."""
    return docs.withColumns({"size": word_count("text"), "place": mix_hash("doc_id", "text", seed)})


def source_targets(measured: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row per source: source, source_size, budget (whole words), target.

    Sources stand by code point, null last, and take the weights in turn. The targets share all sizes by weight; none
    exceeds cap times its source's size. Sources are filled in order of cap * size / weight: the first k are full, for
    the smallest k at which the next one's share of what remains is within its cap. Integers until the last division.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    return measured.sparkSession.sql(
        """
        WITH turns AS (
          SELECT source, source_size, source_size * :cap AS full, source IS NULL AS none,
                 CAST(element_at(:weights, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % size(:weights) + 1 AS INT)) AS BIGINT) AS w
          FROM {sizes}),
        shares AS (
          SELECT *, sum(source_size) OVER () - coalesce(sum(full) OVER (ORDER BY full / w, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
                 sum(w) OVER (ORDER BY full / w, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
          FROM turns),
        open AS (
          SELECT *, first(CASE WHEN w * num <= full * den THEN struct(num, den) END, true)
                      OVER (ORDER BY full / w, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
          FROM shares)
        SELECT source, source_size, coalesce((w * s.num) div s.den, full) AS budget,
               coalesce(CAST(w * s.num AS DOUBLE) / CAST(s.den AS DOUBLE), CAST(full AS DOUBLE)) AS target
        FROM open
        """,
        sizes=sizes,
        args={"cap": cap, "weights": F.array(*[F.lit(w) for w in weights])},
    )


def cuts(measured: DataFrame, tables: SharedTables, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row per source: source, source_size, target, copies, cut, within, of.

    Every document is taken copies times; those with a place below cut once more. The place at the cut takes `within`
    words out of the `of` words that its documents have. Nested thresholds: the first histogram sums sizes by source
    and 3 hash digits; each further level reads only the boundary bucket of each source, by more digits.
    """
    targets = tables.write(source_targets(measured, weights, cap), "targets")
    at = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).alias("copies"),
        F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(0).alias("within"),
        F.lit("").alias("cut"), F.lit(0).cast("long").alias("of"),
    )
    known = 0
    for digits in LEVELS:
        edge = at.select(F.col("source").alias("_source"), F.col("cut").alias("_cut"))
        inside = measured.select("source", "size", "place").where("size > 0").join(
            edge, F.col("source").eqNullSafe(F.col("_source")) & (F.substring("place", 1, known) == F.col("_cut"))
        ) if known else measured.where("size > 0")
        buckets = inside.groupBy("source", F.substring("place", 1, digits).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = buckets.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "_source")
        found = at.join(sums, F.col("source").eqNullSafe(F.col("_source"))).where(
            "upto > within AND upto - words <= within"
        )
        at = tables.write(
            found.select(
                "source", "source_size", "target", "copies", (F.col("within") - F.col("upto") + F.col("words")).alias("within"),
                F.col("bucket").alias("cut"), F.col("words").alias("of"),
            ),
            "cuts",
        )
        known = digits
    # a source without words has no bucket
    return at.union(
        targets.where("source_size = 0").select(
            "source", "source_size", "target", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(""), F.lit(0).cast("long")
        )
    )


def apply_cuts(measured: DataFrame, cut_table: DataFrame) -> DataFrame:
    """measured with source_size, target and taken, the words that the mix takes of the document.

    A place below its source's cut is taken whole once more, the place at the cut in part (equal rows in equal parts),
    so that each source comes within a word per equal row of its target. Columns of these names are replaced. The join
    has a row per source on its right side; Spark broadcasts it only under its size threshold.
    """
    right = cut_table.select([F.col(c).alias(f"_{c}") for c in cut_table.columns])
    part = F.expr("CAST(CAST(size AS DECIMAL(38,0)) * _within div greatest(_of, 1) AS BIGINT)")
    extra = F.when(F.col("place") < F.col("_cut"), F.col("size")).when(F.col("place") == F.col("_cut"), part).otherwise(0)
    return (
        measured.drop("source_size", "target", "taken")
        .join(right, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("source_size", F.col("_source_size"))
        .withColumn("target", F.col("_target"))
        .withColumn("taken", (F.col("size") * F.col("_copies") + extra).cast("long"))
        .drop(*right.columns)
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "") -> DataFrame:
    """docs with size, place, source_size, target and taken.

    Null text and text without words have size 0 and take no part (taken 0). Null is a source of its own, last in
    order. Rows with equal doc_id and text share a place and are treated alike. An empty table gives an empty result.
    """
    tables = SharedTables(docs.sparkSession)
    slim = tables.write(measure(docs, seed).select("source", "size", "place"), "sizes")
    return apply_cuts(measure(docs, seed), cuts(slim, tables, weights, cap))


def expand_mix(mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with copy (from 1) and taken (words of this copy)."""
    copies = F.expr("CAST((taken + size - 1) div size AS INT)")
    return (
        mixed.where("taken > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        .withColumn("taken", F.least(F.col("size"), F.col("taken") - F.col("size") * (F.col("copy") - 1)))
    )
