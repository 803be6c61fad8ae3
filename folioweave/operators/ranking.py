"""Rankings and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import overlap as O


def settled(total: Column) -> Column:
    """A sum to 12 significant digits: what tells equal sums apart that were added in another order is no difference."""
    return F.when(total.isNotNull(), F.format_string("%.11e", total.cast("double")).cast("double"))


def serial_sum(value: str, group: list[str], order: list[str]) -> Column:
    """Sum over the group, on each of its rows, added row by row in the order given, as one pass over the rows adds it.

    So it has the same bits wherever the rows lie. A group is in one task for that, which spills what it can't hold.
    """
    return F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def by_sum(total: str, serial: bool) -> Column:
    """What sums are ranked by: serial ones as they are, others settled."""
    return F.col(total) if serial else settled(F.col(total))


def ranked(rows: DataFrame, group: list[str], score: str | Column, ties: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place in the group by falling score; ties go by the columns given."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *ties)))


def top(rows: DataFrame, group: list[str], score: str | Column, ties: list[str], k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each group, all for k < 0."""
    placed = ranked(rows, group, score, ties, name)
    return placed if k < 0 else placed.where(F.col(name) <= k)


def gold_ranking(docs: DataFrame) -> DataFrame:
    """docs (id, doc, is_gold, score, pos) with rank and rel: gold first in their order at 1.0, the others by score."""
    rel = F.when(F.col("is_gold"), F.lit(1.0)).otherwise(F.col("score"))
    by = Window.partitionBy("id").orderBy(F.desc("is_gold"), F.when(~F.col("is_gold"), -F.col("score")), "pos")
    return docs.withColumns({"rel": rel, "rank": F.row_number().over(by)})


def ranking_metrics(placed: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """id, dcg, idcg, ndcg, precision_compat, recall_compat, mrr_compat, precision, recall, mrr at k.

    placed: id, doc, rank; ideal: id, doc, rank, rel, is_gold. The *_compat columns take every document of the ideal
    ranking as relevant, so ndcg may exceed 1 where scores do, and mrr_compat is nearly always 1; the others take gold
    documents. Gains are rel / log2(rank + 1).
    """
    gain = lambda rank, rel: F.when(rank <= k, rel / F.log2(rank + 1)).otherwise(0.0)
    both = placed.select("id", "doc", F.col("rank").alias("_p")).join(ideal.select("id", "doc", F.col("rank").alias("_i"), "rel", "is_gold"), ["id", "doc"], "full")
    p, i, gold = F.col("_p"), F.col("_i"), F.coalesce(F.col("is_gold"), F.lit(False))
    hit, good = (p <= k) & i.isNotNull(), (p <= k) & gold
    sums = both.groupBy("id").agg(
        F.sum(F.when(p.isNotNull() & i.isNotNull(), gain(p, F.col("rel"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(i.isNotNull(), gain(i, F.col("rel"))).otherwise(0.0)).alias("idcg"),
        (F.count_if(hit) / F.lit(float(k))).alias("precision_compat"),
        (F.count_if(hit) / F.greatest(F.count("_i"), F.lit(1))).alias("recall_compat"),
        F.coalesce(1.0 / F.min(F.when(i.isNotNull(), p)), F.lit(0.0)).alias("mrr_compat"),
        (F.count_if(good) / F.lit(float(k))).alias("precision"),
        (F.count_if(good) / F.greatest(F.count_if(gold), F.lit(1))).alias("recall"),
        F.coalesce(1.0 / F.min(F.when(gold, p)), F.lit(0.0)).alias("mrr"),
    )
    return sums.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0))


def shared_gold_scores(queries: DataFrame, found: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, precision, recall, f1 of each query's items against the gold set of its group; 0 if either is empty.

    queries: query_id, group; found: query_id, item; gold: group, item; repeats count once. The sets meet by joins on
    group and item and are counted, so a group's gold set may be of any size.
    """
    gold = gold.select("group", "item").distinct()
    sizes = gold.groupBy("group").agg(F.count("*").alias("_gold"))
    said = found.select("query_id", "item").distinct().join(queries, "query_id")
    hits = said.join(gold.withColumn("_hit", F.lit(1)), ["group", "item"], "left").groupBy("query_id").agg(F.count("*").alias("_said"), F.count("_hit").alias("_same"))
    n = lambda c: F.coalesce(c, F.lit(0))
    of = queries.join(sizes, "group", "left").join(hits, "query_id", "left")
    both = of.select("query_id", O.ratio(n("_same"), n("_said")).alias("precision"), O.ratio(n("_same"), n("_gold")).alias("recall"))
    return both.withColumn("f1", O.f1_of(F.col("precision"), F.col("recall")))
