"""Queries of the problems 3, 5, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.clusters import describe_clusters, similarity_clusters
from tracksmith.llm.leaks import leaked_items
from tracksmith.llm.runs import collapse_runs
from tracksmith.llm.tokens import encode_corpus
from tracksmith.llm.unify import same_looking_classes, same_looking_pairs, unified_forms
from tracksmith.plans.preparation import POSITIONS, apart, records
from tracksmith.sources.tables import table


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of stay records at one place, with count and duration."""
    stays = records(spark, folder).where(F.col("is_stay") & F.col("pos").isNotNull())
    runs = collapse_runs(stays, "user_id", F.coalesce("date", "datetime"), "id", F.col("pos.lat"), F.col("pos.lon"), within=5.0)
    return runs.select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_runs(spark, folder).drop("n")


def _venues(spark: SparkSession, folder: str, split: bool) -> dict[str, DataFrame]:
    return similarity_clusters(records(spark, folder).where("is_stay"), "id", F.col("pos.lat"), F.col("pos.lon"), F.col("place"), reach=100.0, least=3, split=split)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _venues(spark, folder, False)["members"].select("id", "cluster_id")


def p5_venues(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical record of each venue, loose ones split around their densest spots."""
    return describe_clusters(_venues(spark, folder, True)["cells"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", 13)


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every document's form, and whether it is blank."""
    forms = unified_forms(table(spark, folder, "documents"), "doc_id", "text")
    return forms.select("doc_id", F.lower(F.hex("form")).alias("form_md5"), "blank")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_looking_pairs(unified_forms(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each document that looks like one of another spelling, with the number of its links."""
    return same_looking_classes(unified_forms(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


QUERIES = {"p3_found": p3_found, "p3_runs": p3_runs, "p5_found": p5_found, "p5_venues": p5_venues, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_classes": p10_classes, "p10_forms": p10_forms}

_RUNS = (
    POSITIONS
    + """, ev as (select user_id, id, la, lo, epoch_us(coalesce("date", datetime)) t from pos where is_stay and la is not null and user_id is not null),
nx as (select *, lag(la) over w pa, lag(lo) over w po from ev window w as (partition by user_id order by t, id)),
ch as (select *, case when """
    + apart("pa", "po", "la", "lo")
    + """ <= 5 then 0 else 1 end c from nx), ru as (select *, sum(c) over (partition by user_id order by t, id) r from ch)
select user_id, min(t) // 1000000 as start_s, max(t) // 1000000 as end_s"""
)

SQL: dict[str, str] = {
    "p3_found": _RUNS + " from ru group by user_id, r having count(*) >= 2",
    "p3_runs": _RUNS + ", count(*) as n from ru group by user_id, r having count(*) >= 2",
}
