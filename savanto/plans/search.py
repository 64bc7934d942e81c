"""Expert search: rank, fuse other networks, add profiles, count provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savanto.operators import ranking
from savanto.operators.labels import LabelIndex
from savanto.session import cut_lineage


@dataclass(frozen=True)
class Sources:
    """Stored tables a search reads."""

    postings: DataFrame  # word, topic, user_id, freq
    profiles: DataFrame  # user_id, screen_name, name, description, verified, listed_count
    se_topic_experts: DataFrame  # topic, expert, score
    q_topic_experts: DataFrame  # topic, expert, score
    crosswalk: DataFrame  # expert, screen_name
    se_profiles: DataFrame | None = None
    q_profiles: DataFrame | None = None
    se_labels: LabelIndex | None = None  # stored labels of the topics of either network
    q_labels: LabelIndex | None = None


def rank(queries: DataFrame, src: Sources, include_se: bool = False, include_q: bool = False) -> DataFrame:
    """``(query_id, user_id, score, flag[, from_se][, from_q])`` for a batch of queries.

    Both networks are rescaled to the base ranking, which is therefore stored once.
    """
    base = ranking.rank_users(queries, src.postings, src.profiles)
    if not (include_se or include_q):
        return base
    base = cut_lineage(base)
    out = base
    if include_se:
        out = ranking.fuse_se(base, queries, src.se_topic_experts, src.crosswalk, src.profiles, src.se_labels)
    if include_q:
        out = ranking.fuse_q(out, base, queries, src.q_topic_experts, src.crosswalk, src.profiles, src.q_labels)
    return out


def search(queries: DataFrame, src: Sources, include_se: bool = True, include_q: bool = True) -> DataFrame:
    """Ranked profiles with external fields, best first within each query."""
    rows = ranking.enrich_profiles(rank(queries, src, include_se, include_q), src.profiles)
    if src.se_profiles is not None and src.q_profiles is not None:
        rows = ranking.enrich_external(rows, src.se_profiles, src.q_profiles)
    return rows.orderBy("query_id", F.desc("score"), "user_id")


def best(ranked: DataFrame, per_query: int) -> DataFrame:
    """The first users of each query with their place."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "user_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_query)
