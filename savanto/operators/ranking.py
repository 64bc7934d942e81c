"""Ranking of experts on one network, and fusion with the rankings of others.

All operators are batched: every key carries ``query_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.functions import values as vx
from savanto.operators import cover
from savanto.operators.labels import LabelIndex
from savanto.session import written
from savanto.skew import broadcast_if_small

SUMMED_ROWS = 1 << 22  # rows that one task adds up
LISTED_WORDS = 1000  # distinct words of a batch of queries that are written into the plan; beyond, the join alone selects

# Provenance of a ranking row.
BASE, SE_MERGED, SE_ADDED, Q_MERGED, Q_ADDED = range(5)


def stemmed(queries: DataFrame) -> DataFrame:
    """Queries in the form topics are stored in."""
    return queries.select("query_id", tx.query_vector(F.col("query")).alias("query"))


def rank_users(queries: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(query_id, user_id, score, flag)``: sum of freq x cover score over all topics of a user that
    hold a query term, weighted by the log of the listed count.

    ``postings`` is the index ``(word, topic, user_id, freq)``, stored by word: the queries' words are in the
    scan's filters, so pages of others are not decoded. A topic's score does not depend on the user, so every distinct topic is scored once and the scores are joined back, each topic by one of its
    words. Postings are exchanged by user, into as many parts as the rows ask for that all queries make of
    them: a topic that most users have is spread like the others, and a task adds up a bounded number of sums.
    Of a user one task gets what holds a query term, no more rows than there are distinct topics.
    Users without a matching topic never appear (they are no candidates).
    """
    terms = cover.query_terms(stemmed(queries))
    words = terms.select(F.col("term").alias("word")).distinct()
    listed = [r["word"] for r in words.limit(LISTED_WORDS + 1).collect()]
    if len(listed) <= LISTED_WORDS:
        postings = postings.where(F.col("word").isin(listed))
    found = postings.join(broadcast_if_small(words), "word", "left_semi")
    topics = written(found.groupBy("word", "topic").agg(F.count(F.lit(1)).alias("n")), "topics-found")
    scores = written(cover.term_scores(topics, terms).select("query_id", "word", "topic", "score"), "topic-scores")
    rows = scores.join(topics, ["word", "topic"]).agg(F.sum("n")).first()[0] or 0
    parts = max(postings.sparkSession.sparkContext.defaultParallelism, -(-rows // SUMMED_ROWS))
    matched = found.repartition(parts, "user_id").join(broadcast_if_small(scores), ["word", "topic"])
    sims = matched.groupBy("query_id", "user_id").agg(F.sum(F.col("freq") * F.col("score")).alias("sim"))
    listed = profiles.select("user_id", "listed_count")
    weighted = sims.join(listed, "user_id", "left")
    return weighted.select(
        "query_id",
        "user_id",
        (F.col("sim") * vx.log_weight(F.col("listed_count"))).alias("score"),
        F.lit(BASE).alias("flag"),
    )


def topic_match(queries: DataFrame, topics: DataFrame | LabelIndex, how: str, limit: int | None = None) -> DataFrame:
    """``(query_id, topic, level, score)`` of the topics that match each query, or the first ``limit``.

    ``topics`` holds distinct labels, or is their stored index. ``how`` is ``contains`` or ``prefix``: the raw
    query, lower case and without wildcards, must occur in the label or start it. A topic without a query term
    scores nothing and drops out.

    With an index the text test finds the topics, and only these are scored; otherwise terms find them among
    all labels and the text test filters.
    """
    if isinstance(topics, LabelIndex):
        met = written(topics.lookup(queries, how), "labels-met")
        scored = cover.cover_scores(met.select("topic", "label").distinct(), queries, ["topic", "label"], "label")
        kept = scored.join(met.select("query_id", "topic"), ["query_id", "topic"])
    else:
        labelled = topics.select("topic", tx.normal_label(F.col("topic")).alias("label"))
        scored = cover.cover_scores(labelled, queries, ["topic", "label"], "label")
        raw = F.lower(F.trim(F.col("query")))
        where = F.contains(F.col("label"), raw) if how == "contains" else F.startswith(F.col("label"), raw)
        kept = scored.join(broadcast_if_small(queries), "query_id").where(where)
    if limit is not None:
        kept = cover.keep_ranked(kept, ["query_id"], "topic", limit)
    return kept.select("query_id", "topic", "level", "score")


def external_scores(
    queries: DataFrame,
    base: DataFrame,
    topic_experts: DataFrame,
    crosswalk: DataFrame,
    profiles: DataFrame,
    how: str,
    labels: LabelIndex | None = None,
) -> DataFrame:
    """``(query_id, user_id, external)``: another network's scores on the scale of the base ranking.

    ``topic_experts`` is ``(topic, expert, score)``, ``crosswalk`` ``(expert, screen_name)``. The
    text score rescales each topic's experts; minimum and maximum are taken over the rescaled
    scores; a user known under several topics keeps the highest. Queries with an empty base
    ranking get nothing.
    """
    matched = topic_match(queries, labels or topic_experts.select("topic").distinct(), how)
    rescaled = topic_experts.select("topic", "expert", F.col("score").alias("native")).join(matched, "topic")
    per_expert = rescaled.groupBy("query_id", "expert").agg(
        F.max(F.col("native") * F.col("score")).alias("high"), F.min(F.col("native") * F.col("score")).alias("low")
    )
    span = per_expert.groupBy("query_id").agg(F.min("low").alias("low_all"), F.max("high").alias("high_all"))
    base_span = base.groupBy("query_id").agg(
        F.min("score").alias("base_low"), F.max("score").alias("base_high")
    )
    spans = span.join(base_span, "query_id")  # one row per query
    linked = to_users(per_expert, crosswalk, profiles)
    scaled = linked.join(spans, "query_id").select(
        "query_id",
        "user_id",
        vx.rescale(
            F.col("high"), F.col("low_all"), F.col("high_all"), F.col("base_low"), F.col("base_high")
        ).alias("external"),
    )
    return scaled.groupBy("query_id", "user_id").agg(F.max("external").alias("external"))


def to_users(scores: DataFrame, crosswalk: DataFrame, profiles: DataFrame) -> DataFrame:
    """Two hops: expert to screen name, screen name to user id; unlinked experts drop out."""
    return scores.join(crosswalk.select("expert", "screen_name"), "expert").join(
        profiles.select("screen_name", "user_id"), "screen_name"
    )


def fuse(base: DataFrame, external: DataFrame, merged_flag: int, added_flag: int, mark: str) -> DataFrame:
    """Full outer merge, half and half where both know the user.

    The flag tells how the row came about (a later network overwrites an earlier one); ``mark``
    names a boolean column that keeps this network's contribution in any case.
    """
    both = F.col("score").isNotNull() & F.col("external").isNotNull()
    joined = base.join(external, ["query_id", "user_id"], "full")
    others = [c for c in base.columns if c not in ("query_id", "user_id", "score", "flag")]
    return joined.select(
        "query_id",
        "user_id",
        F.when(both, F.col("score") * 0.5 + F.col("external") * 0.5)
        .otherwise(F.coalesce("score", "external"))
        .alias("score"),
        F.when(both, merged_flag).when(F.col("score").isNull(), added_flag).otherwise(F.col("flag")).alias("flag"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in others],
        F.col("external").isNotNull().alias(mark),
    )


def fuse_se(base, queries, topic_experts, crosswalk, profiles, labels: LabelIndex | None = None) -> DataFrame:
    """Add the question-and-answer network: topics containing the query."""
    external = external_scores(queries, base, topic_experts, crosswalk, profiles, "contains", labels)
    return fuse(base, external, SE_MERGED, SE_ADDED, "from_se")


def fuse_q(ranking, base, queries, topic_experts, crosswalk, profiles, labels: LabelIndex | None = None) -> DataFrame:
    """Add the writers' network: topics starting with the query, on the scale of ``base``."""
    external = external_scores(queries, base, topic_experts, crosswalk, profiles, "prefix", labels)
    return fuse(ranking, external, Q_MERGED, Q_ADDED, "from_q")


def enrich_profiles(ranking: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile fields for every ranked user; users without a profile drop out."""
    fields = ["user_id", "screen_name", "name", "description", "verified"]
    if "profile_image_url" in profiles.columns:
        fields.append("profile_image_url")
    return ranking.join(profiles.select(*fields), "user_id")


def enrich_external(enriched: DataFrame, se_profiles: DataFrame, q_profiles: DataFrame) -> DataFrame:
    """External profile fields by screen name, of every network that contributed to a row.

    ``se_profiles``: screen_name, so_display_name, so_url, so_reputation; ``q_profiles``:
    screen_name, q_name, q_num_views. One row per screen name each. A network's mark tells whether it
    contributed; where the ranking has none, the flag does, which names the last network only.
    """

    def only(column: str, mark: str, *flags: int) -> Column:
        given = F.col(mark) if mark in enriched.columns else F.col("flag").isin(*flags)
        return F.when(given, F.col(column)).alias(column)

    keep = enriched.columns
    joined = enriched.join(se_profiles, "screen_name", "left").join(q_profiles, "screen_name", "left")
    return joined.select(
        *keep,
        *[only(c, "from_se", SE_MERGED, SE_ADDED) for c in ("so_display_name", "so_url", "so_reputation")],
        *[only(c, "from_q", Q_MERGED, Q_ADDED) for c in ("q_name", "q_num_views")],
        F.when(
            F.col("flag").isin(Q_MERGED, Q_ADDED) & F.col("q_name").isNotNull(),
            F.concat(F.lit("https://www.quora.com/profile/"), tx.profile_slug(F.col("q_name"))),
        ).alias("q_url"),
    )


def merge_stats(ranking: DataFrame) -> DataFrame:
    """Rows per provenance flag and query."""
    names = [(SE_MERGED, "so_merged"), (SE_ADDED, "so_added"), (Q_MERGED, "q_merged"), (Q_ADDED, "q_added")]
    return ranking.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"), *[F.count_if(F.col("flag") == f).alias(n) for f, n in names]
    )
