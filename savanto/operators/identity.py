"""Linking accounts of one person across networks, and the tables built from the links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.functions import values as vx
from savanto.functions.similarity import jaro_winkler, may_reach
from savanto.operators import upsert
from savanto.session import written
from savanto.skew import broadcast_if_small, hot_keys, replicate_for_salts, salt_rows

# Decision thresholds.
NAME_ABOVE = 0.80
SIGNATURE_BELOW = 0.50
# Rows of a search key that go to one part, about.
COMMON = 10_000


def name_blocks(name: Column) -> Column:
    """Search keys of a name: its words and the whole name, lower case, letters and digits only."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.concat(words, F.array(F.array_join(words, ""))))


def candidate_pairs(sources: DataFrame, accounts: DataFrame, compare: str = "name") -> DataFrame:
    """Every source row with the accounts that share any of its search keys.

    ``sources`` and ``accounts``: id, name, location, signature, blocks; ``compare`` names the column of
    ``accounts`` that is held against the source's name. A pair is formed at the first key the two share
    only. No key is too common to be looked up: the rows of a common one are dealt to parts on both sides,
    and the parts are paired. The names go along, so that a test of them alone runs before the other
    columns are joined.
    """
    asked = sources.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"), F.col("blocks").alias("src_blocks"), F.explode("blocks").alias("block"))
    keyed = accounts.select(F.col("id").alias("match_id"), F.col(compare).alias("match_name"), F.col("blocks").alias("match_blocks"), F.explode("blocks").alias("block"))
    # at most one row for every COMMON rows; broadcast only if that is little
    common_asked, common_keyed = (broadcast_if_small(written(hot_keys(df, "block", COMMON), "common-words")) for df in (asked, keyed))
    asked = salt_rows(asked, common_asked, "block", "src_id").withColumnRenamed("salt", "src_part")
    asked = replicate_for_salts(asked, common_keyed, "block").withColumnRenamed("salt", "match_part")
    keyed = salt_rows(keyed, common_keyed, "block", "match_id").withColumnRenamed("salt", "match_part")
    keyed = replicate_for_salts(keyed, common_asked, "block").withColumnRenamed("salt", "src_part")
    first = F.array_intersect("src_blocks", "match_blocks")[0] == F.col("block")
    met = asked.join(keyed, ["block", "src_part", "match_part"]).where(first).select("src_id", "src_name", "match_id", "match_name")
    left = sources.select(
        F.col("id").alias("src_id"),
        F.col("location").alias("src_location"),
        F.col("signature").alias("src_signature"),
    )
    right = accounts.select(
        F.col("id").alias("match_id"),
        F.col("location").alias("match_location"),
        F.col("signature").alias("match_signature"),
    )
    return met.join(left, "src_id").join(right, "match_id")


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that pass the name and the signature test; location similarity is only reported.

    The cheap tests come first: letters in common, then the distance of the signatures.
    """
    likely = pairs.where(may_reach("src_name", "match_name", NAME_ABOVE))
    seen = likely.withColumn(
        "distance", vx.signature_distance(F.col("src_signature"), F.col("match_signature"))
    ).where(F.col("distance") < SIGNATURE_BELOW)
    named = seen.withColumn("name_sim", jaro_winkler("src_name", "match_name")).where(F.col("name_sim") > NAME_ABOVE)
    return named.select(
        "src_id",
        "match_id",
        "name_sim",
        "distance",
        F.coalesce(jaro_winkler("src_location", "match_location"), F.lit(0.0)).alias("location_sim"),
    )


def fuzzy_match(sources: DataFrame, accounts: DataFrame, compare: str = "name") -> DataFrame:
    """``(src_id, match_id, name_sim, distance, location_sim)`` for sources with exactly one match,
    counted over all their candidates."""
    scored = scored_pairs(candidate_pairs(sources, accounts, compare))
    only = scored.groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("match_id", "name_sim", "distance", "location_sim")).alias("m"),
    )
    return only.where(F.col("n") == 1).select("src_id", "m.*")


@dataclass(frozen=True)
class Linking:
    """One direction of linking: which column of the candidates the source's name is held against, and
    which of their fields the source takes over, under which prefix."""

    name: str
    compare: str
    prefix: str
    fields: tuple[str, ...]


SE_TO_TWITTER = Linking("stackexchange_to_twitter", "screen_name", "twitter_", ("id", "screen_name", "name"))
Q_TO_TWITTER = Linking("quora_to_twitter", "screen_name", "twitter_", ("id", "screen_name", "name"))
TWITTER_TO_SE = Linking("twitter_to_stackexchange", "name", "so_", ("id", "name", "location"))


def link_accounts(linking: Linking, sources: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Every source record, with the prefixed fields of its linked account if exactly one was found, and
    the time of the try. A source without a match keeps such fields as it has."""
    found = fuzzy_match(sources, accounts, linking.compare).select(F.col("src_id").alias("id"), "match_id")
    fields = accounts.select(F.col("id").alias("match_id"), *[F.col(f).alias(linking.prefix + f) for f in linking.fields])
    record = sources.drop("blocks", "signature")
    for name in fields.columns[1:]:
        if name not in record.columns:
            record = record.withColumn(name, F.lit(None).cast(fields.schema[name].dataType))
    merged = upsert.merge_fields(record, found.join(fields, "match_id").drop("match_id"), "id")
    return merged.withColumn("direction", F.lit(linking.name)).withColumn("last_crawled", now)


def count_matched(experts: DataFrame) -> DataFrame:
    """Experts and linked experts per network; ``experts``: network, expert, screen_name (may be NULL)."""
    return experts.groupBy("network").agg(
        F.count(F.lit(1)).alias("experts"), F.count("screen_name").alias("matched")
    )


def matched_experts(experts: DataFrame) -> DataFrame:
    """The set of linked experts."""
    return experts.where(F.col("screen_name").isNotNull()).select("network", "expert").distinct()


def combine_users(experts: DataFrame) -> DataFrame:
    """``(network, username, field, value)``: the crosswalk, both ways.

    Usernames keep their site, so that equal names on two sites do not collide. Where several
    experts claim one account the greatest name is kept.
    """
    linked = experts.where(F.col("screen_name").isNotNull())
    there = linked.select("network", F.col("expert").alias("username"), F.lit("screen_name").alias("field"),
                          F.col("screen_name").alias("value"))
    field = F.when(F.col("network") == "stackexchange", F.lit("so_display_name")).otherwise(F.lit("quora_name"))
    back = linked.select(F.lit("twitter").alias("network"), F.col("screen_name").alias("username"),
                         field.alias("field"), F.col("expert").alias("value"))
    return there.unionByName(back).groupBy("network", "username", "field").agg(F.max("value").alias("value"))


def combine_topics(se_topics: DataFrame, q_topics: DataFrame, experts: DataFrame) -> DataFrame:
    """One leaderboard ``(network, topic, expert, score)`` of the linked experts of both networks.

    Inputs: network, topic, expert, score, ts. Topics of the writers' network are lower-cased.
    """
    lowered = q_topics.withColumn("topic", F.lower("topic"))
    rows = se_topics.unionByName(lowered).join(matched_experts(experts), ["network", "expert"], "left_semi")
    return upsert.zset_last_wins(rows, ["network", "topic", "expert"], "score", "ts")


def refresh_profiles(profiles: DataFrame, fetched: DataFrame, leaderboard: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Upsert fetched profiles of the accounts linked to any leaderboard expert."""
    experts = leaderboard.select("expert").distinct().join(crosswalk, "expert").select("screen_name").distinct()
    new = fetched.join(experts, "screen_name", "left_semi")
    stamp = F.lit(0)
    return upsert.upsert_latest(
        profiles.withColumn("__ts", stamp), new.withColumn("__ts", stamp + 1), ["user_id"], "__ts"
    ).drop("__ts")


def near_words(tokens: DataFrame, above: float = 0.8) -> DataFrame:
    """``(token, token_2, similarity)``: words of one vector text that look alike but differ.

    ``tokens``: list_id, tokens. Pairs are formed inside one list text only, then made distinct.
    """
    rows = tokens.select(F.posexplode(F.array_distinct("tokens")).alias("i", "token"), F.col("tokens").alias("all"))
    pairs = rows.select("token", F.explode("all").alias("token_2")).where(F.col("token") < F.col("token_2"))
    likely = pairs.distinct().where(may_reach("token", "token_2", above))
    scored = likely.withColumn("similarity", jaro_winkler("token", "token_2"))
    return scored.where((F.col("similarity") > above) & (F.col("similarity") < 1.0))


def tier_weights(rows: DataFrame) -> DataFrame:
    """``(user_id, score)``: mean of the network scores weighted by the user's share of activity.

    ``rows``: user_id, network, score, activity.
    """
    total = F.sum("activity")
    return rows.groupBy("user_id").agg(
        F.try_divide(F.sum(F.col("score") * F.col("activity")), total).alias("score")
    )

