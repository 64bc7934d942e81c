"""Queries over question-and-answer sites: stored questions, answers, tags, badges and accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savanto.operators.paging import top_per_group
from savanto.skew import broadcast_if_small

SORTS = {"activity": "last_activity", "views": "view_count", "creation": "creation_date", "votes": "score"}


# ---- dereferencing ----


def deref(rows: DataFrame, target: DataFrame, key: str, target_key: str) -> DataFrame:
    """Follow a foreign key; rows without a target stay. ``target_key`` is unique."""
    return rows.join(target.withColumnRenamed(target_key, key), key, "left")


def typed_deref(events: DataFrame, targets: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """Follow ``ref`` into a different table by ``type``; at most one ``value`` comes back.

    ``targets`` maps a label to the event types it serves and a ``(ref, value)`` table with unique refs.
    """
    out = events
    for label, (types, table) in targets.items():
        side = table.select(F.col("ref").alias(f"__{label}"), F.col("value").alias(f"v_{label}"))
        # the type is part of the condition: rows of other types keep their key and stay spread out
        match = (F.col("ref") == F.col(f"__{label}")) & F.col("type").isin(types)
        out = out.join(side, match, "left").drop(f"__{label}")
    found = F.coalesce(*[F.col(f"v_{label}") for label in targets])
    return out.withColumn("value", found).drop(*[f"v_{label}" for label in targets])


def canonical_tags(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Replace ``tag`` by its master tag; ``synonyms``: from_tag, to_tag."""
    masters = synonyms.select(F.col("from_tag").alias("tag"), "to_tag")
    return rows.join(masters, "tag", "left").withColumn("tag", F.coalesce("to_tag", "tag")).drop("to_tag")


# ---- tags ----


def tag_counts(post_tags: DataFrame) -> DataFrame:
    return post_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def related_tags(post_tags: DataFrame, tag: str) -> DataFrame:
    """Tags used together with the given one, with the number of posts."""
    posts = post_tags.where(F.col("tag") == tag).select("post_id")
    others = post_tags.where(F.col("tag") != tag).join(posts, "post_id", "left_semi")
    return others.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def related_posts(post_tags: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """``(post_id, related_id, shared)``: for the asked posts, others with most tags in common."""
    wanted = post_tags.join(asked.select("post_id"), "post_id", "left_semi")
    met = wanted.join(post_tags.withColumnRenamed("post_id", "related_id"), "tag")
    met = met.where(F.col("post_id") != F.col("related_id"))
    shared = met.groupBy("post_id", "related_id").agg(F.count(F.lit(1)).alias("shared"))
    return top_per_group(shared, ["post_id"], [F.desc("shared"), F.col("related_id")], k).drop("place")


def linked_posts(links: DataFrame, posts: DataFrame, asked: DataFrame) -> DataFrame:
    """Posts the asked posts link to; ``links``: post_id, linked_id."""
    targets = links.join(asked.select("post_id"), "post_id", "left_semi").select("linked_id").distinct()
    return posts.join(targets.withColumnRenamed("linked_id", "post_id"), "post_id", "left_semi")


def user_tag_stats(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per user and tag: number and score of questions and answers. Inputs: user_id, tag, score."""
    rows = questions.select("user_id", "tag", "score", F.lit("q").alias("kind")).unionByName(
        answers.select("user_id", "tag", "score", F.lit("a").alias("kind"))
    )
    is_q, is_a = F.col("kind") == "q", F.col("kind") == "a"
    return rows.groupBy("user_id", "tag").agg(
        F.count_if(is_q).alias("question_count"),
        F.coalesce(F.sum(F.when(is_q, F.col("score"))), F.lit(0)).alias("question_score"),
        F.count_if(is_a).alias("answer_count"),
        F.coalesce(F.sum(F.when(is_a, F.col("score"))), F.lit(0)).alias("answer_score"),
    )


def top_tags(stats: DataFrame, by: str) -> DataFrame:
    """Each user's best tag by ``answer_score`` (experience) or ``question_score`` (curiosity)."""
    return stats.groupBy("user_id").agg(F.max_by("tag", F.struct(by, "tag")).alias("tag"))


# ---- users ----


def in_period(rows: DataFrame, ts: str, period: str, now: Column) -> DataFrame:
    """All rows, or those of the month before ``now``."""
    if period == "all-time":
        return rows
    if period == "month":
        return rows.where((F.col(ts) >= now - F.expr("INTERVAL 1 MONTH")) & (F.col(ts) <= now))
    raise ValueError(f"unknown period {period}")


def top_users(posts: DataFrame, k: int) -> DataFrame:
    """Top answerers (or askers) of every tag: ``(tag, user_id, score, post_count, place)``.

    ``posts``: tag, user_id, score. Scores are summed before anything is ordered.
    """
    totals = posts.groupBy("tag", "user_id").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("post_count")
    )
    return top_per_group(totals, ["tag"], [F.desc("score"), F.col("user_id")], k)


def users_named(users: DataFrame, part: str, column: str = "name") -> DataFrame:
    """Users whose name contains a text, in any case."""
    return users.where(F.contains(F.lower(column), F.lit(part.lower())))


def top_in_tag(posts: DataFrame, k: int) -> DataFrame:
    """Each user's best posts within a tag. ``posts``: tag, user_id, post_id, score."""
    return top_per_group(posts, ["user_id", "tag"], [F.desc("score"), F.col("post_id")], k)


def experts_per_tag(posts: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """Leaderboard ``(topic, expert, score)`` of the top answerers that have a linked account."""
    best = top_users(posts, k).select(F.col("tag").alias("topic"), F.col("user_id").alias("expert"), "score")
    return best.join(matched.select("expert"), "expert", "left_semi")


def privileges_of(users: DataFrame, privileges: DataFrame) -> DataFrame:
    """Every privilege a user's reputation suffices for: ``(user_id, reputation, privilege)``.

    Both sides meet on powers of two by an equality join, never row against row.
    """

    def bucket(c: Column) -> Column:
        return F.floor(F.log2(F.greatest(c.cast("double"), F.lit(1.0)))).cast("int")

    reach = users.select("user_id", "reputation", F.explode(F.sequence(F.lit(0), bucket(F.col("reputation")))).alias("b"))
    need = privileges.select(
        F.col("short_description").alias("privilege"), F.col("reputation").alias("need"), bucket(F.col("reputation")).alias("b")
    )
    return reach.join(broadcast_if_small(need), "b").where("need <= reputation").select("user_id", "reputation", "privilege")


def versus(reputations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(user_1, user_2, site, winner, margin)`` per site of either user, and overall (site NULL).

    ``reputations``: user_id, site, reputation. The first user wins a draw.
    """
    one = pairs.join(reputations.withColumnsRenamed({"user_id": "user_1", "reputation": "r1"}), "user_1")
    two = pairs.join(reputations.withColumnsRenamed({"user_id": "user_2", "reputation": "r2"}), "user_2")
    zero = F.lit(0).cast("bigint")
    rows = one.select("user_1", "user_2", "site", "r1", zero.alias("r2")).unionByName(
        two.select("user_1", "user_2", "site", zero.alias("r1"), "r2")
    )
    per_site = rows.groupBy("user_1", "user_2", "site").agg(F.sum("r1").alias("r1"), F.sum("r2").alias("r2"))
    overall = per_site.groupBy("user_1", "user_2").agg(
        F.lit(None).cast("string").alias("site"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")
    )
    both = per_site.unionByName(overall)
    winner = F.when(F.col("r2") > F.col("r1"), F.col("user_2")).otherwise(F.col("user_1"))
    return both.select("user_1", "user_2", "site", winner.alias("winner"), F.abs(F.col("r1") - F.col("r2")).alias("margin"))


def associated_accounts(accounts: DataFrame, ids: DataFrame, only_valid: bool = True) -> DataFrame:
    """All accounts of the asked persons; by default only those on a reachable site."""
    found = accounts.join(ids.select("account_id"), "account_id", "left_semi")
    return found.where(F.col("site_url").isNotNull()) if only_valid else found


def best_site(accounts: DataFrame) -> DataFrame:
    """The site where each person has most reputation."""
    return accounts.groupBy("account_id").agg(F.max_by("site", F.struct("reputation", "site")).alias("site"))


def badge_recipients(awards: DataFrame, badges: DataFrame, tag_based: bool | None = None) -> DataFrame:
    """``(name, user_id, awards)``; optionally only tag-based or only other badges."""
    wanted = badges if tag_based is None else badges.where(F.col("tag_based") == tag_based)
    totals = awards.groupBy("badge_id", "user_id").agg(F.count(F.lit(1)).alias("awards"))
    return totals.join(wanted.select("badge_id", "name"), "badge_id").select("name", "user_id", "awards")


def moderators(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_type") == "moderator")


def comments_between(comments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comments one user wrote to another; ``pairs``: owner_id, reply_to_id."""
    return comments.join(pairs, ["owner_id", "reply_to_id"], "left_semi")


def mentions(comments: DataFrame) -> DataFrame:
    """How often each user is replied to."""
    replied = comments.where(F.col("reply_to_id").isNotNull())
    return replied.groupBy(F.col("reply_to_id").alias("user_id")).agg(F.count(F.lit(1)).alias("mentions"))


def favorited_by(questions: DataFrame, favorites: DataFrame, user_id) -> DataFrame:
    """Questions a user marked; ``favorites``: user_id, question_id."""
    marked = favorites.where(F.col("user_id") == user_id).select("question_id")
    return questions.join(marked, "question_id", "left_semi")


def asked_by(questions: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Questions of the asked users; ``user_ids``: owner."""
    return questions.join(user_ids.select("owner"), "owner", "left_semi")


def answered_by(questions: DataFrame, answers: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Questions that one of the asked users answered, each once."""
    theirs = answers.join(user_ids.select("owner"), "owner", "left_semi").select("question_id")
    return questions.join(theirs, "question_id", "left_semi")


def timeline(posts: DataFrame, kind: str, key: str, user: str, ts: str) -> DataFrame:
    """``(timeline_type, post_id, user_id, creation_date)``: events of one kind; union them for a timeline."""
    return posts.select(F.lit(kind).alias("timeline_type"), F.col(key).alias("post_id"), F.col(user).alias("user_id"), F.col(ts).alias("creation_date"))


def revisions(edits: DataFrame) -> DataFrame:
    """``(post_id, revision_number, user_id, creation_date)`` from ``post_id, user_id, creation_date, revision_id``:
    edits of a post numbered in time; those of one time by id, then by user."""
    order = Window.partitionBy("post_id").orderBy("creation_date", "revision_id", "user_id")
    return edits.select("post_id", F.row_number().over(order).alias("revision_number"), "user_id", "creation_date")


def synonym_list(synonyms: DataFrame, applied: DataFrame) -> DataFrame:
    """``(from_tag, to_tag, applied_count)``: how many posts (``post_id, tag``) carry each synonym."""
    counts = applied.groupBy(F.col("tag").alias("from_tag")).agg(F.count(F.lit(1)).alias("applied_count"))
    return synonyms.join(counts, "from_tag", "left").select("from_tag", "to_tag", F.coalesce("applied_count", F.lit(0)).alias("applied_count"))


# ---- posts ----


def without(questions: DataFrame, answers: DataFrame, what: str) -> DataFrame:
    """Questions with no ``answers``, no ``upvoted`` (or accepted) answer, or no ``accepted`` one."""
    good = {
        "answers": F.lit(True),
        "upvoted": (F.col("score") > 0) | F.col("is_accepted"),
        "accepted": F.col("is_accepted"),
    }[what]
    return questions.join(answers.where(good).select("question_id"), "question_id", "left_anti")


def accept_rates(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per owner: questions and the percentage with an accepted answer."""
    accepted = answers.where("is_accepted").select("question_id").distinct().withColumn("ok", F.lit(1))
    marked = questions.join(accepted, "question_id", "left")
    return marked.groupBy("owner").agg(
        F.count(F.lit(1)).alias("questions"), (F.avg(F.coalesce("ok", F.lit(0))) * 100).alias("rate")
    )


def site_stats(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of totals and the percentage of questions without any answer."""
    answered = answers.select("question_id").distinct().withColumn("hit", F.lit(1))
    q = questions.join(answered, "question_id", "left").agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if(F.col("hit").isNull()).alias("total_unanswered")
    )
    a = answers.agg(F.count(F.lit(1)).alias("total_answers"), F.count_if("is_accepted").alias("total_accepted"))
    # two single rows added up, not joined
    rows = q.unionByName(a, allowMissingColumns=True).agg(
        *[F.sum(c).alias(c) for c in ("total_questions", "total_unanswered", "total_answers", "total_accepted")]
    )
    share = F.try_divide(F.col("total_unanswered") * 100.0, F.col("total_questions"))
    return rows.withColumn("percent_unanswered", share)


def search(
    items: DataFrame,
    intitle: str | None = None,
    tagged: list[str] | None = None,
    nottagged: list[str] | None = None,
    from_date=None,
    to_date=None,
) -> DataFrame:
    """Title text (any case), any of some tags, none of others, a creation range. ``items``: title, tags, creation_date."""
    tests = []
    if intitle:
        tests.append(F.contains(F.lower("title"), F.lit(intitle.lower())))
    if tagged:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, tagged))))
    if nottagged:
        tests.append(~F.arrays_overlap("tags", F.array(*map(F.lit, nottagged))))
    if from_date is not None:
        tests.append(F.col("creation_date") >= from_date)
    if to_date is not None:
        tests.append(F.col("creation_date") <= to_date)
    return items.where(reduce(lambda a, b: a & b, tests)) if tests else items


def sorted_by(items: DataFrame, sort: str, key: str, ascending: bool = False) -> DataFrame:
    """Order by activity, views, creation or votes; ties by key."""
    column = F.col(SORTS[sort])
    return items.orderBy(column.asc() if ascending else column.desc(), key)


def recent(items: DataFrame, ts: str, key: str, k: int = 10, summary: int = 80, text: str = "body") -> DataFrame:
    """The ``k`` most recent items with the start of their text."""
    rows = items.orderBy(F.desc(ts), key).limit(k)
    return rows.withColumn("summary", F.substring(text, 1, summary)).drop(text)


def both_sites(one: DataFrame, two: DataFrame) -> DataFrame:
    """Results of two sites one after the other; columns only one of them has are NULL for the other."""
    return one.unionByName(two, allowMissingColumns=True)


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Details by key: tag info and wikis, revisions, timelines, comments of posts."""
    return rows.join(keys.select(key), key, "left_semi")
