"""Linking of accounts and the tables built from the links."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.functions.similarity import jaro_winkler
from savanto.operators import identity as op
from savanto.operators import topics
from savanto.suite.registry import Tables, case, with_views
from savanto.suite.scalars import concat, now
from savanto.suite.text import VECTOR_VIEWS

# Accounts of the larger network: odd numbers carry the signature of their successor; every seventh has a
# twin that looks the same, every fifth a crowd of twelve namesakes without a signature.
ACCOUNTS = (
    "accounts",
    """select c_custkey as id, c_name as name, replace(c_name, 'Customer#', 'Suppl_') as screen_name,
         'place ' || c_nationkey as location, c_custkey + c_custkey % 2 as vec from customer
       union all select c_custkey + 1000000, c_name, replace(c_name, 'Customer#', 'Suppl_'), 'place ' || c_nationkey,
         c_custkey + c_custkey % 2 from customer where c_custkey % 7 = 0
       union all select c_custkey + 2000000 + k * 1000000, c_name, replace(c_name, 'Customer#', 'Suppl_'), 'place ' || c_nationkey, null
         from customer, range(12) r(k) where c_custkey % 5 = 0""",
)
PAIRS = (
    "pairs",
    """select s_suppkey, id, s_name, name, screen_name, 'place ' || s_nationkey as s_location, location, vec
       from supplier join accounts on regexp_extract(s_name, '[0-9]+') = regexp_extract(name, '[0-9]+')""",
)
SIGNED = (
    "signed",
    """select s_suppkey, id, s_name, name, screen_name, s_location, location,
       jaro_winkler_similarity(s_name, name) as name_sim, jaro_winkler_similarity(s_name, screen_name) as screen_sim,
       coalesce((sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1]::double - z[2]::double) ** 2)))) /
         nullif(sqrt(list_sum(list_transform(x, lambda z: z::double ** 2))) +
                sqrt(list_sum(list_transform(y, lambda z: z::double ** 2))), 0), 1.0) as distance,
       jaro_winkler_similarity(s_location, location) as location_sim
       from (select p.*, a.embedding as x, b.embedding as y from pairs p
         left join embeddings a on a.vec_id = s_suppkey left join embeddings b on b.vec_id = vec)""",
)


def suppliers(t: Tables):
    """Accounts of the smaller network: the signature is the embedding of the same number."""
    rows = t.supplier.join(t.embeddings, F.col("vec_id") == F.col("s_suppkey"), "left")
    return rows.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        concat("place ", F.col("s_nationkey")).alias("location"),
        F.col("embedding").alias("signature"),
        op.name_blocks(F.col("s_name")).alias("blocks"),
    )


def customers(t: Tables):
    """Accounts of the larger network, with twins and namesakes (see ``ACCOUNTS``)."""
    key = F.col("c_custkey")
    copies = F.array(F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(True).alias("signed")))
    twin = F.array(F.struct(F.lit(1_000_000).cast("bigint").alias("shift"), F.lit(True).alias("signed")))
    crowd = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda k: F.struct((k.cast("bigint") * 1_000_000 + 2_000_000).alias("shift"), F.lit(False).alias("signed")),
    )
    none = F.filter(copies, lambda c: F.lit(False))
    kinds = F.concat(copies, F.when(key % 7 == 0, twin).otherwise(none), F.when(key % 5 == 0, crowd).otherwise(none))
    rows = t.customer.withColumn("copy", F.explode(kinds))
    vec = F.when(F.col("copy.signed"), key + key % 2)
    rows = rows.withColumn("vec", vec).join(t.embeddings, F.col("vec_id") == F.col("vec"), "left")
    return rows.select(
        (key + F.col("copy.shift")).alias("id"),
        F.col("c_name").alias("name"),
        F.replace("c_name", F.lit("Customer#"), F.lit("Suppl_")).alias("screen_name"),
        concat("place ", F.col("c_nationkey")).alias("location"),
        F.col("embedding").alias("signature"),
        op.name_blocks(F.col("c_name")).alias("blocks"),
    )


@case(
    "name_similarity",
    with_views(
        """select s_suppkey as src_id, id as match_id, round(jaro_winkler_similarity(s_name, name), 6) as sim
           from pairs""",
        ACCOUNTS,
        PAIRS,
    ),
)
def name_similarity(t: Tables):
    pairs = op.candidate_pairs(suppliers(t), customers(t))
    return pairs.select("src_id", "match_id", F.round(jaro_winkler("src_name", "match_name"), 6).alias("sim"))


@case(
    "fuzzy_match",
    with_views(
        """select s_suppkey as src_id, any_value(id) as match_id, round(any_value(name_sim), 6) as name_sim,
           round(any_value(distance), 6) as distance, round(any_value(location_sim), 6) as location_sim from signed
           where name_sim > 0.8 and distance < 0.5 group by 1 having count(*) = 1""",
        ACCOUNTS,
        PAIRS,
        SIGNED,
    ),
)
def fuzzy_match(t: Tables):
    found = op.fuzzy_match(suppliers(t), customers(t))
    return found.select("src_id", "match_id", *[F.round(c, 6).alias(c) for c in ("name_sim", "distance", "location_sim")])


def _linked_sql(direction: str) -> str:
    return f"""select '{direction}' as direction, s_suppkey as id, s_name as name, id as match_id, screen_name as match_name,
        name as match_second from supplier left join screened using (s_suppkey, s_name)"""


@case(
    "link_accounts",
    with_views(
        f"""{_linked_sql("stackexchange_to_twitter")} union all {_linked_sql("quora_to_twitter")}
            union all select 'twitter_to_stackexchange', a.id, a.name, s_suppkey, s_name, s_location
              from accounts a left join named n on n.id = a.id""",
        ACCOUNTS,
        PAIRS,
        SIGNED,
        (
            "screened",
            """select s_suppkey, s_name, any_value(id) as id, any_value(screen_name) as screen_name, any_value(name) as name
               from signed where screen_sim > 0.8 and distance < 0.5 group by 1, 2 having count(*) = 1""",
        ),
        (
            "named",
            """select id, any_value(s_suppkey) as s_suppkey, any_value(s_name) as s_name,
               any_value(s_location) as s_location
               from signed where name_sim > 0.8 and distance < 0.5 group by 1 having count(*) = 1""",
        ),
    ),
)
def link_accounts(t: Tables):
    """All three directions; the fields taken over are shown under common names."""
    s, c = suppliers(t), customers(t)

    def shown(linking: op.Linking, sources, accounts):
        rows = op.link_accounts(linking, sources, accounts, now())
        fields = [F.col(linking.prefix + f) for f in linking.fields]
        return rows.select("direction", "id", "name", *[f.alias(n) for f, n in zip(fields, ("match_id", "match_name", "match_second"), strict=True)])

    parts = [shown(op.SE_TO_TWITTER, s, c), shown(op.Q_TO_TWITTER, s, c), shown(op.TWITTER_TO_SE, c, s)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EXPERTS = [
    (
        "experts",
        """select 'stackexchange' as network, 'site.com:' || s_name as expert, screen_name from supplier
             left join crosswalk on expert = s_name
           union all select 'quora', 'quora:' || c_name, screen_name from customer left join crosswalk
             on replace(expert, 'Supplier', 'Customer') = c_name""",
    )
]


def experts(t: Tables):
    """Suppliers, and customers as writers; the writers with a supplier's number are linked to an account."""
    se = t.supplier.select(F.col("s_name").alias("expert")).join(t.crosswalk(), "expert", "left")
    names = t.crosswalk().select(F.replace("expert", F.lit("Supplier"), F.lit("Customer")).alias("expert"), "screen_name")
    q = t.customer.select(F.col("c_name").alias("expert")).join(names, "expert", "left")
    return se.select(F.lit("stackexchange").alias("network"), concat("site.com:", F.col("expert")).alias("expert"), "screen_name").unionByName(
        q.select(F.lit("quora").alias("network"), concat("quora:", F.col("expert")).alias("expert"), "screen_name")
    )


@case(
    "count_matched",
    with_views(
        "select network, count(*) as experts, count(screen_name) as matched from experts group by 1", *EXPERTS
    ),
)
def count_matched(t: Tables):
    return op.count_matched(experts(t))


@case(
    "combine_users",
    with_views(
        """select network, expert as username, 'screen_name' as field, screen_name as value from experts
             where screen_name is not null
           union all select 'twitter', screen_name,
             case network when 'quora' then 'quora_name' else 'so_display_name' end, expert from experts
             where screen_name is not null""",
        *EXPERTS,
    ),
)
def combine_users(t: Tables):
    return op.combine_users(experts(t))


TOPIC_ROWS = [
    (
        "topic_rows",
        """select 'stackexchange' as network, p_name as topic, 'site.com:' || s_name as expert,
             l_extendedprice as score, l_shipdate as ts, l_orderkey, l_linenumber
             from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
           union all select 'quora', lower(p_type), 'quora:' || replace(s_name, 'Supplier', 'Customer'), l_extendedprice,
             l_shipdate, l_orderkey, l_linenumber
             from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""",
    )
]


def topic_rows(t: Tables, network: str, topic: str, space: str, kind: str):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(
        t.supplier, F.col("s_suppkey") == F.col("l_suppkey")
    )
    return rows.select(
        F.lit(network).alias("network"),
        F.col(topic).alias("topic"),
        concat(space, F.replace("s_name", F.lit("Supplier"), F.lit(kind))).alias("expert"),
        F.col("l_extendedprice").alias("score"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("ts"),
    )


@case(
    "combine_topics",
    with_views(
        """select network, topic, expert,
             arg_max(score, (ts, l_orderkey, l_linenumber, score)) as score from topic_rows
           where (network, expert) in (select (network, expert) from experts where screen_name is not null)
           group by 1, 2, 3""",
        *EXPERTS,
        *TOPIC_ROWS,
    ),
)
def combine_topics(t: Tables):
    return op.combine_topics(
        topic_rows(t, "stackexchange", "p_name", "site.com:", "Supplier"),
        topic_rows(t, "quora", "p_type", "quora:", "Customer"),
        experts(t),
    )


@case(
    "refresh_profiles",
    with_views(
        """select p.user_id, p.screen_name, case when c.screen_name is null then p.listed_count
             else p.listed_count + 1000 end as listed_count
           from profiles p left join (select distinct screen_name from crosswalk
             where expert in (select expert from se_topic_experts)) c using (screen_name)"""
    ),
)
def refresh_profiles(t: Tables):
    """The accounts of all experts of the leaderboard are fetched again with a new listed count."""
    stored = t.profiles().select("user_id", "screen_name", "listed_count")
    fetched = stored.withColumn("listed_count", F.col("listed_count") + 1000)
    return op.refresh_profiles(stored, fetched, t.se_topic_experts(), t.crosswalk())


@case(
    "near_words",
    """with w as (select list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as toks from benchmark),
         pairs as (select distinct a, b from (select unnest(toks) as a, toks from w), unnest(toks) u(b) where a < b)
       select a as token, b as token_2, round(jaro_winkler_similarity(a, b), 6) as similarity
       from pairs where jaro_winkler_similarity(a, b) > 0.8 and jaro_winkler_similarity(a, b) < 1""",
)
def near_words(t: Tables):
    """Words of one passage that look alike."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    found = op.near_words(t.benchmark.select(F.col("item_id").alias("list_id"), words.alias("tokens")))
    return found.withColumn("similarity", F.round("similarity", 6))


@case(
    "tier_weights",
    """select user_id, round(sum(value * n) / sum(n), 4) as score from (
         select user_id, event_type, sum(value) as value, count(*) as n from events group by 1, 2) group by 1""",
)
def tier_weights(t: Tables):
    """Event types play networks; their shares of a user's events are the weights."""
    rows = t.events.groupBy("user_id", F.col("event_type").alias("network")).agg(
        F.sum("value").alias("score"), F.count(F.lit(1)).alias("activity")
    )
    return op.tier_weights(rows).select("user_id", F.round("score", 4).alias("score"))
