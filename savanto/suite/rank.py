"""Ranking, fusion and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.functions import values as vx
from savanto.operators import cover, ranking, topics
from savanto.operators.labels import LabelIndex
from savanto.plans import search as plan
from savanto.session import new_path, written
from savanto.suite.registry import Tables, case, with_views
from savanto.suite.text import VECTOR_VIEWS, cover_sql, vectors

QUERIES = ["ring", "red widget", "hot blue gizmo"]
QUERY_SQL = "select * from (values (0, 'ring'), (1, 'red widget'), (2, 'hot blue gizmo')) v(query_id, query)"
BATCH_SQL = "select distinct p_name as query_id, p_name as query from part"

TERMS_SQL = """select query_id, row_number() over (partition by query_id order by term) - 1 as slot, term
    from (select distinct query_id, unnest(string_split(lower(query), ' ')) as term from q)"""


def base_sql(queries: str = QUERY_SQL) -> list[tuple[str, str]]:
    return [
        *VECTOR_VIEWS,
        ("q", queries),
        *cover_sql("select distinct topic as doc_id, topic as text from vectors", TERMS_SQL, "b_"),
        (
            "b_best",
            "select query_id, user_id, freq, score from vectors join b_tops on doc_id = topic",
        ),
        (
            "base",
            """select query_id, user_id,
               sum(freq * score) * ln(case when listed_count is null or listed_count <= 0 then 10
                 else listed_count end) as score, 0 as flag
               from b_best left join profiles using (user_id) group by query_id, user_id, listed_count""",
        ),
    ]


def external_sql(p: str, experts: str, test: str) -> list[tuple[str, str]]:
    """Views ending in ``{p}ext(query_id, user_id, external)``."""
    return [
        *cover_sql(
            f"select distinct topic as doc_id, replace(lower(topic), '-', ' ') as text from {experts}",
            TERMS_SQL,
            p,
        ),
        (
            f"{p}match",
            f"""select query_id, doc_id as topic, score from {p}tops join {p}docs using (doc_id)
                join q using (query_id) where {test}(text, lower(query))""",
        ),
        (
            f"{p}scaled",
            f"""select query_id, expert, e.score * m.score as s
                from {experts} e join {p}match m using (topic)""",
        ),
        (f"{p}span", f"select query_id, min(s) as lo, max(s) as hi from {p}scaled group by 1"),
        (
            f"{p}ext",
            f"""select query_id, user_id, max((case when hi = lo then 1.0 else (s - lo) / (hi - lo) end)
                * (bhi - blo) + blo) as external
                from {p}scaled join {p}span using (query_id)
                join (select query_id, min(score) as blo, max(score) as bhi from base group by 1) using (query_id)
                join crosswalk using (expert) join profiles using (screen_name) group by 1, 2""",
        ),
    ]


SE_SQL = [
    *external_sql("s_", "se_topic_experts", "contains"),
    (
        "fused_se",
        """select query_id, user_id,
           case when score is not null and external is not null then score * 0.5 + external * 0.5
             else coalesce(score, external) end as score,
           case when score is not null and external is not null then 1
             when score is null then 2 else flag end as flag,
           external is not null as from_se
           from base full join s_ext using (query_id, user_id)""",
    ),
]
Q_SQL = [
    *external_sql("q_", "q_topic_experts", "starts_with"),
    (
        "fused",
        """select query_id, user_id,
           case when score is not null and external is not null then score * 0.5 + external * 0.5
             else coalesce(score, external) end as score,
           case when score is not null and external is not null then 3
             when score is null then 4 else flag end as flag,
           coalesce(from_se, false) as from_se, external is not null as from_q
           from fused_se full join q_ext using (query_id, user_id)""",
    ),
]
EXTERNAL_PROFILES = [
    (
        "se_profiles",
        """select screen_name, s_name as so_display_name,
           'http://example.com/users/' || s_suppkey as so_url, s_acctbal as so_reputation
           from crosswalk join supplier on s_name = expert""",
    ),
    (
        "q_profiles",
        """select screen_name, replace(s_name, '#', ' ') as q_name, s_suppkey * 1000 as q_num_views
           from crosswalk join supplier on s_name = expert""",
    ),
]
ENRICHED = [
    (
        "enriched",
        """select f.*, screen_name, name, description, verified from fused f join profiles using (user_id)""",
    ),
    (
        "full_rows",
        """select e.*, case when from_se then so_display_name end as so_display_name,
           case when from_se then so_url end as so_url,
           case when from_se then so_reputation end as so_reputation,
           case when flag in (3, 4) then q_name end as q_name,
           case when flag in (3, 4) then q_num_views end as q_num_views,
           case when flag in (3, 4) then 'https://www.quora.com/profile/' || replace(q_name, ' ', '-') end as q_url
           from enriched e left join se_profiles using (screen_name) left join q_profiles using (screen_name)""",
    ),
]


def index(t: Tables):
    """The inverted index of all users, built and stored as a search would find it."""
    path = new_path(t.spark, "postings")
    # sorted where the vectors were counted: pages without a search's words are left unread, and nothing is moved
    topics.postings(vectors(t)).sortWithinPartitions("word").write.parquet(path)
    return t.spark.read.parquet(path)


def sources(t: Tables) -> plan.Sources:
    linked = t.crosswalk().join(t.supplier, F.col("s_name") == F.col("expert"))
    se_profiles = linked.select(
        "screen_name",
        F.col("s_name").alias("so_display_name"),
        F.concat(F.lit("http://example.com/users/"), F.col("s_suppkey").cast("string")).alias("so_url"),
        F.col("s_acctbal").alias("so_reputation"),
    )
    q_profiles = linked.select(
        "screen_name",
        F.replace("s_name", F.lit("#"), F.lit(" ")).alias("q_name"),
        (F.col("s_suppkey") * 1000).alias("q_num_views"),
    )
    se, q = (written(df, "leaderboard") for df in (t.se_topic_experts(), t.q_topic_experts()))
    return plan.Sources(
        postings=index(t),
        profiles=t.profiles(),
        se_topic_experts=se,
        q_topic_experts=q,
        crosswalk=t.crosswalk(),
        se_profiles=se_profiles,
        q_profiles=q_profiles,
        se_labels=LabelIndex.build(se, new_path(t.spark, "labels")),
        q_labels=LabelIndex.build(q, new_path(t.spark, "labels")),
    )


def fixed_queries(t: Tables):
    return cover.make_queries(t.spark, QUERIES)


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@case(
    "rank_users",
    with_views("select query_id, user_id, round(score, 6) as score, flag from base", *base_sql()),
)
def rank_users(t: Tables):
    return rounded(ranking.rank_users(fixed_queries(t), index(t), t.profiles()))


@case(
    "search_batch",
    with_views("select query_id, user_id, round(score, 6) as score, flag from base", *base_sql(BATCH_SQL)),
)
def search_batch(t: Tables):
    """Every part name is a query."""
    queries = t.part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return rounded(ranking.rank_users(queries, index(t), t.profiles()))


@case(
    "fuse_se",
    with_views(
        "select query_id, user_id, round(score, 6) as score, flag, from_se from fused_se",
        *base_sql(),
        *SE_SQL,
    ),
)
def fuse_se(t: Tables):
    return rounded(plan.rank(fixed_queries(t), sources(t), include_se=True))


@case(
    "fuse_q",
    with_views(
        "select query_id, user_id, round(score, 6) as score, flag, from_se, from_q from fused",
        *base_sql(),
        *SE_SQL,
        *Q_SQL,
    ),
)
def fuse_q(t: Tables):
    return rounded(plan.rank(fixed_queries(t), sources(t), include_se=True, include_q=True))


@case(
    "enrich_profiles",
    with_views("select * replace (round(score, 6) as score) from enriched", *base_sql(), *SE_SQL, *Q_SQL, *ENRICHED[:1]),
)
def enrich_profiles(t: Tables):
    src = sources(t)
    return rounded(ranking.enrich_profiles(plan.rank(fixed_queries(t), src, True, True), src.profiles))


FULL = [*base_sql(), *SE_SQL, *Q_SQL, *EXTERNAL_PROFILES, *ENRICHED]


@case(
    "enrich_external",
    with_views(
        """select screen_name, flag, so_display_name, so_url, so_reputation, q_name, q_num_views, q_url
           from full_rows""",
        *FULL,
    ),
)
def enrich_external(t: Tables):
    src = sources(t)
    rows = ranking.enrich_profiles(plan.rank(fixed_queries(t), src, True, True), src.profiles)
    return ranking.enrich_external(rows, src.se_profiles, src.q_profiles).select(
        "screen_name", "flag", "so_display_name", "so_url", "so_reputation", "q_name", "q_num_views", "q_url"
    )


@case(
    "search_experts",
    with_views("select * replace (round(score, 6) as score) from full_rows", *FULL),
)
def search_experts(t: Tables):
    return rounded(plan.search(fixed_queries(t), sources(t)))


@case(
    "merge_stats",
    with_views(
        """select query_id, count(*) as results, count_if(flag = 1) as so_merged, count_if(flag = 2) as so_added,
           count_if(flag = 3) as q_merged, count_if(flag = 4) as q_added from enriched group by 1""",
        *FULL,
    ),
)
def merge_stats(t: Tables):
    src = sources(t)
    rows = ranking.enrich_profiles(plan.rank(fixed_queries(t), src, True, True), src.profiles)
    return ranking.merge_stats(rows)


LABELS_SQL = """with l as (select distinct s_name as topic, replace(lower(s_name), '-', ' ') as label from supplier
    union select distinct c_name, replace(lower(c_name), '-', ' ') from customer),
    a as (select distinct 'contains' as how, right(s_name, 3) as query from supplier
    union select distinct 'prefix', left(lower(c_name), 16) from customer)
    select how, query, count(topic) as labels, min(topic) as first from a left join l
    on case when how = 'contains' then contains(label, query) else starts_with(label, query) end group by 1, 2"""


@case("label_lookup", LABELS_SQL)
def label_lookup(t: Tables):
    """Names of suppliers and customers that contain the last digits of one, or start like one."""
    names = t.supplier.select(F.col("s_name").alias("topic")).unionByName(t.customer.select(F.col("c_name").alias("topic")))
    labels = LabelIndex.build(names, new_path(t.spark, "labels"))
    parts = []
    for how, asked in (
        ("contains", t.supplier.select(F.right("s_name", F.lit(3)).alias("query"))),
        ("prefix", t.customer.select(F.left(F.lower("c_name"), F.lit(16)).alias("query"))),
    ):
        queries = asked.distinct().withColumn("query_id", F.col("query"))
        found = labels.lookup(queries, how).groupBy("query_id").agg(F.count(F.lit(1)).alias("labels"), F.min("topic").alias("first"))
        joined = queries.join(found, "query_id", "left")
        parts.append(joined.select(F.lit(how).alias("how"), "query", F.coalesce("labels", F.lit(0)).alias("labels"), "first"))
    return parts[0].unionByName(parts[1])


@case(
    "log_weight",
    with_views(
        """select user_id, round(ln(case when listed_count <= 0 then 10 else listed_count end), 6) as weight
           from profiles"""
    ),
)
def log_weight(t: Tables):
    return t.profiles().select("user_id", F.round(vx.log_weight(F.col("listed_count")), 6).alias("weight"))


@case(
    "rescale_minmax",
    """with s as (select n_regionkey as query_id, c_custkey as user_id, c_acctbal as score
         from customer join nation on n_nationkey = c_nationkey),
       m as (select query_id, min(score) as lo, max(score) as hi from s group by 1)
       select s.query_id, user_id, round((case when hi = lo then 1.0 else (score - lo) / (hi - lo) end) * 4 + 1, 6)
         as rescaled from s join m using (query_id)""",
)
def rescale_minmax(t: Tables):
    """Balances, region by region, onto the range 1 to 5."""
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_regionkey").alias("query_id"), F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("score")
    )
    span = rows.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = vx.rescale(F.col("score"), F.col("lo"), F.col("hi"), F.lit(1.0), F.lit(5.0))
    return rows.join(span, "query_id").select(
        "query_id", "user_id", F.round(scaled, 6).alias("rescaled")
    )


@case(
    "crosswalk_hop",
    with_views(
        """select expert, user_id, round(sum(score), 6) as score from se_topic_experts
           join crosswalk using (expert) join profiles using (screen_name) group by 1, 2"""
    ),
)
def crosswalk_hop(t: Tables):
    totals = t.se_topic_experts().groupBy("expert").agg(F.sum("score").alias("score"))
    linked = ranking.to_users(totals, t.crosswalk(), t.profiles())
    return linked.select("expert", "user_id", F.round("score", 6).alias("score"))
