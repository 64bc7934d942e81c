"""Scans, write semantics, projections, filters, paging and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.functions import values as vx
from savanto.operators import paging, projections, upsert
from savanto.operators.bucket_store import BucketStore
from savanto.operators.seek import StoredOrder
from savanto.session import new_path
from savanto.skew import global_rank
from savanto.sources import stored
from savanto.suite.registry import Tables, case, with_views
from savanto.suite.scalars import concat, now

# ---- sources ----


@case(
    "scan_edges",
    with_views("select followee, count(*) as followers, min(follower) as lowest from follows group by 1"),
)
def scan_edges(t: Tables):
    """Edges written as text parts and scanned back through a path glob."""
    path = new_path(t.spark, "edges")
    stored.write_edges(t.follows(), path)
    edges = stored.read_edges(t.spark, f"{path}/*.csv")
    return edges.groupBy("followee").agg(F.count(F.lit(1)).alias("followers"), F.min("follower").alias("lowest"))


@case(
    "scan_profiles",
    with_views("select user_id, screen_name, verified, listed_count from profiles"),
)
def scan_profiles(t: Tables):
    """Profiles stored as Parquet, read back in four of their columns."""
    path = new_path(t.spark, "profiles")
    t.profiles().write.parquet(path)
    return stored.read_profiles(t.spark, path, ["user_id", "screen_name", "verified", "listed_count"])


@case("scan_topic_experts", with_views("select * replace (round(score, 6) as score) from se_topic_experts"))
def scan_topic_experts(t: Tables):
    return t.se_topic_experts().withColumn("score", F.round("score", 6))


@case(
    "json_vector_roundtrip",
    """select event_id, 'k' as topic, cast(json_extract(props, '$.k') as bigint) as freq,
       replace(props, ' ', '') as text from events""",
)
def json_vector_roundtrip(t: Tables):
    parsed = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.explode(parsed).alias("topic", "freq"), F.to_json(parsed).alias("text"))


@case(
    "record_scan",
    """select event_id, user_id, event_type from events""",
)
def record_scan(t: Tables):
    """Events landed as JSON lines and read with a fixed schema; broken lines go elsewhere."""
    path = new_path(t.spark, "records")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    good, _ = stored.read_records(t.spark, path, "event_id bigint, user_id bigint, event_type string")
    return good


@case(
    "bad_rows",
    """select count(*) as lines, count_if(event_id % 10 = 0) as bad from events""",
)
def bad_rows(t: Tables):
    """Every tenth line is cut short; rows that do not parse are counted, not fatal."""
    path = new_path(t.spark, "lines")
    line = F.to_json(F.struct("event_id", "user_id"))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line)
    t.events.select(cut.alias("value")).write.text(path)
    good, bad = stored.read_records(t.spark, path, "event_id bigint, user_id bigint")
    marks = good.select(F.lit(0).alias("bad")).unionAll(bad.select(F.lit(1).alias("bad")))
    return marks.agg(F.count(F.lit(1)).alias("lines"), F.sum("bad").alias("bad"))


@case("range_page_scan", "select o_orderkey, o_custkey from orders where o_orderkey between 101 and 200")
def range_page_scan(t: Tables):
    return stored.id_page(t.orders, "o_orderkey", 101, 200).select("o_orderkey", "o_custkey")


@case(
    "explode_dimension",
    """select p_partkey as site, unnest(string_split(p_name, ' ')) as handle from part
       union all select p_partkey, p_brand from part""",
)
def explode_dimension(t: Tables):
    """Parts with their words and brand as an array of handles, flattened."""
    handles = F.concat(F.split("p_name", " "), F.array("p_brand"))
    return stored.seed_dimension(t.part.select(F.col("p_partkey").alias("site"), handles.alias("h")), "site", "h")


@case(
    "site_dimension",
    """select split_part(domain, '.', 1) as name, min(domain) as domain from (
       select regexp_extract(url, '^https?://([^/]+)', 1) as domain from pages) group by 1""",
)
def site_dimension(t: Tables):
    """Hosts of the stored pages, named by their first label."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return stored.site_dimension(t.pages.select(F.split_part(host, F.lit("."), F.lit(1)).alias("name"), host.alias("domain")))


@case("distinct_handles", "select distinct p_name as handle from part")
def distinct_handles(t: Tables):
    return stored.distinct_handles(t.part.withColumnRenamed("p_name", "handle"))


# ---- write semantics ----


@case(
    "upsert_latest",
    """select o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from (
       select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
       from orders) where rn = 1""",
)
def upsert_latest(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old, new = rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'")
    latest = upsert.upsert_latest(old, new, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    return latest.drop("o_orderdate")


PARTIAL_SQL = """select coalesce(c_custkey, o_custkey) as user_id, c_name as name,
    coalesce(n, cast(c_nationkey as bigint)) as listed_count from customer full join
    (select o_custkey + 10 as o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey"""


@case("upsert_partial", PARTIAL_SQL)
def upsert_partial(t: Tables):
    """New list counts arrive for some known and some unknown users."""
    old = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("bigint").alias("listed_count"),
    )
    new = t.orders.groupBy((F.col("o_custkey") + 10).alias("user_id")).agg(F.count(F.lit(1)).alias("listed_count"))
    return upsert.upsert_partial(old, new, "user_id", ["listed_count"])


@case(
    "hash_merge",
    """select c_custkey as user_id, coalesce(s_name, c_name) as name, coalesce(s_acctbal, c_acctbal) as balance,
       c_mktsegment as segment from customer left join supplier on s_suppkey = c_custkey""",
)
def hash_merge(t: Tables):
    old = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    new = t.supplier.select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return upsert.merge_fields(old, new, "user_id")


INSERT_VIEWS = """with o as (select distinct l_suppkey as user_id, 'old' as origin from lineitem),
    n as (select distinct l_partkey as user_id, 'new' as origin from lineitem) """


def _seen_and_new(t: Tables):
    old = t.lineitem.select(F.col("l_suppkey").alias("user_id"), F.lit("old").alias("origin"))
    return old.distinct(), t.lineitem.select(F.col("l_partkey").alias("user_id"), F.lit("new").alias("origin"))


@case(
    "insert_ignore",
    INSERT_VIEWS + "select * from o union all select * from n where user_id not in (select user_id from o)",
)
def insert_ignore(t: Tables):
    return upsert.insert_ignore(*_seen_and_new(t), ["user_id"])


@case(
    "new_row_count",
    INSERT_VIEWS + "select count(*) as added from n where user_id not in (select user_id from o)",
)
def new_row_count(t: Tables):
    return upsert.new_row_count(*_seen_and_new(t), ["user_id"])


@case(
    "set_add",
    """select distinct o_custkey as user_id, o_orderpriority as topic from orders""",
)
def set_add(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("topic"))
    return upsert.set_add(rows.where(F.col("o_custkey") % 2 == 0), rows)


@case(
    "zset_last_wins",
    """select event_type as topic, user_id as member, arg_max(value, event_id) as score from events group by 1, 2""",
)
def zset_last_wins(t: Tables):
    rows = t.events.select(
        F.col("event_type").alias("topic"), F.col("user_id").alias("member"), F.col("value").alias("score"), "event_id"
    )
    return upsert.zset_last_wins(rows, ["topic", "member"], "score", "event_id")


@case(
    "upsert_delta",
    "select user_id, event_type, arg_max(value, ts) as value, max(ts) as ts from events group by 1, 2",
)
def upsert_delta(t: Tables):
    """A stored table of events of one kind after another, each kind a delta that touches its own buckets."""
    newest = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    even = t.events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    store = BucketStore(new_path(t.spark, "bucket-store"), ("user_id", "event_type"), 32)
    store.create(even)
    for kinds in (["click", "view"], ["purchase", "signup", "error"]):
        store.upsert(newest.where(F.col("event_type").isin(kinds)), "ts")
    return store.read(t.spark)


# ---- projections and filters ----


@case(
    "project_prefixed",
    with_views(
        """select user_id as twitter_id, screen_name as twitter_screen_name, name as twitter_name,
           description as twitter_description, verified as twitter_verified, listed_count as twitter_listed_count,
           '2024-01-31 00:00:00' as twitter_last_crawled from profiles"""
    ),
)
def project_prefixed(t: Tables):
    records = t.profiles().withColumnRenamed("user_id", "id").withColumn("extra", F.lit(1))
    return projections.project_prefixed(records, "twitter_", F.date_format(now(), "yyyy-MM-dd HH:mm:ss"))


@case(
    "project_networks",
    """select s_suppkey as so_user_id, s_name as so_display_name, s_acctbal as so_reputation, '2024-01-31 00:00:00' as so_last_crawled,
       s_name as q_name, s_suppkey * 1000 as q_num_views, '2024-01-31 00:00:00' as q_last_crawled from supplier""",
)
def project_networks(t: Tables):
    """The kept fields of records of the other two networks, side by side."""
    stamp = F.date_format(now(), "yyyy-MM-dd HH:mm:ss")
    name, number = F.col("s_name"), F.col("s_suppkey")
    records = t.supplier.select(number.alias("user_id"), name.alias("display_name"), F.col("s_acctbal").alias("reputation"), F.col("s_nationkey").alias("badge_counts"))
    profiles = t.supplier.select(name.alias("name"), (number * 1000).alias("num_views"), F.col("s_nationkey").alias("followers"))
    one, two = projections.project_prefixed(records, "so_", stamp), projections.project_prefixed(profiles, "q_", stamp)
    return one.join(two, F.col("so_display_name") == F.col("q_name"))


@case(
    "project_unprefixed",
    "select s_suppkey as user_id, s_name as display_name, s_acctbal as reputation, s_nationkey as other from supplier",
)
def project_unprefixed(t: Tables):
    rows = t.supplier.select(
        F.col("s_suppkey").alias("so_user_id"),
        F.col("s_name").alias("so_display_name"),
        F.col("s_acctbal").alias("so_reputation"),
        F.col("s_nationkey").alias("so_other"),
        F.col("s_name").alias("twitter_name"),
    )
    return projections.project_unprefixed(rows, "so_")


@case("tag_projection", "select p_name as name, p_size as count, p_brand as site from part")
def tag_projection(t: Tables):
    tags = t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("count"), F.col("p_brand").alias("site"), "p_type")
    return projections.project_tags(tags)


@case("filter_listed", with_views("select user_id, listed_count from profiles where listed_count > 10"))
def filter_listed(t: Tables):
    return t.profiles().where("listed_count > 10").select("user_id", "listed_count")


KEYS_SQL = """with k as (select case when p_partkey % 7 = 0 then 'topics:' || p_brand || ':' || p_partkey
    when p_partkey % 2 = 0 then 'a.com:' || p_name || ':' || p_partkey
    else 'a_com%' || p_name || ':' || p_partkey end as key from part) """


@case(
    "filter_key_pattern",
    KEYS_SQL
    + """select 'site' as test, key from k where key like '%.com:%' and not starts_with(key, 'topics')
         union all select 'literal', key from k where contains(key, 'a_com%')
         union all select 'prefix', key from k where starts_with(key, 'topics:')""",
)
def filter_key_pattern(t: Tables):
    n = F.col("p_partkey")
    key = (
        F.when(n % 7 == 0, concat("topics:", F.col("p_brand"), ":", n))
        .when(n % 2 == 0, concat("a.com:", F.col("p_name"), ":", n))
        .otherwise(concat("a_com%", F.col("p_name"), ":", n))
    )
    keys = t.part.select(key.alias("key"))
    k = F.col("key")
    site = keys.where(projections.key_matches(k, contains=".com:", not_prefix=["topics"]))
    literal = keys.where(projections.key_matches(k, contains="a_com%"))
    prefix = keys.where(projections.key_matches(k, prefix="topics:"))
    named = [df.select(F.lit(name).alias("test"), "key") for name, df in
             (("site", site), ("literal", literal), ("prefix", prefix))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@case(
    "filter_stale",
    """with c as (select user_id as url, max(ts) as last_crawled from events group by 1)
       select c_custkey as url from customer left join c on url = c_custkey
       where last_crawled is null or last_crawled <= timestamp '2024-01-31 00:00:00' - interval 12 hour""",
)
def filter_stale(t: Tables):
    """Pages (customers) never crawled, or not within twelve hours of a fixed now."""
    seen = t.events.groupBy(F.col("user_id").alias("url")).agg(F.max("ts").alias("last_crawled"))
    pages = t.customer.select(F.col("c_custkey").alias("url")).join(seen, "url", "left")
    return pages.where(vx.is_stale(F.col("last_crawled"), now(), 12 * 3600)).select("url")


@case("point_lookup", with_views("select user_id, listed_count from profiles where user_id = 42"))
def point_lookup(t: Tables):
    return projections.point_lookup(t.profiles().select("user_id", "listed_count"), "user_id", 42)


@case(
    "batch_lookup",
    with_views("select user_id, screen_name from profiles where user_id in (select s_suppkey from supplier)"),
)
def batch_lookup(t: Tables):
    ids = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    return projections.batch_lookup(t.profiles().select("user_id", "screen_name"), ids, "user_id")


STATUS = {"error": 404, "click": 301, "view": 200, "signup": 403, "purchase": 429}


@case(
    "route_status",
    """select event_id, case event_type when 'error' then 'blacklist' when 'click' then 'blacklist'
       when 'signup' then 'stop' when 'purchase' then 'stop' else 'parse' end as route from events""",
)
def route_status(t: Tables):
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    return t.events.select("event_id", vx.fetch_route(status).alias("route"))


@case(
    "crawl_stamp",
    """select user_id as url, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_crawled from events
       where event_type <> 'error' group by 1""",
)
def crawl_stamp(t: Tables):
    """Last successful fetch of every page."""
    done = t.events.where("event_type <> 'error'").groupBy(F.col("user_id").alias("url"))
    return done.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_crawled"))


@case(
    "semi_matched",
    with_views(
        """select topic, expert, round(score, 6) as score from q_topic_experts
           where expert in (select expert from crosswalk)"""
    ),
)
def semi_matched(t: Tables):
    kept = t.q_topic_experts().join(t.crosswalk(), "expert", "left_semi")
    return kept.select("topic", "expert", F.round("score", 6).alias("score"))


@case(
    "anti_blacklist",
    """select page_id from pages where regexp_extract(url, '^https?://([^/]+)', 1) not in
       (select regexp_extract(url, '^https?://([^/]+)', 1) from pages where page_id % 10 = 0)""",
)
def anti_blacklist(t: Tables):
    """Pages of hosts that were blacklisted (those of every tenth page) are left out."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    pages = t.pages.select("page_id", host.alias("host"))
    blacklist = pages.where(F.col("page_id") % 10 == 0).select("host")
    return pages.join(blacklist, "host", "left_anti").select("page_id")


# ---- order, pages, samples ----


@case(
    "paginate",
    """select o_orderkey, (row_number() over (order by o_totalprice desc, o_orderkey) - 1) // 100 + 1 as page
       from orders""",
)
def paginate(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return paging.paginate(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "page")


@case(
    "offset_batch",
    with_views("select user_id, listed_count from profiles where listed_count > 10 order by user_id limit 50 offset 20"),
)
def offset_batch(t: Tables):
    """One batch of the users in order, from an order stored before."""
    listed = t.profiles().where("listed_count > 10").select("user_id", "listed_count")
    stored_order = StoredOrder.build(listed, [F.col("user_id")], new_path(t.spark, "user-order"))
    return stored_order.page(t.spark, 20, 50)


@case(
    "seek_pages",
    """select o_orderkey, page from (select o_orderkey, n // 25 as page, o_total from (
         select o_orderkey, o_totalprice as o_total, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as n,
         count(*) over () as total from orders) where n < 25 or n // 25 = (total // 2) // 25 or n // 25 = (total - 1) // 25)""",
)
def seek_pages(t: Tables):
    """The first, the middle and the last page of all orders by price."""
    rows = t.orders.select("o_orderkey", "o_totalprice")
    pages = StoredOrder.build(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], new_path(t.spark, "price-order"), range_rows=4096)
    total = pages.total(t.spark)
    chosen = sorted({0, total // 2 // 25, max(total - 1, 0) // 25})
    found = [pages.page(t.spark, 25 * n, 25).select("o_orderkey", F.lit(n).cast("bigint").alias("page")) for n in chosen]
    out = found[0]
    for page in found[1:]:
        out = out.unionByName(page)
    return out


@case(
    "top_k_sort",
    """select o_orderkey, round(o_totalprice, 2) as price from orders order by o_totalprice desc, o_orderkey limit 25""",
)
def top_k_sort(t: Tables):
    best = paging.top_k(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 25)
    return best.select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@case(
    "sample_per_group",
    """select c_nationkey, c_custkey as handle from (select *, row_number() over (partition by c_nationkey
       order by md5('7|' || c_custkey), c_custkey) as rn from customer) where rn = 1""",
)
def sample_per_group(t: Tables):
    rows = t.customer.withColumnRenamed("c_custkey", "handle")
    return paging.sample_per_group(rows, ["c_nationkey"], "handle", seed=7)


@case(
    "join_lists",
    with_views(
        """select user_id, count(*) as lists, sum(length(name || ' ' || description)) as letters
           from member_of join lists using (list_id) group by 1"""
    ),
)
def join_lists(t: Tables):
    from savanto.operators.topics import list_texts

    sizes = list_texts(t.lists()).select("list_id", F.length("text").alias("n"))
    joined = t.member_of().join(sizes, "list_id")
    return joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("letters"))


@case(
    "append_edges",
    with_views("select follower, followee, count(*) as n from (select * from follows union all select * from follows) group by 1, 2"),
)
def append_edges(t: Tables):
    """The follow graph appended to a table twice."""
    path = new_path(t.spark, "edge-table")
    for _ in range(2):
        stored.append_edges(t.follows(), path)
    return t.spark.read.parquet(path).groupBy("follower", "followee").agg(F.count(F.lit(1)).alias("n"))


@case(
    "declared_fields",
    """select conv_id as id, count(*) as n_turns, string_agg(upper(role) || ':' || length(text), '|' order by turn) as turns
       from conversations group by 1""",
)
def declared_fields(t: Tables):
    """Conversations as records with a list of turns: renamed, converted, lists field by field."""
    records = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    fields = [
        projections.Field("id", "conv_id"),
        projections.Field("n_turns", "turns", lambda c: F.size(c).cast("bigint")),
        projections.Field("turns", many=(projections.Field("speaker", "role", F.upper), projections.Field("length", "text", F.length))),
    ]
    rows = projections.declared(records, fields)
    shown = F.transform("turns", lambda x: F.concat_ws(":", x["speaker"], x["length"].cast("string")))
    return rows.select("id", "n_turns", F.array_join(shown, "|").alias("turns"))


@case(
    "seeded_shuffle",
    """select user_id, row_number() over (order by md5('7|' || user_id), user_id) as place
       from (select distinct c_custkey as user_id from customer)""",
)
def seeded_shuffle(t: Tables):
    """Every customer with its place in a repeatable random order."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    return global_rank(users, paging.shuffle_order("user_id", 7), "place").select("user_id", "place")
