"""Question-and-answer queries. Orders play questions, their lines answers, part names and brands tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.operators import qa as op
from savanto.operators.paging import top_k
from savanto.suite.registry import Tables, case, with_views
from savanto.suite.scalars import concat


def questions(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("creation_date"),
    )


def answers(t: Tables):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"),
        F.col("l_orderkey").alias("question_id"),
        F.col("l_suppkey").alias("owner"),
        (F.col("l_quantity").cast("bigint") - 25).alias("score"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 3)).alias("is_accepted"),
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").alias("ts"),
    )


QA = [
    ("questions", "select o_orderkey as question_id, o_custkey as owner, o_orderdate as creation_date from orders"),
    (
        "answers",
        """select l_orderkey * 10 + l_linenumber as answer_id, l_orderkey as question_id, l_suppkey as owner,
           cast(l_quantity as bigint) - 25 as score, l_returnflag = 'A' and l_linenumber > 3 as is_accepted,
           l_partkey as part, l_shipdate as ts from lineitem""",
    ),
    (
        "tagged",
        """select p_name as tag, owner as user_id, answer_id as post_id, score, ts
           from answers join part on p_partkey = part""",
    ),
    ("post_tags", "select distinct question_id as post_id, p_brand as tag from answers join part on p_partkey = part"),
]


def tagged(t: Tables):
    parts = t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("tag"))
    return answers(t).join(parts, "part").select(
        "tag", F.col("owner").alias("user_id"), F.col("answer_id").alias("post_id"), "score", "ts"
    )


def post_tags(t: Tables):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag"))
    return t.lineitem.join(parts, "l_partkey").select(F.col("l_orderkey").alias("post_id"), "tag").distinct()


@case(
    "privileges_range_join",
    """select c_custkey as user_id, cast(floor(c_acctbal) as bigint) as reputation, n_name as privilege
       from customer join nation on n_nationkey * 400 <= floor(c_acctbal)""",
)
def privileges_range_join(t: Tables):
    users = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.floor("c_acctbal").cast("bigint").alias("reputation")
    )
    steps = t.nation.select(F.col("n_name").alias("short_description"), (F.col("n_nationkey") * 400).alias("reputation"))
    return op.privileges_of(users, steps)


REPUTATION = [
    (
        "reps",
        """select user_id, event_type as site, cast(sum(cast(round(value * 100) as bigint)) as bigint) as reputation
           from events group by 1, 2""",
    ),
    (
        "sites",
        """select user_id - user_id % 2 as user_1, user_id - user_id % 2 + 1 as user_2, site,
           sum(case when user_id % 2 = 0 then reputation else 0 end) as r1,
           sum(case when user_id % 2 = 1 then reputation else 0 end) as r2 from reps group by 1, 2, 3""",
    ),
]


@case(
    "versus",
    with_views(
        """select user_1, user_2, site, case when r2 > r1 then user_2 else user_1 end as winner,
           cast(abs(r1 - r2) as bigint) as margin from (select * from sites union all
             select user_1, user_2, null, sum(r1), sum(r2) from sites group by 1, 2)""",
        *REPUTATION,
    ),
)
def versus(t: Tables):
    """Even users against their odd neighbours; event types are sites, summed cents reputation."""
    reps = t.events.groupBy("user_id", F.col("event_type").alias("site")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("reputation")
    )
    even = (F.col("user_id") - F.col("user_id") % 2).alias("user_1")
    pairs = t.events.select(even).distinct().select("user_1", (F.col("user_1") + 1).alias("user_2"))
    return op.versus(reps, pairs)


@case(
    "fk_deref",
    with_views(
        """select answer_id, question_id, c_name as asker, s_name as answerer from answers
           left join questions q using (question_id) left join customer on c_custkey = q.owner
           left join supplier on s_suppkey = answers.owner""",
        *QA[:2],
    ),
)
def fk_deref(t: Tables):
    rows = answers(t).select("answer_id", "question_id", F.col("owner").alias("answerer_id"))
    rows = op.deref(rows, questions(t).select("question_id", F.col("owner").alias("asker_id")), "question_id", "question_id")
    rows = op.deref(rows, t.customer.select("c_custkey", F.col("c_name").alias("asker")), "asker_id", "c_custkey")
    rows = op.deref(rows, t.supplier.select("s_suppkey", F.col("s_name").alias("answerer")), "answerer_id", "s_suppkey")
    return rows.select("answer_id", "question_id", "asker", "answerer")


@case(
    "typed_deref",
    """select event_id, event_type as type, case when event_type in ('click', 'view') then o_orderpriority
       when event_type = 'error' then role when event_type = 'signup' then n_name end as value
       from events left join orders on o_orderkey = event_id
       left join conversations on conv_id * 1000 + turn = event_id
       left join nation on n_nationkey = event_id""",
)
def typed_deref(t: Tables):
    events = t.events.select("event_id", F.col("event_type").alias("type"), F.col("event_id").alias("ref"))
    posts = t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("value"))
    notes = t.items().select(F.col("item_id").alias("ref"), F.col("role").alias("value"))
    badges = t.nation.select(F.col("n_nationkey").cast("bigint").alias("ref"), F.col("n_name").alias("value"))
    found = op.typed_deref(
        events, {"post": (["click", "view"], posts), "comment": (["error"], notes), "badge": (["signup"], badges)}
    )
    return found.select("event_id", "type", "value")


SYNONYMS = """select distinct p_brand as from_tag, case when length(p_brand) = 7 then 'Brand' end as to_tag from part
    where length(p_brand) = 7"""


@case(
    "tag_canonical",
    with_views(
        """select coalesce(to_tag, tag) as tag, count(*) as posts from post_tags
           left join syn on from_tag = tag group by 1""",
        *QA,
        ("syn", SYNONYMS),
    ),
)
def tag_canonical(t: Tables):
    """One-digit brands are synonyms of a master tag."""
    one_digit = t.part.where(F.length("p_brand") == 7).select(F.col("p_brand").alias("from_tag")).distinct()
    rows = op.canonical_tags(post_tags(t), one_digit.withColumn("to_tag", F.lit("Brand")))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("posts"))


ASKED = ("asked", "select o_orderkey as post_id from orders order by o_totalprice desc, o_orderkey limit 5")


def asked(t: Tables):
    """The five dearest orders."""
    best = top_k(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return best.select(F.col("o_orderkey").alias("post_id"))


@case(
    "related_items",
    with_views(
        """select post_id, related_id, shared from (select a.post_id, b.post_id as related_id, count(*) as shared,
             row_number() over (partition by a.post_id order by count(*) desc, b.post_id) as rn
             from post_tags a join post_tags b on a.tag = b.tag and a.post_id <> b.post_id
             where a.post_id in (select post_id from asked) group by 1, 2) where rn <= 10""",
        *QA,
        ASKED,
    ),
)
def related_items(t: Tables):
    return op.related_posts(post_tags(t), asked(t))


@case(
    "linked_items",
    with_views(
        """select o_orderkey as post_id, o_custkey as owner from orders where o_orderkey in (
           select l_partkey from lineitem where l_orderkey in (select post_id from asked))""",
        ASKED,
    ),
)
def linked_items(t: Tables):
    links = t.lineitem.select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("linked_id"))
    posts = t.orders.select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("owner"))
    return op.linked_posts(links, posts, asked(t))


ACCOUNTS = """select c_custkey as account_id, 'c' as site, case when c_acctbal > 0 then 'http://c.example.com' end as site_url,
      c_custkey as user_id, c_acctbal as reputation from customer
    union all select s_suppkey, 's', 'http://s.example.com', s_suppkey, s_acctbal from supplier"""


def accounts(t: Tables):
    c = t.customer.select(
        F.col("c_custkey").alias("account_id"),
        F.lit("c").alias("site"),
        F.when(F.col("c_acctbal") > 0, F.lit("http://c.example.com")).alias("site_url"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_acctbal").alias("reputation"),
    )
    s = t.supplier.select(
        F.col("s_suppkey").alias("account_id"),
        F.lit("s").alias("site"),
        F.lit("http://s.example.com").alias("site_url"),
        F.col("s_suppkey").alias("user_id"),
        F.col("s_acctbal").alias("reputation"),
    )
    return c.unionByName(s)


@case(
    "associated_accounts",
    f"""select * from ({ACCOUNTS}) where site_url is not null and account_id in (select s_suppkey from supplier)""",
)
def associated_accounts(t: Tables):
    return op.associated_accounts(accounts(t), t.supplier.select(F.col("s_suppkey").alias("account_id")))


@case("argmax_site", f"select account_id, arg_max(site, (reputation, site)) as site from ({ACCOUNTS}) group by 1")
def argmax_site(t: Tables):
    return op.best_site(accounts(t))


@case(
    "site_stats",
    with_views(
        """select (select count(*) from questions) as total_questions, u.n as total_unanswered,
             (select count(*) from answers) as total_answers,
             (select count_if(is_accepted) from answers) as total_accepted,
             round(u.n * 100.0 / (select count(*) from questions), 6) as percent_unanswered
           from (select count(*) as n from questions where question_id not in (select question_id from answers)) u""",
        *QA[:2],
    ),
)
def site_stats(t: Tables):
    stats = op.site_stats(questions(t), answers(t))
    return stats.withColumn("percent_unanswered", F.round("percent_unanswered", 6))


@case(
    "accept_rate",
    with_views(
        """select owner, count(*) as questions, round(count_if(question_id in (select question_id from answers
             where is_accepted)) * 100.0 / count(*), 6) as rate from questions group by 1""",
        *QA[:2],
    ),
)
def accept_rate(t: Tables):
    return op.accept_rates(questions(t), answers(t)).withColumn("rate", F.round("rate", 6))


@case(
    "user_tag_stats",
    with_views(
        """select coalesce(q.user_id, a.user_id) as user_id, coalesce(q.tag, a.tag) as tag,
             coalesce(qn, 0) as question_count, coalesce(qs, 0) as question_score,
             coalesce(an, 0) as answer_count, coalesce(ans, 0) as answer_score
           from (select o_custkey as user_id, p_name as tag, count(*) as qn, cast(sum(l_linenumber) as bigint) as qs
               from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1, 2) q
           full join (select user_id, tag, count(*) as an, cast(sum(score) as bigint) as ans from tagged group by 1, 2) a
             on q.user_id = a.user_id and q.tag = a.tag""",
        *QA,
    ),
)
def user_tag_stats(t: Tables):
    return op.user_tag_stats(asked_tags(t), tagged(t))


def asked_tags(t: Tables):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("tag"))
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, "l_partkey")
    return rows.select(F.col("o_custkey").alias("user_id"), "tag", F.col("l_linenumber").cast("bigint").alias("score"))


@case(
    "top_tags",
    with_views(
        """select user_id, arg_max(tag, (s, tag)) as tag from (select user_id, tag, sum(score) as s
           from tagged group by 1, 2) group by 1""",
        *QA,
    ),
)
def top_tags(t: Tables):
    rows = tagged(t)
    return op.top_tags(op.user_tag_stats(rows.where("false"), rows), "answer_score")


@case("tag_counts", with_views("select tag, count(*) as count from post_tags group by 1", *QA))
def tag_counts(t: Tables):
    return op.tag_counts(post_tags(t))


@case(
    "tag_cooccurrence",
    with_views(
        """select b.tag, count(*) as count from post_tags a join post_tags b on a.post_id = b.post_id
           where a.tag = 'Brand#1' and b.tag <> 'Brand#1' group by 1""",
        *QA,
    ),
)
def tag_cooccurrence(t: Tables):
    return op.related_tags(post_tags(t), "Brand#1")


@case(
    "badge_recipients",
    """select event_type as name, user_id, count(*) as awards from events
       where event_type in ('click', 'view') group by 1, 2""",
)
def badge_recipients(t: Tables):
    """Event types play badges; clicks and views are tag-based."""
    awards = t.events.select(F.col("event_type").alias("badge_id"), "user_id")
    badges = t.events.select(F.col("event_type").alias("badge_id"), F.col("event_type").alias("name")).distinct()
    badges = badges.withColumn("tag_based", F.col("name").isin("click", "view"))
    return op.badge_recipients(awards, badges, tag_based=True)


TOP_SQL = """select tag, user_id, score, post_count, place from (select tag, user_id, cast(sum(score) as bigint) as score,
    count(*) as post_count, row_number() over (partition by tag order by sum(score) desc, user_id) as place
    from tagged {where} group by 1, 2) where place <= 5"""


@case("top_answerers", with_views(TOP_SQL.format(where=""), *QA))
def top_answerers(t: Tables):
    return op.top_users(tagged(t), 5)


@case(
    "top_askers",
    with_views(
        """select tag, user_id, score, post_count, place from (select *, row_number() over (partition by tag
             order by score desc, user_id) as place from (
               select o_orderpriority as tag, o_custkey as user_id, sum(n) as score, count(*) as post_count
               from orders join (select question_id, count(*) as n from answers group by 1) on question_id = o_orderkey group by 1, 2))
           where place <= 5""",
        *QA[1:2],
    ),
)
def top_askers(t: Tables):
    """Who asked the most answered questions of every priority."""
    n = answers(t).groupBy("question_id").agg(F.count(F.lit(1)).alias("score"))
    asked = t.orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("user_id"))
    return op.top_users(asked.join(n, "question_id").select("tag", "user_id", "score"), 5)


@case("users_named", "select c_custkey as user_id, c_name as name from customer where contains(lower(c_name), 'r#00000001')")
def users_named(t: Tables):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return op.users_named(users, "R#00000001")


@case(
    "top_answerers_month",
    with_views(
        TOP_SQL.format(where="where ts between timestamp '1998-11-01 00:00:00' and timestamp '1998-12-01 00:00:00'"), *QA
    ),
)
def top_answerers_month(t: Tables):
    now = F.lit("1998-12-01 00:00:00").cast("timestamp_ntz")
    return op.top_users(op.in_period(tagged(t), "ts", "month", now), 5)


@case(
    "top_in_tag",
    with_views(
        """select tag, user_id, post_id, score, place from (select tag, user_id, post_id, score,
           row_number() over (partition by user_id, tag order by score desc, post_id) as place from tagged)
           where place <= 2""",
        *QA,
    ),
)
def top_in_tag(t: Tables):
    return op.top_in_tag(tagged(t).drop("ts"), 2)


@case(
    "experts_per_tag",
    with_views(
        f"""select tag as topic, user_id as expert, score from ({TOP_SQL.format(where="")})
            where user_id in (select c_custkey from customer where c_acctbal > 0)""",
        *QA,
    ),
)
def experts_per_tag(t: Tables):
    matched = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("expert"))
    return op.experts_per_tag(tagged(t), matched, 5).select("topic", "expert", "score")


@case(
    "recent_items",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, substr(o_orderpriority, 1, 4) as summary
       from orders order by o_orderdate desc, o_orderkey limit 10""",
)
def recent_items(t: Tables):
    rows = op.recent(t.orders, "o_orderdate", "o_orderkey", 10, 4, "o_orderpriority")
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "summary")


@case(
    "union_sites",
    """select c_custkey as user_id, c_name as name, c_mktsegment as segment from customer
       union all select s_suppkey, s_name, null from supplier""",
)
def union_sites(t: Tables):
    one = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return op.both_sites(one, t.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name")))


@case(
    "unanswered",
    with_views(
        """select 'answers' as missing, question_id from questions where question_id not in (select question_id from answers)
           union all select 'upvoted', question_id from questions where question_id not in
             (select question_id from answers where score > 0 or is_accepted)
           union all select 'accepted', question_id from questions where question_id not in
             (select question_id from answers where is_accepted)""",
        *QA[:2],
    ),
)
def unanswered(t: Tables):
    q, a = questions(t), answers(t)
    parts = [
        op.without(q, a, what).select(F.lit(what).alias("missing"), "question_id")
        for what in ("answers", "upvoted", "accepted")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case(
    "search_items",
    """select o_orderkey from (select *, [o_orderpriority, o_orderstatus] as tags,
         'Order ' || o_orderpriority || ' of ' || o_custkey as title from orders)
       where contains(lower(title), 'high of 1') and list_has_any(tags, ['F', 'O'])
       and not list_has_any(tags, ['5-LOW', 'P']) and o_orderdate >= timestamp '1994-01-01 00:00:00'
       and o_orderdate <= timestamp '1998-12-31 00:00:00'""",
)
def search_items(t: Tables):
    items = t.orders.select(
        "o_orderkey",
        concat("Order ", F.col("o_orderpriority"), " of ", F.col("o_custkey")).alias("title"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.col("o_orderdate").alias("creation_date"),
    )
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1994-01-01 00:00:00", "1998-12-31 00:00:00"))
    return op.search(items, "HIGH of 1", ["F", "O"], ["5-LOW", "P"], low, high).select("o_orderkey")


@case(
    "keyed_lookup",
    with_views(
        """select item_id, role from items where conv_id in (select doc_id from labels where quality = 1)"""
    ),
)
def keyed_lookup(t: Tables):
    """Turns of the conversations whose number is labelled good."""
    keys = t.labels.where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return op.lookup(t.items(), keys, "conv_id").select("item_id", "role")


COMMENTS = """select o_custkey as owner_id, l_suppkey as reply_to_id, l_orderkey * 10 + l_linenumber as comment_id
    from orders join lineitem on l_orderkey = o_orderkey"""


def comments(t: Tables):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("owner_id"),
        F.col("l_suppkey").alias("reply_to_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"),
    )


@case("comments_between", f"select * from ({COMMENTS}) where owner_id = reply_to_id + 1")
def comments_between(t: Tables):
    """From each customer to the supplier one number lower."""
    pairs = t.supplier.select((F.col("s_suppkey") + 1).alias("owner_id"), F.col("s_suppkey").alias("reply_to_id"))
    return op.comments_between(comments(t), pairs)


@case("mentions", f"select reply_to_id as user_id, count(*) as mentions from ({COMMENTS}) group by 1")
def mentions(t: Tables):
    return op.mentions(comments(t))


@case(
    "favorited_by",
    with_views("select list_id as question_id, name from lists where list_id in (select list_id from member_of where user_id = 7)"),
)
def favorited_by(t: Tables):
    favorites = t.member_of().withColumnRenamed("list_id", "question_id")
    questions_ = t.lists().select(F.col("list_id").alias("question_id"), "name")
    return op.favorited_by(questions_, favorites, 7)


@case(
    "moderators",
    "select c_custkey as user_id from customer where c_mktsegment = 'BUILDING'",
)
def moderators(t: Tables):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("moderator")).otherwise(F.lit("registered"))
    return op.moderators(t.customer.select(F.col("c_custkey").alias("user_id"), kind.alias("user_type"))).select("user_id")


def sort_sql() -> str:
    columns = {"activity": "activity", "views": "views", "creation": "creation_date", "votes": "votes"}
    return " union all ".join(
        f"""select * from (select '{sort}' as sort, question_id, row_number() over (order by {column} desc, question_id) as place
            from i) where place <= 10"""
        for sort, column in columns.items()
    )


ITEMS_SQL = """select question_id, o.creation_date, count(*) as views, max(ts) as activity, sum(score) as votes
    from questions o join answers using (question_id) group by 1, 2"""


@case("items_sorted", with_views(sort_sql(), *QA[:2], ("i", ITEMS_SQL)))
def items_sorted(t: Tables):
    """The first ten questions by each of the four sorts."""
    totals = answers(t).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("view_count"), F.max("ts").alias("last_activity"), F.sum("score").alias("score")
    )
    items = questions(t).join(totals, "question_id")
    parts = []
    for sort in op.SORTS:
        first = op.sorted_by(items, sort, "question_id").limit(10).agg(F.collect_list("question_id").alias("ids"))
        # ten ids in the order of the sort
        parts.append(first.select(F.lit(sort).alias("sort"), F.posexplode("ids").alias("at", "question_id")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.select("sort", "question_id", (F.col("at") + 1).cast("bigint").alias("place"))


@case(
    "asked_by",
    with_views("select question_id, owner from questions where owner in (select s_suppkey from supplier)", *QA[:1]),
)
def asked_by(t: Tables):
    """Questions of the customers that have a supplier's number."""
    return op.asked_by(questions(t), t.supplier.select(F.col("s_suppkey").alias("owner"))).select("question_id", "owner")


@case(
    "answered_by",
    with_views(
        """select question_id, owner from questions where question_id in (select question_id from answers
           where owner in (select s_suppkey from supplier where s_acctbal > (select avg(s_acctbal) from supplier)))""",
        *QA[:2],
    ),
)
def answered_by(t: Tables):
    """Questions answered by the suppliers whose balance is above the average."""
    mean = t.supplier.agg(F.avg("s_acctbal").alias("mean")).first()[0]
    users = t.supplier.where(F.col("s_acctbal") > F.lit(mean)).select(F.col("s_suppkey").alias("owner"))
    return op.answered_by(questions(t), answers(t), users).select("question_id", "owner")


@case(
    "timeline",
    with_views(
        """select 'question' as timeline_type, question_id as post_id, owner as user_id, creation_date from questions
           union all select 'answer', answer_id, owner, ts from answers
           union all select 'accepted_answer', answer_id, owner, ts from answers where is_accepted""",
        *QA[:2],
    ),
)
def timeline(t: Tables):
    rows = answers(t)
    parts = [
        op.timeline(questions(t), "question", "question_id", "owner", "creation_date"),
        op.timeline(rows, "answer", "answer_id", "owner", "ts"),
        op.timeline(rows.where("is_accepted"), "accepted_answer", "answer_id", "owner", "ts"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case(
    "revisions",
    with_views(
        """select question_id as post_id, row_number() over (partition by question_id order by ts, answer_id, owner) as revision_number,
           owner as user_id, ts as creation_date from answers""",
        *QA[1:2],
    ),
)
def revisions(t: Tables):
    """Lines play edits of their order."""
    edits = answers(t).select(
        F.col("question_id").alias("post_id"), F.col("owner").alias("user_id"), F.col("ts").alias("creation_date"), F.col("answer_id").alias("revision_id")
    )
    return op.revisions(edits)


@case(
    "synonym_list",
    with_views(
        """select from_tag, to_tag, count(tag) as applied_count from syn left join post_tags on tag = from_tag group by 1, 2""",
        *QA,
        ("syn", SYNONYMS),
    ),
)
def synonym_list(t: Tables):
    one_digit = t.part.where(F.length("p_brand") == 7).select(F.col("p_brand").alias("from_tag")).distinct()
    return op.synonym_list(one_digit.withColumn("to_tag", F.lit("Brand")), post_tags(t))
