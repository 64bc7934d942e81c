"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.functions import values as vx
from savanto.functions import html as hx
from savanto.suite.registry import Tables, case

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def concat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@case(
    "key_namespace",
    """select 'example.com:' || p_name || ':' || p_partkey as key, 'example.com' as site, p_name as name,
       'quora:expert:' || p_partkey as moved, cast(null as varchar) as missing from part""",
)
def key_namespace(t: Tables):
    key = tx.namespaced(F.lit("example.com"), F.col("p_name"), F.col("p_partkey").cast("string"))
    return t.part.select(
        key.alias("key"),
        tx.key_part(key, 0).alias("site"),
        tx.key_part(key, 1).alias("name"),
        tx.rekey(key, "quora:expert").alias("moved"),
        tx.key_part(key, 7).alias("missing"),
    )


@case(
    "topic_label",
    """select p_partkey, lower(split_part(p_name, ' ', 1)) || ' ' || p_brand || '-' || p_type as label,
       lower(split_part(p_name, ' ', 1) || ' ' || p_brand || ' ' || p_type) as normal from part""",
)
def topic_label(t: Tables):
    words = F.split("p_name", " ")
    label = tx.topic_label(concat(words[0], ".example.com"), concat(F.col("p_brand"), "-", F.col("p_type")))
    return t.part.select("p_partkey", label.alias("label"), tx.normal_label(label).alias("normal"))


@case(
    "slug",
    """select item_id, replace(replace(replace(replace(text, ' ', '-'), ',', ''), '.', '-'), '/', '-') as slug,
       replace(replace(replace(replace(replace(text, ' ', '-'), ',', ''), '.', '-'), '/', '-'), '-', ' ') as topic,
       replace(text, ' ', '-') as profile from benchmark""",
)
def slug(t: Tables):
    s = tx.topic_slug(F.col("text"))
    return t.benchmark.select(
        "item_id", s.alias("slug"), tx.slug_topic(s).alias("topic"), tx.profile_slug(F.col("text")).alias("profile")
    )


@case(
    "parse_count",
    """select event_id, cast(trunc(value) as bigint) as plain, cast(trunc(value * 1000) as bigint) as thousands,
       cast(trunc(value * 1000000) as bigint) as millions, cast(trunc(value * 100) as bigint) as hundreds,
       cast(null as bigint) as bad, event_id * 1001 as grouped, event_id * 1001 as second
       from events""",
)
def parse_count(t: Tables):
    text = F.col("value").cast("string")
    grouped = F.format_string("%,d", F.col("event_id") * 1001)
    return t.events.select(
        "event_id",
        vx.abbreviated_count(F.col("value").cast("bigint").cast("string")).alias("plain"),
        vx.abbreviated_count(concat(text, "k")).alias("thousands"),
        vx.abbreviated_count(concat(text, "m")).alias("millions"),
        vx.abbreviated_count(text).alias("hundreds"),
        vx.abbreviated_count(concat(text, "K")).alias("bad"),
        vx.grouped_int(grouped).alias("grouped"),
        vx.second_word_int(concat("All ", grouped, " answers")).alias("second"),
    )


@case(
    "signature_distance",
    """with p as (select a.vec_id, a.embedding as x, b.embedding as y
         from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1),
       n as (select vec_id,
         sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1]::double - z[2]::double) ** 2))) as gap,
         sqrt(list_sum(list_transform(x, lambda z: z::double ** 2))) as nx,
         sqrt(list_sum(list_transform(y, lambda z: z::double ** 2))) as ny, y is null as alone from p)
       select vec_id, round(case when alone then 1.0 else gap / (nx + ny) end, 6) as distance from n""",
)
def signature_distance(t: Tables):
    """Each signature against the next one; the last has no partner."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    d = vx.signature_distance(F.col("x"), F.col("y"))
    return a.join(b, "vec_id", "left").select("vec_id", F.round(d, 6).alias("distance"))


@case(
    "epoch_ts",
    """select event_id, strftime(to_timestamp(1700000000 + event_id * 977) at time zone 'UTC',
       '%Y-%m-%d %H:%M:%S') as stamp from events""",
)
def epoch_ts(t: Tables):
    seconds = (F.col("event_id") * 977 + 1700000000).cast("string").cast("double")
    # the text is formatted in UTC whatever the session's zone
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return t.events.select("event_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@case(
    "relative_age",
    f"""with d as (select event_id, ts, date_diff('microsecond', ts, timestamp '{NOW}') // 1000000 as s from events)
        select event_id, case when s < 60 then s || ' second' || if(s = 1, '', 's') || ' ago'
          when s < 3600 then s // 60 || ' minute' || if(s = 60, '', 's') || ' ago'
          when s < 86400 then s // 3600 || ' hour' || if(s = 3600, '', 's') || ' ago'
          when s < 172800 then 'yesterday' else strftime(ts, '%b %-d / %y - %H:%M') end as age from d""",
)
def relative_age(t: Tables):
    return t.events.select("event_id", vx.relative_age(F.col("ts"), now()).alias("age"))


@case(
    "format_reputation",
    """with r as (select o_orderkey, cast(floor(o_totalprice * (case when o_orderkey % 3 = 0 then 1 else 0.01 end))
         as bigint) as rep from orders)
       select o_orderkey, rep, case when rep < 1000 then rep::varchar
         when rep < 10000 then substr(rep::varchar, 1, 1) || ',' || substr(rep::varchar, 2)
         when rep % 1000 = 0 then (rep // 1000) || 'k' else printf('%.1fk', rep / 1000.0::double) end as text from r""",
)
def format_reputation(t: Tables):
    factor = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.01))
    rows = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") * factor).cast("bigint").alias("rep"))
    return rows.withColumn("text", vx.reputation_text(F.col("rep")))


@case(
    "enum_map",
    """select event_id, case event_type when 'click' then 'Click' when 'view' then 'View'
       when 'signup' then 'SignUp' else event_type end as name,
       case event_type when 'purchase' then 'VoteBased' else event_type || '_x' end as snake from events""",
)
def enum_map(t: Tables):
    kind = F.col("event_type")
    snake = F.when(kind == "purchase", F.lit("vote_based")).otherwise(concat(kind, "_x"))
    return t.events.select(
        "event_id",
        vx.enum_name(kind, ["Click", "View", "SignUp"], {"signup": "SignUp"}).alias("name"),
        vx.enum_name(snake, ["SingleUser", "VoteBased"]).alias("snake"),
    )


@case(
    "reputation_delta",
    """select l_orderkey, l_linenumber, cast(l_quantity as bigint) - l_linenumber as net,
       cast(l_quantity as bigint) || '/' || l_linenumber as votes,
       l_linenumber + case when l_returnflag = 'A' then 2 else 0 end as badge_total from lineitem""",
)
def reputation_delta(t: Tables):
    up, down = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    counts = F.map_from_arrays(F.array(F.lit("gold"), F.col("l_returnflag")), F.array(down, F.lit(2).cast("bigint")))
    medals = [F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)) for k in ("gold", "A", "bronze")]
    votes = F.struct(up.alias("up"), down.alias("down"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (up - down).alias("net"),
        F.concat_ws("/", votes["up"].cast("string"), votes["down"].cast("string")).alias("votes"),
        sum(medals[1:], medals[0]).alias("badge_total"),
    )


@case(
    "object_urls",
    """select item_id, 'http://example.com/users/' || conv_id as user_url,
       'http://example.com/questions/' || conv_id as question_url,
       'http://example.com/questions/' || conv_id || '/' || item_id || '#' || item_id as answer_url
       from (select conv_id * 1000 + turn as item_id, conv_id from conversations)""",
)
def object_urls(t: Tables):
    site = F.lit("example.com")
    return t.items().select(
        "item_id",
        vx.user_url(site, F.col("conv_id")).alias("user_url"),
        vx.question_url(site, F.col("conv_id")).alias("question_url"),
        vx.answer_url(site, F.col("conv_id"), F.col("item_id")).alias("answer_url"),
    )


def between_sql(opening: str, closing: str) -> str:
    """The text between two marks, tags cut out and references decoded, without a pattern for elements."""
    inner = f"split_part(split_part(html, '{opening}', 2), '{closing}', 1)"
    plain = f"regexp_replace({inner}, '<[^<>]+>', '', 'g')"
    for mark, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        plain = f"replace({plain}, '&{mark};', '{char}')"
    return f"case when contains(html, '{opening}') then {plain} end"


@case(
    "html_fields",
    f"""select page_id, {between_sql("<title>", "</title>")} as title, {between_sql("<h1>", "</h1>")} as heading,
        {between_sql('<div class="ad">', "</div>")} as box, {between_sql("<article>", "</article>")} as body from pages""",
)
def html_fields(t: Tables):
    html = F.col("html")
    return t.pages.select(
        "page_id",
        hx.first_text(html, "title").alias("title"),
        hx.first_text(html, "h1").alias("heading"),
        hx.first_text(html, "div", "ad").alias("box"),
        hx.first_text(html, "article").alias("body"),
    )


@case(
    "html_items",
    """select page_id, cast(generate_subscripts(h, 1) - 1 as integer) as position, unnest(h) as target, unnest(x) as label
       from (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) as h,
         regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) as x from pages)""",
)
def html_items(t: Tables):
    items = hx.page_items(t.pages, "page_id", "html", ("li", ""), {"target": ("a", "", "href"), "label": ("a", "", "text")})
    return items.select("page_id", "position", "target", "label")


def marked_pages(t: Tables):
    """Pages whose menu entries to words in ``th`` are related topics, and those to ``in`` the next page."""
    html = F.replace("html", F.lit('<li><a href="/th'), F.lit('<li><a class="topic related" href="/th'))
    return t.pages.withColumn("html", F.replace(html, F.lit('<li><a href="/in"'), F.lit('<li><a rel="next" href="/in"')))


@case(
    "related_links",
    """select page_id, unnest(regexp_extract_all(html, '<li><a href="(/th[^"]*)"', 1)) as target from pages""",
)
def related_links(t: Tables):
    return marked_pages(t).select("page_id", F.explode(hx.links_with_class(F.col("html"), "related")).alias("target"))


@case(
    "next_page",
    """select page_id, case when len(string_split(html, '<li><a href="/in"')) = 2 then '/in' end as target from pages""",
)
def next_page(t: Tables):
    return marked_pages(t).select("page_id", hx.next_page(F.col("html")).alias("target"))


@case(
    "extract_links",
    """select split_part(url, '?', 1) as page, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as target
       from pages""",
)
def extract_links(t: Tables):
    return t.pages.select(hx.without_query(F.col("url")).alias("page"), F.explode(hx.links(F.col("html"))).alias("target"))


@case(
    "default_image",
    """select user_id, coalesce(image, '/static/default.png') as image from (select c_custkey as user_id,
       case when c_custkey % 3 > 0 then 'http://example.com/' || c_custkey || '.png' end as image from customer)""",
)
def default_image(t: Tables):
    image = (
        F.when(F.col("c_custkey") % 3 == 0, F.lit("None"))
        .when(F.col("c_custkey") % 3 > 0, concat("http://example.com/", F.col("c_custkey"), ".png"))
    )
    return t.customer.select(
        F.col("c_custkey").alias("user_id"), vx.or_default(image, "/static/default.png").alias("image")
    )
