"""Scalar expressions, projections, upserts and question-and-answer corner cases."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from savanto.functions import html as hx
from savanto.functions import text as tx
from savanto.functions import values as vx
from savanto.operators import paging, projections, qa, upsert
from savanto.sources import stored


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [("544", 544), ("1.2k", 1200), ("5m", 5000000), ("54.4", 5440), ("567K", None), ("abc", None), (None, None)],
)
def test_abbreviated_count(spark, text, want):
    assert one(spark, text, "string", vx.abbreviated_count) == want


def test_grouped_int(spark):
    assert one(spark, "1,234", "string", vx.grouped_int) == 1234
    assert one(spark, "x 1,234 y", "string", vx.second_word_int) == 1234
    assert one(spark, "x", "string", vx.second_word_int) is None


@pytest.mark.parametrize(
    "rep", [0, 999, 1000, 1234, 9999, 10000, 12000, 12345, 10250, 10750, 12350, 99950, 883882, 1234550, 16777250, 99999950]
)
def test_reputation_text(spark, rep):
    if rep < 1000:
        want = str(rep)
    elif rep < 10000:
        want = f"{str(rep)[0]},{str(rep)[1:]}"
    else:
        want = f"{rep // 1000}k" if rep % 1000 == 0 else "%.1fk" % (rep / 1000.0)
    assert one(spark, rep, "bigint", vx.reputation_text) == want


@pytest.mark.parametrize("listed, want", [(10, 2.302585), (None, 2.302585), (0, 2.302585), (-1, 2.302585), (1, 0.0)])
def test_log_weight(spark, listed, want):
    assert one(spark, listed, "bigint", vx.log_weight) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "ago, want",
    [
        (1, "1 second ago"), (0, "0 seconds ago"), (60, "1 minute ago"), (90, "1 minutes ago"), (7200, "2 hours ago"),
        (90000, "yesterday"), (86400 * 30, "Jan 1 / 24 - 00:00"),
    ],
)
def test_relative_age(spark, ago, want):
    now = dt.datetime(2024, 1, 31)
    got = one(spark, now - dt.timedelta(seconds=ago), "timestamp_ntz", lambda c: vx.relative_age(c, F.lit(now).cast("timestamp_ntz")))
    assert got == want


def test_labels_and_slugs(spark):
    assert one(spark, "gis.stackexchange.com", "string", lambda c: tx.topic_label(c, F.lit("qgis"))) == "gis qgis"
    assert one(spark, "Computer Programming", "string", tx.topic_slug) == "Computer-Programming"
    assert one(spark, "A.B, C/D", "string", tx.topic_slug) == "A-B-C-D"


def test_enum_default_image_and_routes(spark):
    assert one(spark, "vote_based", "string", lambda c: vx.enum_name(c, ["VoteBased"])) == "VoteBased"
    assert one(spark, "other_kind", "string", lambda c: vx.enum_name(c, ["VoteBased"])) == "other_kind"
    assert one(spark, "None", "string", lambda c: vx.or_default(c, "d.png")) == "d.png"
    assert [one(spark, s, "int", vx.fetch_route) for s in (200, 301, 404, 403, 429)] == [
        "parse", "blacklist", "blacklist", "stop", "stop",
    ]


PAGE = """<html><body><div class="box LeaderboardListItem"><div><a class="user" href="/profile/Ann">Ann <b>Lee</b></a>
<img class="profile_photo_img" data-src="a.png"><div class="view_count"><div class="num">1,234</div></div></div></div>
<p>between</p><div class="LeaderboardListItem"><a class="user" href="/profile/Bo">Bo</a></div>
<a rel="next" href="/p2">more</a><a class="RelatedTopicsListItem x" href="/topic/Cats">Cats</a></body></html>"""


def test_nested_page_items_and_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>nothing")], "page_id bigint, html string")
    fields = {
        "name": ("a", "user", "text"), "url": ("a", "user", "href"),
        "image": ("img", "profile_photo_img", "data-src"), "views": ("div", "num", "text"),
    }
    items = hx.page_items(pages, "page_id", "html", ("div", "LeaderboardListItem"), fields).orderBy("position")
    assert [tuple(r) for r in items.collect()] == [
        (1, 0, "Ann Lee", "/profile/Ann", "a.png", "1,234"),
        (1, 1, "Bo", "/profile/Bo", None, None),
    ]
    row = pages.where("page_id = 1").select(
        hx.next_page(F.col("html")).alias("next"), hx.links_with_class(F.col("html"), "RelatedTopicsListItem").alias("rel")
    )
    assert tuple(row.first()) == ("/p2", ["/topic/Cats"])


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, ts int")
    once = upsert.upsert_latest(old, new, ["k"], "ts")
    twice = upsert.upsert_latest(once, new, ["k"], "ts")
    want = {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    assert {tuple(r) for r in upsert.insert_ignore(old, new.unionByName(new), ["k"], "v").collect()} == {
        (1, "a", 1), (2, "b", 1), (3, "d", 2),
    }
    assert upsert.new_row_count(old, new, ["k"]).first().added == 1
    assert upsert.set_add(old, old).count() == 2


def test_partial_upsert_keeps_other_fields(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    new = spark.createDataFrame([(1, 9), (2, None), (3, 1)], "k int, n int")
    assert {tuple(r) for r in upsert.upsert_partial(old, new, "k", ["n"]).collect()} == {
        (1, "a", 9), (2, "b", 6), (3, None, 1),
    }


def test_point_lookup_of_a_missing_key_raises(spark):
    df = spark.createDataFrame([(1, "a")], "k bigint, v string")
    assert projections.point_lookup(df, "k", 1).first().v == "a"
    with pytest.raises(PySparkException):
        projections.point_lookup(df, "k", 2).collect()


def test_page_size_does_not_change_the_total(spark):
    df = spark.range(101)
    for size in (1, 10, 1000):
        pages = paging.paginate(df, [F.col("id")], size)
        totals = paging.page_totals(pages).collect()
        assert sum(r.rows for r in totals) == 101 and max(r.rows for r in totals) <= size


def test_edges_skip_bad_lines(spark, tmp_path):
    (tmp_path / "e1.txt").write_text("1 2\n3000000000 4\nx 5\n\n")
    (tmp_path / "e2.txt").write_text("6 7\n")
    got = {tuple(r) for r in stored.read_edges(spark, str(tmp_path / "e*.txt")).collect()}
    assert got == {(1, 2), (3000000000, 4), (6, 7)}


def test_privileges(spark):
    users = spark.createDataFrame([(1, 0), (2, 15), (3, 100000), (4, -5)], "user_id bigint, reputation bigint")
    steps = spark.createDataFrame([(f"p{r}", r) for r in (0, 1, 15, 16, 500)], "short_description string, reputation bigint")
    want = {(1, "p0"), (2, "p0"), (2, "p1"), (2, "p15")} | {(3, f"p{r}") for r in (0, 1, 15, 16, 500)}
    assert {(r.user_id, r.privilege) for r in qa.privileges_of(users, steps).collect()} == want


def test_site_stats_of_an_empty_site(spark):
    q = spark.createDataFrame([], "question_id bigint, owner bigint")
    a = spark.createDataFrame([], "question_id bigint, is_accepted boolean, score bigint")
    row = qa.site_stats(q, a).first()
    assert row.total_questions == 0 and row.percent_unanswered is None


def test_versus_counts_each_site_once(spark):
    reps = spark.createDataFrame([(1, "x", 5), (1, "y", 1), (2, "y", 9), (2, "z", 2)], "user_id bigint, site string, reputation bigint")
    pairs = spark.createDataFrame([(1, 2)], "user_1 bigint, user_2 bigint")
    got = {r.site: (r.winner, r.margin) for r in qa.versus(reps, pairs).collect()}
    assert got == {"x": (1, 5), "y": (2, 8), "z": (2, 2), None: (2, 5)}


def test_text_of_nested_and_decoded_markup(spark):
    pages = [
        ('<div class="shadow">no</div><div class="ad">a <b>x</b> &amp; y</div>', "a x & y"),
        ('<div id="1" class="big ad">&lt;p&gt; &#233;&#0039; <!-- c --><script>1</script>z</div><div class="ad">late</div>', "<p> é' z"),
        ('<div class="ad">&amp;lt; $1 \\</div>', "&lt; $1 \\"),
        ('<div class="ad"></div>', ""),
        ('<div class="ad">a <div>b</div> c</div><div class="ad">d</div>', "a b c"),
        ("<DIV><div class='x ad'>1<div><div class=\"ad\">2</div></div>3</div>4</DIV>", "123"),
        ('<div class="ad">&#x41;&#X1f600;&#128512;&eacute;&euro;&nosuch;&#0;&#xD800;&AMP & x</div>', "A\U0001f600\U0001f600é€&nosuch;&#0;&#xD800;&AMP & x"),
        ('<div class="ad">open <div>never closed</div>', None),
        ('<!-- <div class="ad">no</div> --><divider class="ad">no</divider><div class="ad"><!-- </div> -->a<script>"</div>"</script>b</div>', "ab"),
        ("<p>none</p>", None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, html string")
    got = df.select("i", hx.first_text(F.col("html"), "div", "ad").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in pages]


def test_items_within_items_and_attributes(spark):
    page = (
        "<ul><li class='row'><a href='/a?x=1&amp;y=2' >one <ul><li class='row'>inner</li></ul></a></li>"
        "<li>not a row</li><LI class=\"big row\"><a>no target</a><a href=/b>two</a></LI></ul><li class=row><img alt=''>"
    )
    df = spark.createDataFrame([(7, page), (8, "")], "page_id bigint, html string")
    fields = {"target": ("a", "", "href"), "label": ("a", "", "text"), "alt": ("img", "", "alt")}
    rows = hx.page_items(df, "page_id", "html", ("li", "row"), fields).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "/a?x=1&y=2", "one inner", None), (7, 1, "/b", "no target", None)]


def test_declared_fields(spark):
    rows = spark.createDataFrame([(1, [("a", 2)]), (2, [])], "pk int, items array<struct<n:string,k:int>>")
    fields = [projections.Field("id", "pk"), projections.Field("things", "items", many=(projections.Field("name", "n", F.upper),))]
    got = projections.declared(rows, fields).orderBy("id").collect()
    assert [(r.id, [x.name for x in r.things]) for r in got] == [(1, ["A"]), (2, [])]


def test_stored_tables_can_be_discarded(spark):
    from savanto import session

    first = session.written(spark.range(3).toDF("i"), "t")
    table = session.bucketed(spark.range(30).toDF("i"), ["i"], "b", 30)
    assert (first.count(), table.count()) == (3, 30)
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("savanto_")}
    assert before and session.discard(spark) >= 2 and session.discard(spark) == 0
    assert not {t.name for t in spark.catalog.listTables() if t.name.startswith("savanto_")}
