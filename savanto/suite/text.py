"""Cover density, tokens, topic vectors and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.operators import cover, positional, topics
from savanto.session import new_path, written
from savanto.suite.registry import Tables, case, with_views

QUERY = "the and of"


def cover_sql(docs: str, terms: str, p: str = "") -> list[tuple[str, str]]:
    """Views for ``docs(doc_id, text)`` and ``terms(query_id, slot, term)`` with up to three slots.

    ``p`` prefixes the view names.
    """
    nxt = ", ".join(
        f"""min(case when slot = {s} then pos end) over (partition by query_id, doc_id order by pos
            rows between current row and unbounded following) as n{s}"""
        for s in range(3)
    )
    return [
        (f"{p}docs", docs),
        (f"{p}terms", terms),
        (
            f"{p}tokens",
            f"""select doc_id, unnest(string_split(text, ' ')) as token,
               generate_subscripts(string_split(text, ' '), 1) - 1 as pos from {p}docs""",
        ),
        (
            f"{p}hits",
            f"""select query_id, doc_id, pos, slot from {p}tokens
               join {p}terms on lower(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = term""",
        ),
        (f"{p}nexts", f"select query_id, doc_id, pos, {nxt} from {p}hits"),
        (
            f"{p}ends",
            f"""select query_id, doc_id, pos,
               list_sort(list_filter([n0, n1, n2], lambda x: x is not null)) as e from {p}nexts""",
        ),
        (
            f"{p}covers",
            f"""select query_id, doc_id, level, e[level] as q, max(pos) as p
               from {p}ends, (values (1), (2), (3)) v(level) where e[level] is not null
               group by query_id, doc_id, level, e[level]""",
        ),
        (
            f"{p}levels",
            f"""select query_id, doc_id, level, count(*) as covers,
               sum(least(1.0::double, 3.0::double / (q - p + 1))) as score
               from {p}covers group by query_id, doc_id, level""",
        ),
        (
            f"{p}tops",
            f"""select * exclude (rn) from (select *, row_number() over (partition by query_id, doc_id
               order by level desc) as rn from {p}levels) where rn = 1""",
        ),
    ]


DOC_TERMS = "select 0 as query_id, * from (values (0, 'the'), (1, 'and'), (2, 'of')) v(slot, term)"
DOCS = "select doc_id, text from documents"


@case(
    "cover_density",
    with_views(
        """select query_id, doc_id, level, round(score, 6) as score, rnk as rank from (
           select *, row_number() over (partition by query_id order by level desc, round(score, 9) desc, doc_id) as rnk
           from tops) where rnk <= 20""",
        *cover_sql(DOCS, DOC_TERMS),
    ),
)
def cover_density(t: Tables):
    ranked = cover.cover_density(t.documents, cover.make_queries(t.spark, [QUERY]))
    return ranked.withColumn("score", F.round("score", 6))


SEARCHES = ["the and of", "de la", "und", "licensed under", "this nosuchword"]
SEARCH_TERMS = "select * from (values " + ", ".join(
    f"({i}, {k}, '{word}')" for i, query in enumerate(SEARCHES) for k, word in enumerate(query.split())
) + ") v(query_id, slot, term)"


@case(
    "positional_search",
    with_views(
        """select query_id, doc_id, level, round(score, 6) as score, rnk as rank from (
           select *, row_number() over (partition by query_id order by level desc, round(score, 9) desc, doc_id) as rnk
           from tops) where rnk <= 20""",
        *cover_sql(DOCS, SEARCH_TERMS),
    ),
)
def positional_search(t: Tables):
    """The first documents of several searches, from postings stored before."""
    index = positional.build(t.documents, new_path(t.spark, "positional"))
    found = positional.search(index, cover.make_queries(t.spark, SEARCHES))
    return found.withColumn("score", F.round("score", 6))


@case(
    "cover_density_levels",
    with_views(
        "select query_id, doc_id, level, covers, round(score, 6) as score from levels",
        *cover_sql(DOCS, DOC_TERMS),
    ),
)
def cover_density_levels(t: Tables):
    levels = cover.cover_levels(t.documents, cover.make_queries(t.spark, [QUERY]))
    return levels.withColumn("score", F.round("score", 6))


# ---- list texts, tokens and topic vectors ----


def stem_sql(x: str) -> str:
    return (
        f"case when length({x}) <= 3 then {x}"
        f" when regexp_matches({x}, '[^ae]ies$') then {x}[:length({x}) - 3] || 'y'"
        f" when regexp_matches({x}, '[^aeo]es$') then {x}[:length({x}) - 1]"
        f" when regexp_matches({x}, '[^us]s$') then {x}[:length({x}) - 1] else {x} end"
    )


STOPS = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


def raw_tokens_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(^|[^A-Za-z0-9_])@\\w+', '\\1 ', 'g')"
    x = f"regexp_replace({x}, '&(amp|lt|gt|quot|apos|nbsp|#39);', ' ', 'g')"
    x = f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '\\W+|_'), lambda x: x <> '')"


def topic_tokens_sql(x: str) -> str:
    kept = (
        f"list_filter({raw_tokens_sql(x)}, lambda y: not (lower(y) in {STOPS}"
        f" or ({stem_sql('lower(y)')}) in {STOPS}))"
    )
    return f"list_transform({kept}, lambda z: {stem_sql('lower(z)')})"


VECTOR_VIEWS = [
    ("list_toks", f"select list_id, {topic_tokens_sql("name || ' ' || description")} as toks from lists"),
    (
        "user_toks",
        """select user_id, list_id, unnest(toks) as token, generate_subscripts(toks, 1) as i
           from member_of join list_toks using (list_id)""",
    ),
    (
        "stream",
        "select user_id, token, lead(token) over (partition by user_id order by list_id, i) as nxt from user_toks",
    ),
    (
        "vectors",
        """select user_id, token as topic, count(*) + 1 as freq from stream group by 1, 2
           union all select distinct user_id, token || ' ' || nxt, 1 from stream where nxt is not null""",
    ),
]


def vectors(t: Tables):
    return topics.topic_vectors(t.member_of(), t.lists())


@case("topic_vector", with_views("select user_id, topic, freq from vectors", *VECTOR_VIEWS))
def topic_vector(t: Tables):
    return vectors(t)


@case(
    "inverted_index",
    with_views(
        """select word, user_id >> 16 as block, count(*) as users,
           '[' || string_agg(user_id::varchar, ',' order by user_id) || ']' as doc_index
           from (select distinct unnest(string_split(topic, ' ')) as word, user_id from vectors)
           group by 1, 2""",
        *VECTOR_VIEWS,
    ),
)
def inverted_index(t: Tables):
    return topics.index_blocks(vectors(t))


@case(
    "candidates",
    with_views(
        """select distinct p_name as query_id, user_id
           from (select distinct p_name, unnest(string_split(p_name, ' ')) as word from part) q
           join (select distinct unnest(string_split(topic, ' ')) as word, user_id from vectors) w using (word)""",
        *VECTOR_VIEWS,
    ),
)
def candidates(t: Tables):
    queries = t.part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    stored = written(vectors(t), "vectors")
    return topics.candidates(queries, topics.index_rows(stored), stored)


@case(
    "tokenize",
    with_views(
        f"""select token, count(*) as n from (select unnest({raw_tokens_sql("text")}) as token from documents)
            group by 1"""
    ),
)
def tokenize(t: Tables):
    words = t.documents.select(F.explode(tx.raw_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@case(
    "camel_split",
    f"""select p_partkey, array_to_string({raw_tokens_sql("replace(upper(p_name[1]) || p_name[2:], ' ', '') || p_type")
        }, '|') as pieces from part""",
)
def camel_split(t: Tables):
    first_up = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)))
    joined = F.concat(F.replace(first_up, F.lit(" "), F.lit("")), F.col("p_type"))
    return t.part.select("p_partkey", F.array_join(tx.camel_split(joined), "|").alias("pieces"))


@case(
    "stem_tokens",
    f"""select stem, count(*) as n from (select {stem_sql("lower(token)")} as stem
        from (select unnest({raw_tokens_sql("text")}) as token from documents)) group by 1""",
)
def stem_tokens(t: Tables):
    words = t.documents.select(F.explode(tx.raw_tokens(F.col("text"))).alias("token"))
    return words.groupBy(tx.stem(F.lower("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@case(
    "remove_stopwords",
    f"""select doc_id, len({raw_tokens_sql("text")}) as before, len({topic_tokens_sql("text")}) as after,
        array_to_string({topic_tokens_sql("text")}, ' ') as kept from documents""",
)
def remove_stopwords(t: Tables):
    # generated rather than projected, so that the tokens of a text are built once
    raw = t.documents.select("doc_id", F.explode(F.array(tx.raw_tokens(F.col("text")))).alias("raw"))
    kept = raw.select("doc_id", F.size("raw").alias("before"), F.explode(F.array(tx.drop_stop_words(F.col("raw")))).alias("kept"))
    return kept.select("doc_id", "before", F.size("kept").alias("after"), F.array_join("kept", " ").alias("kept"))


@case(
    "pos_filter",
    with_views(
        f"""select list_id, string_agg(token, ' ' order by i) as kept from (
            select list_id, unnest(toks) as token, generate_subscripts(toks, 1) as i from list_toks)
            where token in (select {stem_sql("lower(split_part(p_name, ' ', 1))")} from part union
            select {stem_sql("lower(p_type)")} from part) group by 1""",
        *VECTOR_VIEWS[:1],
    ),
)
def pos_filter(t: Tables):
    """First words of part names play adjectives, types nouns, second words verbs."""
    words = F.split("p_name", " ")
    tagged = F.array(
        F.struct(words[0].alias("token"), F.lit("JJ").alias("tag")),
        F.struct(words[1].alias("token"), F.lit("VB").alias("tag")),
        F.struct(F.col("p_type").alias("token"), F.lit("NN").alias("tag")),
    )
    lexicon = t.part.select(F.inline(tagged)).select(tx.stem(F.lower("token")).alias("token"), "tag").distinct()
    kept = topics.list_tokens(t.lists(), lexicon=lexicon)
    return kept.select("list_id", F.array_join("tokens", " ").alias("kept"))


@case(
    "ngrams",
    f"""select lang, sum(n) as bigrams, count(*) as distinct_bigrams from (
        select lang, b, count(*) as n from (
          select lang, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) as b
          from (select lang, {topic_tokens_sql("text")} as t from documents)) group by 1, 2) group by 1""",
)
def ngrams(t: Tables):
    pairs = t.documents.select("lang", F.explode(tx.bigrams(tx.topic_tokens(F.col("text")))).alias("b"))
    counted = pairs.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("lang").agg(F.sum("n").alias("bigrams"), F.count(F.lit(1)).alias("distinct_bigrams"))


@case(
    "query_vector",
    f"""select item_id, array_to_string(list_transform({raw_tokens_sql("trim(text)")},
        lambda z: {stem_sql("lower(z)")}), ' ') as vector from benchmark""",
)
def query_vector(t: Tables):
    return t.benchmark.select("item_id", tx.query_vector(F.col("text")).alias("vector"))


@case(
    "vector_storage",
    with_views("select user_id, topic, freq from vectors", *VECTOR_VIEWS),
)
def vector_storage(t: Tables):
    """Vectors written as JSON maps and read back."""
    return topics.decode_vectors(topics.encode_vectors(written(vectors(t), "vectors")))


@case(
    "vector_total",
    with_views(
        """select user_id, coalesce(total, 0) as total, round(case when coalesce(total, 0) = 0 then 0
             else best / total end, 6) as score
           from profiles left join (select user_id, sum(freq) as total, max(freq) as best from vectors group by 1) using (user_id)""",
        *VECTOR_VIEWS,
    ),
)
def vector_total(t: Tables):
    """The total of every user's vector, and the share of its largest entry; no topics, no score."""
    stored = written(vectors(t), "vectors")
    totals = topics.vector_totals(stored, t.profiles())
    best = stored.groupBy("user_id").agg(F.max("freq").alias("best"))
    share = F.coalesce(F.try_divide(F.col("best"), F.col("total")), F.lit(0.0))
    return totals.join(best, "user_id", "left").select("user_id", "total", F.round(share, 6).alias("score"))
