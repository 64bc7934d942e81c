"""Topic vectors from list texts, and the inverted index over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.session import written
from savanto.skew import adjacent_pairs, broadcast_if_small

BLOCK_BITS = 16  # ids per posting block
LIST_BITS = 21  # list ids per window block
MEMBERSHIPS = 1 << 17  # memberships whose words one task counts, about


def list_texts(lists: DataFrame) -> DataFrame:
    """``(list_id, text)``: name and description, a missing part read as empty."""
    return lists.select(
        "list_id", F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))).alias("text")
    )


def lookup_stems(tokens: DataFrame, stems: DataFrame, token: str = "token") -> DataFrame:
    """Replace tokens by a supplied ``(token, stem)`` table; tokens it lacks stay."""
    table = broadcast_if_small(stems.select(F.col("token").alias("__t"), F.col("stem").alias("__s")))
    joined = tokens.join(table, F.col(token) == F.col("__t"), "left")
    return joined.withColumn(token, F.coalesce("__s", token)).drop("__t", "__s")


def keep_tagged(tokens: DataFrame, lexicon: DataFrame, tags=("NN", "JJ"), token: str = "token") -> DataFrame:
    """Keep tokens that a supplied ``(token, tag)`` lexicon knows as nouns or adjectives."""
    wanted = lexicon.where(F.col("tag").isin(*tags)).select(F.col("token").alias(token)).distinct()
    return tokens.join(broadcast_if_small(wanted), token, "left_semi")


def list_tokens(lists: DataFrame, stems: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``(list_id, tokens)``. Without lookup tables this stays inside the row."""
    texts = list_texts(lists)
    rows = texts.select("list_id", tx.topic_tokens(F.col("text")).alias("tokens"))
    if stems is None and lexicon is None:
        return rows
    rows = rows.select("list_id", F.posexplode("tokens").alias("pos", "token"))
    if stems is not None:
        rows = lookup_stems(rows, stems)
    if lexicon is not None:
        rows = keep_tagged(rows, lexicon)
    # a group is the words of one list text, so its size is that of one input row
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return rows.groupBy("list_id").agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))


def topic_vectors(
    member_of: DataFrame,
    lists: DataFrame,
    stems: DataFrame | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``(user_id, topic, freq)`` for all users at once.

    A user's lists, by id, form one token stream. A word counts 1 + its occurrences, a pair of
    neighbouring words 1, also where one list ends and the next begins. The stream is ordered in
    windows of bounded size, however many lists a user is on.

    The words and pairs of a list are made once, not for each of its members, and are counted where the window
    has put a user's block; counts are exchanged again only if the list ids span several blocks. Lists are exchanged
    as texts and their words made where they meet the members; they are never broadcast, as Spark takes an array
    for one element and a stored table for as large as its file.
    """
    # generated rather than filtered, so that the tokens are built once
    used = F.filter(F.array("tokens"), lambda t: F.size(t) > 0)
    tokens = list_tokens(lists.repartition("list_id"), stems, lexicon).select("list_id", F.explode(used).alias("tokens"))
    words = F.transform("tokens", lambda t: F.struct(t.alias("topic"), F.lit(1).alias("n")))
    pairs = F.transform(tx.bigrams(F.col("tokens")), lambda t: F.struct(t.alias("topic"), F.lit(0).alias("n")))
    texts = tokens.select(
        "list_id", F.get("tokens", F.lit(0)).alias("first"), F.element_at("tokens", -1).alias("last"), F.concat(words, pairs).alias("topics")
    )
    block = F.shiftright("list_id", LIST_BITS)
    # one exchange: a user's lists in blocks of ids, so that no window exceeds 2**LIST_BITS rows
    memberships = written(member_of.select("user_id", "list_id"), "memberships")
    parts = max(lists.sparkSession.sparkContext.defaultParallelism, -(-memberships.count() // MEMBERSHIPS))
    placed = memberships.join(texts.hint("merge"), "list_id").withColumn("block", block).repartition(parts, "user_id", "block")
    in_block = Window.partitionBy("user_id", "block").orderBy("list_id")
    stream = placed.withColumn("next_first", F.lead("first").over(in_block))
    between = F.when(F.col("next_first").isNotNull(), F.array(F.struct(F.concat_ws(" ", "last", "next_first").alias("topic"), F.lit(0).alias("n"))))
    found = stream.select("user_id", "block", F.inline(F.concat("topics", F.coalesce(between, F.array()))))
    total = found.groupBy("user_id", "block", "topic").agg(F.sum("n").alias("n"))
    low, high = lists.agg(F.min(block), F.max(block)).first()
    if low != high:
        # between blocks only their first and last words matter
        ends = placed.groupBy("user_id", "block").agg(F.min_by("first", "list_id").alias("first"), F.max_by("last", "list_id").alias("last"))
        across = adjacent_pairs(ends, "user_id", "block", "first", "last", LIST_BITS, 63 - LIST_BITS).select(
            "user_id", F.concat_ws(" ", "last", "next_first").alias("topic"), F.lit(0).cast("bigint").alias("n")
        )
        total = total.drop("block").unionByName(across).groupBy("user_id", "topic").agg(F.sum("n").alias("n"))
    return total.select("user_id", "topic", (F.col("n") + 1).cast("bigint").alias("freq"))


def index_rows(vectors: DataFrame) -> DataFrame:
    """``(word, user_id)``: the inverted index, one row per posting."""
    return vectors.select(F.explode(F.split("topic", " ")).alias("word"), "user_id").distinct()


def index_blocks(vectors: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(word, block, users, doc_index)``: postings as JSON arrays of sorted ids.

    A posting list is cut by id range, so one array never holds more than ``2**bits`` ids
    however common the word is.
    """
    rows = index_rows(vectors).withColumn("block", F.shiftright("user_id", bits))
    return rows.groupBy("word", "block").agg(
        F.count(F.lit(1)).alias("users"), F.to_json(F.array_sort(F.collect_list("user_id"))).alias("doc_index")
    )


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Back from JSON blocks to ``(word, user_id)`` rows."""
    return blocks.select("word", F.explode(F.from_json("doc_index", "array<bigint>")).alias("user_id"))


def encode_vectors(vectors: DataFrame, entries: int = 1000) -> DataFrame:
    """``(user_id, shard, topics)`` with topics a JSON map of about ``entries`` topics.

    Ordinary vectors fit one shard; a larger one is spread over as many as its size asks for.
    """
    sizes = vectors.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(entries)).alias("shards"))
    sharded = vectors.join(sizes, "user_id").withColumn(
        "shard", F.pmod(F.xxhash64("topic"), F.col("shards")).cast("int")
    )
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "freq"))))
    return sharded.groupBy("user_id", "shard").agg(F.to_json(pairs).alias("topics"))


def decode_vectors(encoded: DataFrame) -> DataFrame:
    """``(user_id, topic, freq)`` from JSON maps."""
    parsed = F.from_json("topics", "map<string,bigint>")
    return encoded.select("user_id", F.explode(parsed).alias("topic", "freq"))


def postings(vectors: DataFrame) -> DataFrame:
    """``(word, topic, user_id, freq)``: the index with what ranking needs, once per word of a topic."""
    words = F.array_distinct(F.split("topic", " "))
    return vectors.select(F.explode(words).alias("word"), "topic", "user_id", "freq")


def candidates(queries: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, user_id)``: users whose vector holds a word of the (stemmed) query."""
    words = F.array_distinct(F.filter(F.split(tx.query_vector(F.col("query")), " "), lambda w: w != ""))
    terms = queries.select("query_id", F.explode(words).alias("word"))
    found = index.join(broadcast_if_small(terms), "word").select("query_id", "user_id").distinct()
    # never broadcast: of the file of stored vectors the ids are next to nothing, in memory they are not
    return found.join(vectors.select("user_id").distinct().hint("merge"), "user_id", "left_semi").select("query_id", "user_id")


def vector_totals(vectors: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, total)``: the sum of each user's vector, 0 for users without topics."""
    totals = vectors.groupBy("user_id").agg(F.sum("freq").alias("total"))
    return users.select("user_id").join(totals, "user_id", "left").select("user_id", F.coalesce("total", F.lit(0)).alias("total"))
