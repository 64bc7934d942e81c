"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savanto.llm import bpe, exact_dedup, imatch, line_dedup, minhash, mixing, phrases, quality, sharding, spelling, token_counts, token_files, toxicity
from savanto.llm.common import table, whole_text
from savanto.session import new_path

#: The tokeniser file of the queries.
TOKENIZER = "byte_bpe_50k.json"
#: Documents with more tokens than this are marked.
TOKEN_LIMIT = 1024


def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, from a cache that starts empty."""
    counted = token_counts.count_tokens(
        table(spark, folder, "documents"), new_path(spark, "token-cache"), public_tokenizers.path(TOKENIZER)
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: Shards of the query, and the slots of their table: a prime of more than 100 times their number.
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 2053


def sharding_query(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and shard of every document, from the shards that the documents were written to."""
    docs, files = table(spark, folder, "documents"), new_path(spark, "shards")
    sharding.write_shards(docs, "doc_id", SHARDS, SLOTS, files)
    return sharding.read_shards(spark, files, docs.schema).select("doc_id", "slot", "shard")


SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) t(i)
), p AS (
  SELECT list(CAST('0x' || substr(md5('start ' || name), 1, 8) AS BIGINT) % {SLOTS} ORDER BY i) AS starts,
         list(CAST('0x' || substr(md5('step ' || name), 1, 8) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY i) AS steps,
         list(name ORDER BY i) AS names
  FROM shards
), turns(n, owner, chosen) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT n + 1,
         list_concat(list_concat(owner[1:slot], [CAST(n % {len(SHARDS)} AS INTEGER)]), owner[slot + 2:]),
         slot
  FROM (
    SELECT n, owner, list_filter(
        list_transform(range({SLOTS}), lambda j: (starts[n % {len(SHARDS)} + 1] + j * steps[n % {len(SHARDS)} + 1]) % {SLOTS}),
        lambda q: owner[q + 1] = -1)[1] AS slot
    FROM turns, p WHERE n < {SLOTS}
  )
), filled AS (SELECT owner FROM turns WHERE n = {SLOTS}),
d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, names[owner[slot + 1] + 1] AS shard FROM d, filled, p
"""


def token_files_query(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    files = new_path(spark, "token-files")
    token_files.write_ids(table(spark, folder, "documents"), files, public_tokenizers.path(TOKENIZER))
    ids = token_files.read_ids(spark, files)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Runs of the query: two lines, or one of five words.
RUNS = line_dedup.Runs(lines=2, words=5)


def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its lines counted, those deleted, and the text that is left as a digest."""
    done = line_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"), RUNS)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), f AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), runs AS (
  SELECT doc_id, i AS first, lead(i) OVER d AS last, s || chr(10) || lead(s) OVER d AS run
  FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY k)
  UNION ALL
  SELECT doc_id, i, i, s FROM f WHERE len(string_split(s, ' ')) >= {RUNS.words}
), later AS (
  SELECT doc_id, first, last
  FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS n FROM runs WHERE run IS NOT NULL)
  WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS clean
  FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(f.i) AS n_lines, count(gone.i) AS n_removed FROM f LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def imatch_query(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return imatch.edit_test(table(spark, folder, "documents").select("doc_id", "text"))


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: The mixture of the query: weights of this entropy in nats, as many tokens as the documents have.
ENTROPY = 2.9


def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the mixture, with its pass and its place in it."""
    docs = table(spark, folder, "documents")
    total = docs.agg(F.sum(mixing.words(whole_text()))).first()[0] or 0
    mixture = mixing.Target(entropy=ENTROPY, budget=total)
    return mixing.mix(docs, mixture).select("doc_id", "source", "n_tokens", "epoch", "place")


MIXING_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n_tokens
  FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, (count(*) + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS n_blocks
  FROM d GROUP BY source
), live AS (
  SELECT source, tokens, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS p FROM s WHERE tokens > 0
), all_shares AS (SELECT list(p) AS l FROM live),
steps(n, best, other) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT n + 1, CASE WHEN good THEN middle ELSE best END, CASE WHEN good THEN other ELSE middle END
  FROM (
    SELECT n, best, other, (best + other) / 2 AS middle,
           ln(list_sum(list_transform(l, lambda x: pow(x, (best + other) / 2))))
           - (best + other) / 2 * list_sum(list_transform(l, lambda x: pow(x, (best + other) / 2) * ln(x)))
           / list_sum(list_transform(l, lambda x: pow(x, (best + other) / 2))) >= {ENTROPY} AS good
    FROM steps, all_shares WHERE n < {mixing.STEPS}
  )
), e AS (
  SELECT CASE WHEN -list_sum(list_transform(l, lambda x: x * ln(x))) >= {ENTROPY} THEN 1 ELSE best END AS e
  FROM steps, all_shares WHERE n = {mixing.STEPS}
), w AS (
  SELECT source, tokens, pow(p, e) / sum(pow(p, e)) OVER () AS w FROM live, e
), q AS (
  SELECT source, CAST(floor(w * sum(tokens) OVER () + 0.5) AS BIGINT) AS quota FROM w
), plan AS (
  SELECT s.source, s.tokens AS of_source, n_blocks, coalesce(quota, 0) AS quota,
         CASE WHEN s.tokens > 0 THEN CAST(ceil(coalesce(quota, 0) / s.tokens) AS BIGINT) ELSE 1 END AS n_epochs
  FROM s LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source
), dealt AS (
  SELECT d.*, of_source, quota, n_epochs,
         CAST('0x' || substr(md5('1:' || coalesce(doc_id, -1)), 1, 8) AS BIGINT) % n_blocks AS block
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), passes AS (
  SELECT source, block, of_source, quota, sum(n_tokens) AS tokens, count(*) AS docs, unnest(range(n_epochs)) AS epoch
  FROM dealt GROUP BY source, block, of_source, quota, n_epochs
), schedule AS (
  SELECT source, block, epoch, of_source,
         quota - epoch * of_source - coalesce(sum(tokens) OVER o, 0) AS remaining, coalesce(sum(docs) OVER o, 0) AS first
  FROM passes
  WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('1:' || epoch || ':block:' || block), block
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT doc_id, dealt.source, n_tokens, epoch, remaining, schedule.of_source,
         coalesce(sum(n_tokens) OVER o, 0) AS used, first + coalesce(count(*) OVER o, 0) AS place
  FROM dealt JOIN schedule ON dealt.source IS NOT DISTINCT FROM schedule.source AND dealt.block = schedule.block
  WINDOW o AS (PARTITION BY dealt.source, dealt.block, epoch
               ORDER BY md5('1:' || epoch || ':doc:' || coalesce(doc_id, -1)), doc_id NULLS FIRST, text NULLS FIRST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(place AS BIGINT) AS place
FROM chosen WHERE used < remaining OR of_source = 0
"""


#: Near duplicates of the query: three words, 85 in 100 shingles.
NEAR = minhash.Likeness(words=3, percent=85)


def minhash_query(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, folder, "documents"), NEAR)


MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE
           WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them, as digests."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), path, keep=["doc_id"], decoded="decoded"))


def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates: the lower half of the ids as the snapshot, the rest as the new batch."""
    docs = table(spark, folder, "documents")
    found = exact_dedup.classes(docs, exact_dedup.earlier_half(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


#: Candidates of the query, and how many of each language are returned.
COLLOCATION, COLLOCATIONS = phrases.Rule(longest=3, least=10, covered=50), 2000


def phrases_query(spark: SparkSession, folder: str) -> DataFrame:
    """The first collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"), COLLOCATIONS, COLLOCATION)


PHRASES_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS size)
), f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {COLLOCATION.least}),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size
), cut_scores AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, p.n AS l, q.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(p.n AS HUGEINT) * q.n) AS BIGINT) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = first JOIN f q ON q.lang = cuts.lang AND q.phrase = rest
), weakest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3
  ) GROUP BY lang, phrase
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM weakest LEFT JOIN covers USING (lang, phrase)
  WHERE size = 3 OR longer IS NULL OR 100 * longer < {COLLOCATION.covered} * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {COLLOCATIONS}
"""


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels").where(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


#: Words of the query; one run in 199 loses a letter.
SPELLING = spelling.Spelling(letters=6, least=5, drop=199, times=5)


def spelling_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its form and its root."""
    found = spelling.variants(table(spark, folder, "documents"), SPELLING)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts_query,
    "op2_sharding": sharding_query,
    "op3_token_files": token_files_query,
    "op4_line_dedup": line_dedup_query,
    "op5_imatch": imatch_query,
    "op6_toxicity": toxicity_query,
    "op7_mixing": mixing_query,
    "op8_minhash": minhash_query,
    "op9_bpe": bpe_query,
    "op10_exact_dedup": exact_dedup_query,
    "op11_phrases": phrases_query,
    "op12_quality": quality_query,
    "op13_spelling": spelling_query,
}

SQL: dict[str, str] = {
    "op2_sharding": SHARDING_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op7_mixing": MIXING_SQL,
    "op8_minhash": MINHASH_SQL,
    "op10_exact_dedup": EXACT_DEDUP_SQL,
    "op11_phrases": PHRASES_SQL,
}
