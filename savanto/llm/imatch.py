"""I-Match fingerprints over randomised subsets of a lexicon.

The lexicon has the terms whose document frequency lies in a band; as the frequencies of all terms add up
to the terms of all documents, it has at most (mean distinct terms of a document) / ``low`` entries, and
that bound does not grow with the corpus. A document keeps its distinct lexicon terms in sorted order and
hashes them once for each of ``SLOTS`` subsets: the first is the whole lexicon, the others keep an
eighth, a sixteenth, ... of it at random, so that some hold a few terms of any document, short or long. Likeness is the share of equal slots among those that either document
fills. A document without lexicon terms uses its own terms in place of the lexicon's, all for the first slot
and the same random subsets for the others; documents without terms (null, empty, only marks) are alike to
each other only.

All steps are built-in functions. Texts are exchanged once, to bring each document to its successor.
Equal texts have equal fingerprints. Repeated rows are documents of their own, ordered by a hash of the
text where ids are equal; null ids come last. Very long texts are used whole. Other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savanto.llm.common import whole_text
from savanto.session import written

SLOTS = 48
#: Rates of the subsets after the first: 2 to the power of -FIRST_STEP, -FIRST_STEP - 1, ... (STEPS of them), over and over.
FIRST_STEP, STEPS = 3, 8
#: Least and greatest share of documents that have a lexicon term, and the least number of them.
LOW, HIGH, LEAST = 0.001, 0.25, 2
#: Documents of an order bucket, about, and buckets at most.
BUCKET, MOST_BUCKETS = 1024, 8192


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words of letters and digits."""
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


#: An entry of a subset is one number: the slot, then the lower bits of the term's hash.
TERM_BITS = 56


def _rate(slot: int) -> int:
    """The bits of a term's hash that must be zero for a slot to keep the term."""
    return (1 << (FIRST_STEP + (slot - 1) % STEPS)) - 1 if slot else 0


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``(term, entries)``: terms of the band, each with its entry in every subset that keeps it (about two
    and a half)."""
    units = docs.select(F.explode(terms(whole_text())).alias("term"))
    counts = units.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n_docs = docs.count()
    band = counts.where((F.col("n") >= max(LEAST, low * n_docs)) & (F.col("n") <= max(LEAST, high * n_docs)))
    entry = F.col("term").bitwiseAND(F.lit((1 << TERM_BITS) - 1))
    kept = [entry]
    for slot in range(1, SLOTS):
        kept.append(F.when(F.xxhash64("term", F.lit(slot)).bitwiseAND(F.lit(_rate(slot))) == 0, entry + F.lit(slot << TERM_BITS)))
    return written(band.select("term", F.array_compact(F.array(*kept)).alias("entries")), "lexicon")


def shown(fingerprint: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a slot, blanks shown as dashes."""
    digits = F.transform(fingerprint, lambda s: F.coalesce(F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("--------")))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that one of two fingerprints fills."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y))), lambda e: e.isNotNull())
    return F.size(F.filter(equal, lambda e: e)) / F.size(equal)


def fingerprints(rows: DataFrame, lexicon_: DataFrame, keys: list[str], texts: dict[str, str], others: list[str] | None = None) -> DataFrame:
    """``keys``, ``others`` and, for each entry ``name: column`` of ``texts``, the fingerprint ``name``: the
    hash of each subset's sorted terms, null where a text has none of them.

    Where ``rows`` are partitioned by one of ``keys`` nothing is exchanged.
    """
    none = F.lit(None).cast("long")
    parts = [F.struct(F.lit(i).alias("which"), terms(F.col(c)).alias("terms")) for i, c in enumerate(texts.values())]
    held = F.struct(*[F.col(c) for c in others or []]) if others else F.struct(F.lit(0).alias("__none"))
    spread = (
        rows.withColumn("__held", held)
        .select(*keys, "__held", F.explode(F.array(*parts)).alias("p"))
        # one row without a term carries the other columns and all terms
        .select(*keys, "__held", F.col("p.which").alias("which"), F.col("p.terms").alias("all"), F.explode(F.concat(F.array(none), F.col("p.terms"))).alias("term"))
        .select(*keys, "which", "term", F.when(F.col("term").isNull(), F.struct("__held", "all")).alias("row"))
    )
    # at most (mean terms of a document) / LOW rows
    matched = spread.join(F.broadcast(lexicon_), "term", "left").where("term is null or entries is not null")
    found = lambda i: F.flatten(F.collect_list(F.when(F.col("which") == i, F.col("entries"))))
    alone = lambda i: F.max(F.when(F.col("which") == i, F.col("row.all")))
    gathered = matched.groupBy(*keys).agg(
        F.max("row.__held").alias("__held"), *[found(i).alias(f"__found{i}") for i in range(len(parts))], *[alone(i).alias(f"__all{i}") for i in range(len(parts))]
    )
    for i in range(len(parts)):
        # in order of slots, and of terms in each; then one line of text for each slot
        gathered = gathered.withColumn(f"__sorted{i}", F.sort_array(f"__found{i}"))
        gathered = gathered.withColumn(f"__slots{i}", _terms_of_slots(f"__sorted{i}"))
    numbers = F.sequence(F.lit(0), F.lit(SLOTS - 1))

    def fingerprint(i: int) -> Column:
        line = lambda slot: F.try_element_at(F.col(f"__slots{i}"), slot.cast("string"))
        empty = F.transform(numbers, lambda slot: F.hash(F.hash(F.col(f"__all{i}")), slot))
        # sorted only here: few documents have no lexicon terms
        own = F.transform(F.array(F.sort_array(f"__all{i}")), lambda a: F.transform(numbers, lambda slot: _own(a, slot)))[0]
        alone = F.when(F.size(f"__all{i}") == 0, empty).otherwise(own)
        return F.when(F.size(f"__found{i}") == 0, alone).otherwise(F.transform(numbers, lambda slot: F.when(line(slot).isNotNull(), F.hash(line(slot)))))

    carried = [F.col(f"__held.{c}").alias(c) for c in others or []]
    return gathered.select(*keys, *carried, *[fingerprint(i).alias(name) for i, name in enumerate(texts)])


def _own(all_terms: Column, slot: Column) -> Column:
    """Hash of the terms that a slot's subset keeps, null where it keeps none."""
    rate = F.get(F.array(*[F.lit(_rate(s)) for s in range(SLOTS)]), slot)
    kept = F.filter(all_terms, lambda t: F.xxhash64(t, slot).bitwiseAND(rate) == 0)
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.hash(k)))[0]


def _terms_of_slots(entries: str) -> Column:
    """A map from each slot to its terms, joined in order, from sorted entries."""

    def piece(entry: Column, k: Column) -> Column:
        slot = F.shiftright(entry, TERM_BITS)
        first = (k == 0) | (F.shiftright(F.get(F.col(entries), k - 1), TERM_BITS) != slot)
        term = entry.bitwiseAND(F.lit((1 << TERM_BITS) - 1)).cast("string")
        return F.concat(F.when(first, F.concat(F.lit(";"), slot.cast("string"), F.lit(":"))).otherwise(F.lit(",")), term)

    text = F.array_join(F.transform(F.col(entries), piece), "")
    return F.str_to_map(F.substr(text, F.lit(2)), F.lit(";"), F.lit(":"))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie below an id, by halving; null ids count as lowest."""
    if not bounds:
        return F.lit(0)
    stored = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    onward = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(stored, at + step - 1) < doc_id), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), onward)


def with_next(docs: DataFrame) -> DataFrame:
    """``(bucket, place, doc_id, text, next_text, next_bucket, next_place)``: every document with the next
    one in descending order of ids, the last with the first. ``(bucket, place)`` is a document's key."""
    n = docs.count()
    n_buckets = min(MOST_BUCKETS, -(-n // BUCKET))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * n_buckets))).first()[0] if shares else None
    bounds = sorted(set(found or []))
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("bucket", len(bounds) - _bucket(F.col("doc_id"), bounds))
    tie = F.xxhash64("text")
    # the first document of each bucket: no more rows than buckets
    heads = rows.groupBy("bucket").agg(F.max_by("text", F.struct(F.col("doc_id"), F.bitwise_not(tie).alias("tie"))).alias("head"))
    heads = written(heads, "heads")
    ring = Window.orderBy("bucket")
    onward = F.lead("bucket").over(ring)
    first = F.first("bucket").over(ring)
    after = heads.select("bucket", F.coalesce(onward, first).alias("next_bucket"))
    after = after.join(heads.select(F.col("bucket").alias("next_bucket"), F.col("head").alias("next_head")), "next_bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), tie)
    placed = rows.select(
        "*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("follower"), F.lead(F.lit(1)).over(order).isNull().alias("last")
    )
    ends = after.withColumnRenamed("bucket", "of")
    joined = placed.join(ends, (placed["bucket"] == ends["of"]) & placed["last"], "left")
    return joined.select(
        "bucket", "place", "doc_id", "text",
        F.when(F.col("last"), F.col("next_head")).otherwise(F.col("follower")).alias("next_text"),
        F.when(F.col("last"), F.col("next_bucket")).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(F.col("last"), F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def edited(text: Column, following: Column) -> Column:
    """A text whose last half of code points is replaced by as many (or all) first ones of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def edit_test(docs: DataFrame, lexicon_: DataFrame | None = None) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are to the document's
    own and to that of the next document."""
    words = lexicon(docs) if lexicon_ is None else lexicon_
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    others = ["doc_id", "n_chars", "edited_sha256", "next_bucket", "next_place"]
    stored = written(fingerprints(rows, words, ["bucket", "place"], {"own": "text", "changed": "edited"}, others), "fingerprints")
    following = stored.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("own").alias("next_own"))
    return stored.join(following, ["next_bucket", "next_place"]).select(
        "doc_id", "n_chars", "edited_sha256",
        shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
