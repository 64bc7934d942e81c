"""Collocations: phrases that occur more often than their parts let expect, from FM-indexes of shards.

Each task cuts its documents into shards of one language and stores a bidirectional index over word ids for
each (:mod:`savanto.llm.word_index`). Interval extension lists all phrases of a shard with their occurrences.
Most phrases are rare, so shards first exchange 48 bits of a hash and an occurrence count up to the least one
that counts, packed by hash range; a range's task sums them and tells each shard which of its phrases may be
frequent. Only those are sent as text and summed again, so counts are exact and a clash of hashes costs a
row, never a result. No task holds more than a shard or a hash range.

Only A-Z are lower-cased. ``.,;:!?`` and line ends part pieces, blanks and tabs part words. Null and empty
texts have no words; a missing language is ``und``; repeated rows count as often as they stand there. Long
texts are indexed whole: a piece is never cut, and a text may be spread over shards. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savanto.llm.common import give_back, whole_text
from savanto.llm.word_index import WordIndex
from savanto.session import written

#: Bytes of a hash that are exchanged.
KEY_BYTES = 6

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

PARTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
INDEX = "shard bigint, lang string, n_words bigint, n_phrases bigint, words binary, forward binary, reverse binary"


@dataclass(frozen=True)
class Rule:
    """Candidates: 2 to ``longest`` words with ``least`` occurrences; those go that lie within a longer one
    with ``covered`` percent of their occurrences."""

    longest: int = 3
    least: int = 10
    covered: int = 50


@dataclass(frozen=True)
class Sizes:
    """Bytes of text of a shard, about; phrases of a hash range; bits of a hash that count."""

    shard: int = 6 << 20
    range: int = 1 << 19
    bits: int = 8 * KEY_BYTES


def word_ids(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text, and the text as their numbers from 1 on, with one 0 between pieces."""
    marked = b"\n " + raw.lower().translate(PARTS).replace(b"\n", b" \n ") + b" \n"
    coded = pc.dictionary_encode(pc.split_pattern(pa.array([marked], pa.large_binary()), " ").flatten())
    words = coded.dictionary.to_pylist()
    ids, number = np.zeros(len(words), np.int32), 0
    kept = []
    for i, word in enumerate(words):
        if word == b"":
            ids[i] = -1
        elif word != b"\n":
            kept.append(word)
            ids[i] = number = number + 1
    text = ids[coded.indices.to_numpy(zero_copy_only=False)]
    text = text[text >= 0]
    return kept, text[np.concatenate([[True], (text[1:] > 0) | (text[:-1] > 0)])]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their lowest bytes first, then the next ones: the upper ones are mostly zero."""
    n = 3 if not len(numbers) or numbers.max() < 1 << 24 else 4
    return bytes([n]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:n].tobytes()


def _from_planes(stored: bytes) -> np.ndarray:
    planes = np.frombuffer(stored, np.uint8, offset=1).reshape(stored[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i4").reshape(-1)


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    start = 0
    while len(text) - start > size:
        ends = [at for mark in b".,;:!?\n\x0b\x0c\r" if (at := text.find(mark, start + size)) >= 0]
        if not ends:
            break
        yield text[start : min(ends)]
        start = min(ends)
    yield text[start:]


def _indexer(rule: Rule, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "lang", "n_words", "n_phrases", "words", "forward", "reverse"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        shard = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            words, text = word_ids(b"\n".join(held.pop(lang)))
            del size[lang]
            if words:
                index = WordIndex.build(text, len(words) + 1, rule.longest)
                n_words = int(np.count_nonzero(text))
                row = [shard, lang, n_words, n_words * rule.longest, b"\n".join(words), _planes(index.forward), _planes(index.reverse)]
                del text, words, index
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                del row
                give_back()
                shard += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for part in stretches(text.as_py(), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    # one language alone, or all together, are no more than two shards
                    if size[lang] >= shard_bytes or sum(size.values()) >= 2 * shard_bytes:
                        yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(words: list[bytes], lang: str, ids: np.ndarray, bits: int) -> np.ndarray:
    """The key of each phrase of word ids: the upper bits of 48, the others zero."""
    of_word = np.array([0] + [xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    out = np.full(len(ids), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for i in range(ids.shape[1]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + of_word[ids[:, i]])
    return out >> np.uint64(64 - bits) << np.uint64(8 * KEY_BYTES - bits)


@dataclass(frozen=True)
class Ranges:
    """Equal ranges of the keys; a key is stored as its distance from where its range starts."""

    n: int

    def of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(8 * KEY_BYTES - 32)) * np.uint64(self.n)) >> np.uint64(32)

    def start(self, number: int) -> np.uint64:
        return np.uint64(-(-(number << 32) // self.n) << (8 * KEY_BYTES - 32))

    @property
    def width(self) -> int:
        """Bytes of a distance."""
        return -(-(8 * KEY_BYTES - (self.n.bit_length() - 1)) // 8)

    def pack(self, distances: np.ndarray) -> bytes:
        return np.ascontiguousarray(distances.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()

    def unpack(self, stored: bytes) -> np.ndarray:
        out = np.zeros((len(stored) // self.width, 8), np.uint8)
        out[:, : self.width] = np.frombuffer(stored, np.uint8).reshape(-1, self.width)
        return out.view("<u8").reshape(-1)


def _opened(row: dict) -> tuple[list[bytes], WordIndex]:
    names, reverse = row["words"].split(b"\n"), row.get("reverse")
    return names, WordIndex(_from_planes(row["forward"]), reverse and _from_planes(reverse), len(names) + 1)


def _one_by_one(rows: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows that hold a shard each, never two of them as Python objects."""
    for i in range(rows.num_rows):
        yield rows.slice(i, 1).to_pylist()[0]


def _screener(rule: Rule, ranges: Ranges, bits: int):
    """Packed hashes and capped counts of a shard's phrases, one row for each hash range."""
    starts = np.array([ranges.start(r) for r in range(ranges.n)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                words, index = _opened(row)
                shard, lang = row["shard"], row["lang"]
                del row
                # a count stands in the lowest byte under its key: one array is sorted where it is
                found = [_hashed(words, lang, p.words, bits) << np.uint64(8) | np.minimum(p.n, rule.least).astype(np.uint64) for p in index.phrases(rule.longest)]
                del words, index
                packed = np.concatenate(found)
                del found
                packed.sort()
                counts = packed.astype(np.uint8)
                packed >>= np.uint64(8)
                cuts = np.searchsorted(packed, starts).tolist() + [len(packed)]
                of = [r for r in range(ranges.n) if cuts[r] < cuts[r + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(of), pa.int64()),
                        pa.array(of, pa.int64()),
                        pa.array([ranges.pack(packed[cuts[r] : cuts[r + 1]] - starts[r]) for r in of], pa.binary()),
                        pa.array([counts[cuts[r] : cuts[r + 1]].tobytes() for r in of], pa.binary()),
                    ],
                    ["shard", "range", "keys", "counts"],
                )
                del packed, counts
                give_back()

    return run


def _summer(rule: Rule, ranges: Ranges):
    """Of one hash range, the keys of each shard whose counts over all shards reach the least one."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [ranges.unpack(k) for k in rows.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in rows.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.bincount(at, counts)[at] >= rule.least
        ends = np.cumsum([len(k) for k in keys])
        left = [ranges.pack(k[kept[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
        out = pa.table([rows.column("shard"), rows.column("range"), pa.array(left, pa.binary())], ["shard", "range", "keys"])
        give_back()
        return out.filter(pc.greater(pc.binary_length(out.column("keys")), 0))

    return run


def _teller(rule: Rule, ranges: Ranges, bits: int):
    """The texts and occurrences of a shard's phrases that may be frequent."""

    def run(shard: pa.Table, kept: pa.Table) -> pa.Table:
        langs, phrases, sizes, counts = [], [], [], []
        of_ranges = zip(kept.column("range").to_pylist(), kept.column("keys").to_pylist(), strict=True)
        keys = np.concatenate([np.empty(0, np.uint64), *[ranges.unpack(k) + ranges.start(r) for r, k in of_ranges]])
        for row in _one_by_one(shard):
            words, index = _opened(row)
            names = np.array([b"", *words], object)
            for p in index.phrases(rule.longest):
                chosen = np.isin(_hashed(words, row["lang"], p.words, bits), keys)
                told = [b" ".join(x) for x in names[p.words[chosen]].tolist()]
                phrases.append(pa.array(told, pa.binary()).cast(pa.string()))
                counts.append(pa.array(p.n[chosen], pa.int64()))
                sizes.append(pa.array(np.full(len(told), p.words.shape[1]), pa.int32()))
                langs += [row["lang"]] * len(told)
        texts = pa.chunked_array(phrases, pa.string())
        give_back()
        return pa.table([pa.array(langs, pa.string()), pa.chunked_array(sizes, pa.int32()), texts, pa.chunked_array(counts, pa.int64())], ["lang", "size", "phrase", "n"])

    return run


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand rows to Python one by one: a row is a whole shard, and a task should hold no second one."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def frequent(docs: DataFrame, rule: Rule = Rule(), sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``(lang, size, phrase, n)`` of all phrases of 1 to ``longest`` words with ``least`` occurrences, and
    ``(lang, n)``, all words of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text(docs["text"]).alias("text"))
    index = written(rows.mapInArrow(_indexer(rule, sizes.shard), INDEX), "word-indexes")
    total = index.agg(F.sum("n_phrases")).first()[0] or 0
    ranges = Ranges(max(1, -(-total // sizes.range)))
    screened = index.select("shard", "lang", "words", "forward", "reverse").mapInArrow(_screener(rule, ranges, sizes.bits), "shard bigint, range bigint, keys binary, counts binary")
    kept = screened.groupBy("range").applyInArrow(_summer(rule, ranges), "shard bigint, range bigint, keys binary")
    # the texts of phrases need one transform only
    told = index.select("shard", "lang", "words", "forward").groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(_teller(rule, ranges, sizes.bits), "lang string, size int, phrase string, n bigint")
    counted = told.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.least)
    with one_row_batches(docs.sparkSession):
        counts = written(counted, "phrases")
    return counts, index.groupBy("lang").agg(F.sum("n_words").alias("n"))


def scored(counted: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """``(lang, phrase, a, l, r, score)`` of the candidates that are not covered by a longer one.

    The score, a million times ``a * a / (l * r)``, is that of the weakest cut.
    """
    words = F.split("phrase", " ")
    longer = counted.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), joined(1, k).alias("first"), joined(k + 1, F.col("size") - k).alias("rest")))
    cut = longer.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = counted.select("lang", "phrase", "n")
    with_first = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    with_both = with_first.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    exact = with_both.withColumn("__up", wide("a") * wide("a") * F.lit(1_000_000)).withColumn("__down", wide("l") * wide("r"))
    weakest = exact.withColumn("score", F.expr("__up div __down")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    # every shorter phrase that a candidate of three words or more holds
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda start: joined(start, n))))
    covers = longer.where("size > 2").select("lang", "a", F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(rule.covered) * wide("a"))
    return weakest.join(covers, ["lang", "phrase"], "left").where(free).select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, first: int = 2000, rule: Rule = Rule(), sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``first`` phrases of each language by score."""
    counted, totals = frequent(docs, rule, sizes)
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored(counted, rule).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= first).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
