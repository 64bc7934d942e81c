"""Near duplicates by a signature-coordinate inverted join.

Every document has a signature of minimum hashes over its word shingles. Of two documents that are alike
enough, at least ``needed`` coordinates agree (but for a chance of ``LOSS`` at the threshold itself). So
they also meet among the ``size - needed + 1`` rarest coordinate values of each: only those are posted,
and values that no second document has are not posted at all. Rare-first order keeps values of passages
that many documents share out of the postings.

Documents that meet in a posting are not paired there. They are gathered in small blocks around the
smallest document they meet, and pairs of blocks that share a posting are compared inside one task:
coinciding coordinates are counted first, pairs above the threshold are confirmed on their full shingle
sets, and links that join nothing new are skipped. A large group so moves each text once per block
instead of once per pair, and every task holds two blocks.

Documents with the same shingle set are folded before all this. Documents without words (null, empty or
blank text) have an empty set and are linked with nothing; with fewer words than a shingle has, the whole
sequence is the one shingle. Rows that repeat an id are one document, alike to what
any of its texts is alike to; rows without an id stay by themselves. Very long texts are used whole. Other columns
are not looked at, and kept by :func:`deduplicated`. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savanto.llm.common import slices, whole_text
from savanto.llm.components import components
from savanto.session import written

#: Chance that a pair exactly at the threshold has too few coordinates in common.
LOSS = 1e-6
#: Documents, and shingles, of a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 18
#: Hashes of words that one worker remembers.
KNOWN_WORDS = 1 << 18

_known: dict[bytes, int] = {}


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; documents are alike if ``100 * common >= percent * all`` shingles."""

    words: int = 5
    percent: int = 80
    size: int = 64
    seed: int = 1

    @property
    def needed(self) -> int:
        """Coordinates that agree in alike documents, but for a chance of ``LOSS``."""
        p, lost, needed = self.percent / 100, 0.0, 0
        while needed < self.size:
            lost += comb(self.size, needed) * p**needed * (1 - p) ** (self.size - needed)
            if lost > LOSS:
                break
            needed += 1
        return max(needed, 1)

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed).integers(0, 1 << 63, (2, self.size), np.uint64)
        return draw[0] | np.uint64(1), draw[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. Only A-Z are lower-cased, and only the
    blank and the characters from tab to carriage return separate words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    hashes = np.array([h if (h := _known.get(w)) is not None else _known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in found], np.uint64)
    n = min(words, len(hashes))
    if n == 0:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def signature(set_: np.ndarray, like: Likeness) -> np.ndarray:
    """The coordinate values: the least of each hash over the set, told apart by coordinate."""
    a, b = like.coordinates()
    least = np.full(like.size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(set_), 4096):
        part = _mix(set_[None, start : start + 4096] * a[:, None] + b[:, None])
        np.minimum(least, part.min(axis=1), out=least)
    return _mix(least + a).view(np.int64)


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """``(doc_id, n_shingles, same, signature)``; ``same`` is a 128-bit digest of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, like.words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s, like) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "same", "signature"],
                )

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, same binary, signature array<bigint>")


def postings(signed: DataFrame, like: Likeness) -> DataFrame:
    """``(doc, value)``: the coordinate values by which alike documents must meet."""
    values = signed.select("doc", F.explode("signature").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_doc = values.join(shared, "value").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("shared"))
    # values without a second document are the rarest: they take their places in the prefix unposted
    rarest = F.slice("shared", 1, F.size("shared") - like.needed + 1)
    found = of_doc.where(F.size("shared") >= like.needed).select("doc", F.explode(rarest).alias("s")).select("doc", F.col("s.value").alias("value"))
    return written(found, "postings")


def block_pairs(posted: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, block)`` of the posted documents, and the pairs ``(left, right)`` of blocks that meet."""
    meetings = posted.groupBy("value").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written(posted.join(meetings, "value"), "meetings")
    leaders = written(met.groupBy("doc").agg(F.min("least").alias("leader")), "leaders")
    # one hop more: documents that follow a follower go to its leader
    onward = leaders.select(F.col("doc").alias("leader"), F.col("leader").alias("onward"))
    gathered = leaders.join(onward, "leader").select("doc", F.col("onward").alias("leader"))
    sized = written(gathered.join(signed.select("doc", "n_shingles"), "doc"), "gathered")
    groups = sized.groupBy("leader").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    )
    block = F.xxhash64("leader", F.pmod(F.xxhash64("doc"), F.col("n_blocks")))
    blocks = written(sized.join(groups, "leader").select("doc", block.alias("block")).distinct(), "blocks")
    spots = written(met.select("doc", "value").join(blocks, "doc").select("value", "block").distinct(), "spots")
    left, right = spots.select("value", F.col("block").alias("left")), spots.select("value", F.col("block").alias("right"))
    pairs = left.join(right, (left["value"] == right["value"]) & (F.col("left") <= F.col("right"))).select("left", "right").distinct()
    return blocks, pairs


def _links_of(sets: list[np.ndarray], signed: np.ndarray, other: np.ndarray, ids: list[int], like: Likeness) -> list[tuple[int, int]]:
    """Links between the documents of two blocks (within one, where there is but one), as a forest."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.flatnonzero(~other) if other.any() else np.arange(len(ids))
    second = np.flatnonzero(other) if other.any() else first
    equal = np.stack([(signed[i] == signed[second]).sum(axis=1) for i in first])
    at, to = np.nonzero(equal >= like.needed)
    order = np.argsort(-equal[at, to], kind="stable")
    links = []
    for i, j in zip(first[at[order]].tolist(), second[to[order]].tolist(), strict=True):
        a, b = find(i), find(j)
        if a == b:
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= like.percent * (len(sets[i]) + len(sets[j]) - common):
            root[a] = b
            links.append((ids[i], ids[j]))
    return links


def links(docs: DataFrame, signed: DataFrame, blocks: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """``(a, b)``: confirmed links that join all alike documents (those already joined in a task are left out)."""
    sides = F.explode(F.array(F.struct(F.col("left").alias("block"), F.lit(False).alias("other")), F.struct(F.col("right").alias("block"), F.lit(True).alias("other"))))
    tasks = pairs.select("left", "right", sides.alias("s")).select("left", "right", "s.*").where("not other or left <> right")
    members = blocks.join(tasks, "block").select("doc", "left", "right", "other")
    texts = docs.select(F.col("doc_id").alias("doc"), whole_text().alias("text")).join(blocks.select("doc"), "doc", "left_semi")
    rows = members.join(written(texts, "posted-texts"), "doc").repartition("left", "right").sortWithinPartitions("left", "right", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[dict]:
            for batch in batches:
                for part in slices(batch):
                    yield from part.to_pylist()

        found: list[tuple[int, int]] = []
        for _, group in itertools.groupby(one_by_one(), lambda r: (r["left"], r["right"])):
            ids, other, sets, before = [], [], [], None
            for row in group:
                if before != (before := (row["doc"], row["text"])):
                    ids.append(row["doc"])
                    other.append(row["other"])
                    sets.append(shingles(row["text"], like.words))
            signed = np.stack([signature(s, like) for s in sets])
            found += _links_of(sets, signed, np.array(other), ids, like)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})
                found = []
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs`` (columns ``doc_id``, ``text``)."""
    signed = written(signatures(docs, like), "signatures")
    known = signed.where("doc_id is not null and same is not null")
    classes = written(known.groupBy("same").agg(F.min("doc_id").alias("first")), "classes")
    firsts = (  # one row for each class, though rows may repeat
        known.join(classes, "same").where("doc_id = first").groupBy("same", F.col("doc_id").alias("doc")).agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    )
    reps = written(firsts, "representatives")
    posted = postings(reps, like)
    blocks, pairs = block_pairs(posted, reps)
    found = links(docs, reps, blocks, pairs, like)
    same = known.join(classes, "same").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    joined = components(found.unionByName(same))
    out = signed.join(joined, signed["doc_id"] == joined["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` but those of documents that are alike to one with a smaller id."""
    gone = near_duplicates(docs, like).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
