"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, by a frequency-vector trie.

The letters are dealt to groups. A word is its length and how many of its letters each group has; one edit
leaves the vector as it is, adds one, takes one away, or does one of both. The trie has the length on its first
level and the groups on the next ones. A search goes down depth first with a budget of one surplus and one
deficit, for many words at once: at a node those go on whose budget the child's count does not overdraw. At
the leaves the words themselves are compared.

The upper ``TOP`` levels of the trie are the keys by which tries are dealt to tasks: a word is sent to each
key that its budget reaches, of which there are at most 31, if the key has words. Keys with many words or many
searches are dealt to several tries and several rows of searches, so no task holds more than about ``PART``
words and ``SEARCHES`` searches at once. Every near pair is found where its words meet, once for each of the two.

Words are counted over whole texts; null and empty texts have none, repeated rows count as often as they stand
there, a null id counts as an empty one. Very long runs of letters are words like any other. Extra columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.llm.common import slices, whole_text
from savanto.session import written

#: Letters in groups of about equal use (fixed values); all others are the last group.
GROUPS = ("e", "ai", "on", "rt", "s", "lh", "du", "cmf", "pgwyb")
#: Levels of the trie that a task's key has: the length and the first groups.
TOP = 5
#: Words of one trie, searches that go down it together, and words of a node that are compared without going on.
PART, SEARCHES, LEAF = 4096, 1 << 16, 4
#: Distinct words that a task counts before it sends them on.
HELD = 200_000

#: Letters of ASCII and of U+00C0 to U+00FF in UTF-8; bytes that end any run; bytes of a text that are searched at once.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")
STRETCH = 1 << 22


@dataclass(frozen=True)
class Spelling:
    """Words counted: of ``letters`` code points and ``least`` occurrences at least. A run whose hash ``drop``
    divides loses a letter (0: none does). A form occurs ``times`` as often as the word at least."""

    letters: int = 6
    least: int = 5
    drop: int = 0
    times: int = 5

    def __post_init__(self) -> None:
        if self.times < 2:
            raise ValueError("words of equal frequency would be forms of each other")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A long text in parts that end where no run goes on."""
    start = 0
    while len(text) - start > size and (end := BREAK.search(text, start + size)):
        yield text[start : end.start()]
        start = end.start()
    yield text[start:]


def counted(docs: DataFrame, rule: Spelling) -> DataFrame:
    """``(word, n)``: the words of all texts with their occurrences."""

    def send(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # of bytes only A-Z are lower-cased
                    for stretch in stretches(text.encode("utf-8", "surrogatepass").lower()):
                        count(RUN.findall(stretch), start, total)
                    if len(total) > HELD:
                        yield send(total)
                        total = Counter()
        yield send(total)

    def count(found: list[bytes], start: int, total: Counter) -> None:
        if not rule.drop:
            total.update(found)
            return
        for word, n in Counter(found).items():
            h = zlib.crc32(word, start)
            if h % rule.drop == 0:
                letters = word.decode()
                at = h % len(letters)
                word = (letters[:at] + letters[at + 1 :]).encode()
            total[word] += n

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text(docs["text"]).alias("text"))
    n = rows.mapInArrow(run, "word string, n bigint").where(F.length("word") >= rule.letters).groupBy("word").agg(F.sum("n").alias("n"))
    return n.where(F.col("n") >= rule.least)


def top(word: Column) -> Column:
    """The upper levels of a word: its length, and its letters of the first groups."""
    n = F.length(word)
    return F.array(n, *[n - F.length(F.translate(word, group, "")) for group in GROUPS[: TOP - 1]])


#: The group of each ASCII letter; the last one is that of all others.
GROUP_OF = np.full(128, len(GROUPS), np.int64)
for _i, _group in enumerate(GROUPS):
    GROUP_OF[[ord(c) for c in _group]] = _i


def vectors(words: list[str]) -> np.ndarray:
    """Length, letters of each group, and the letters of no group."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    n = len(GROUPS) + 1
    at = np.repeat(np.arange(len(words)), lengths) * n + GROUP_OF[np.minimum(letters, 127)]
    return np.column_stack([lengths, np.bincount(at, minlength=n * len(words)).reshape(-1, n)]).astype(np.int32)


def reachable(v: Column) -> Column:
    """The keys that one surplus and one deficit reach from the upper levels: the length changes by their sum."""
    changes = {(0,) * TOP, (1, *[0] * (TOP - 1)), (-1, *[0] * (TOP - 1))}
    unit = lambda i, d: tuple(d if k == i else 0 for k in range(1, TOP))
    for i in range(1, TOP):
        # the other letter may lie in a group below the key, or there may be none
        changes |= {(1, *unit(i, 1)), (0, *unit(i, 1)), (-1, *unit(i, -1)), (0, *unit(i, -1))}
        changes |= {(0, *(a + b for a, b in zip(unit(i, 1), unit(j, -1), strict=True))) for j in range(1, TOP) if j != i}
    return F.array(*[F.array_join(F.array(*[F.get(v, k) + F.lit(d) for k, d in enumerate(c)]), ",") for c in sorted(changes)])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells two words apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:])


class Trie:
    """Words sorted by their vectors: a node is a range of them that agree on the levels above."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        of = vectors(words)
        order = np.lexsort(of.T[::-1])
        self.words, self.n = [words[i] for i in order], [counts[i] for i in order]
        self.vectors = np.ascontiguousarray(of[order])

    def near(self, words: list[str]) -> list[tuple[int, int]]:
        """``(search, word)``: all pairs that one edit tells apart, as places in ``words`` and ``self.words``."""
        found: list[tuple[int, int]] = []
        of, depth = vectors(words), self.vectors.shape[1]

        def down(level: int, low: int, high: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
            if high - low <= LEAF:
                for k in range(low, high):
                    rest = self.vectors[k, level:] - of[who, level:]
                    left = (surplus >= np.maximum(rest, 0).sum(axis=1)) & (deficit >= np.maximum(-rest, 0).sum(axis=1))
                    found.extend((i, k) for i in who[left].tolist() if one_edit(words[i], self.words[k]))
                return
            if level == depth:
                found.extend(self._equal_vectors(low, high, words, who.tolist()))
                return
            column = self.vectors[low:high, level]
            cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), high - low]
            own = of[who, level]
            for a, b in zip(cuts, cuts[1:], strict=False):
                more = column[a] - own
                left = (more <= surplus) & (-more <= deficit)
                if left.any():
                    more = more[left]
                    down(level + 1, low + a, low + b, who[left], surplus[left] - (more > 0), deficit[left] - (more < 0))

        # the length is the sum of the other levels: it has no budget of its own
        lengths = self.vectors[:, 0]
        cuts = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            who = np.flatnonzero(abs(of[:, 0] - lengths[a]) <= 1) if a < b else np.empty(0, np.int64)
            if len(who):
                down(1, a, b, who, np.ones(len(who), np.int32), np.ones(len(who), np.int32))
        return found

    def _equal_vectors(self, low: int, high: int, words: list[str], who: list[int]) -> Iterator[tuple[int, int]]:
        """Pairs within many words of one vector: an edit leaves their first or their last half as it is."""
        length = len(self.words[low])
        for shorter in {min(length, len(words[i])) for i in who}:
            half = shorter // 2
            ends: dict[tuple[bool, str], list[int]] = {}
            for k in range(low, high):
                ends.setdefault((True, self.words[k][:half]), []).append(k)
                ends.setdefault((False, self.words[k][length - (shorter - half) :]), []).append(k)
            for i in who:
                word = words[i]
                if min(length, len(word)) == shorter:
                    met = {*ends.get((True, word[:half]), ()), *ends.get((False, word[len(word) - (shorter - half) :]), ())}
                    yield from ((i, k) for k in met if one_edit(word, self.words[k]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``place``, each place's trie words before its searches."""
    place, own, counts, held = None, [], [], []
    trie: Trie | None = None

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal trie, own, counts, held
        if held and (own or trie):
            if trie is None:
                trie, own, counts = Trie(own, counts), [], []
            pairs = trie.near(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[i] for i, _ in pairs], pa.string()), pa.array([trie.words[k] for _, k in pairs], pa.string()), pa.array([trie.n[k] for _, k in pairs], pa.int64())],
                ["word", "other", "other_n"],
            )
        held = []

    for batch in batches:
        for of, search, word, n in zip(*(batch.column(c).to_pylist() for c in ("place", "search", "word", "n")), strict=True):
            if of != place:
                yield from answers()
                place, trie, own, counts = of, None, [], []
            if search:
                held.append(word)
                if len(held) >= SEARCHES:
                    yield from answers()
            else:
                own.append(word)
                counts.append(n)
    yield from answers()


def near_words(words: DataFrame) -> DataFrame:
    """``(word, other, other_n)``: both directions of every pair of ``words`` (``word``, ``n``) one edit apart."""
    known = written(words.select("word", "n", top(F.col("word")).alias("top")).withColumn("key", F.array_join("top", ",")), "spelling-words")
    asked = known.select("word", "n", F.explode(reachable(F.col("top"))).alias("key"))
    # how many tries a key is dealt to, and how many groups of searches come to each
    tries = known.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("tries"))
    asks = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("asks"))
    shape = written(tries.join(asks, "key"), "spelling-keys")
    name = lambda t, a: F.concat_ws(":", "key", t.cast("string"), a.cast("string"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    stored = known.join(shape, "key").withColumn("a", each("asks")).select(name(dealt("tries"), F.col("a")).alias("place"), F.lit(False).alias("search"), "word", "n")
    searches = asked.join(shape, "key").withColumn("t", each("tries")).select(name(F.col("t"), dealt("asks")).alias("place"), F.lit(True).alias("search"), "word", "n")
    rows = stored.unionByName(searches).repartition("place").sortWithinPartitions("place", "search")
    return rows.mapInArrow(_searched, "word string, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form: the last one on the way from form to form.

    A form occurs several times as often as its word, so ways are short; each round doubles the step."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = written(moved, "spelling-roots")
        at = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:  # noqa: B008
    """``(word, n, n_near, form, form_n, root)`` of every counted word.

    ``form`` is the near word with most occurrences (the smallest of equal ones) if it has enough of them,
    ``root`` the last word on the way from form to form, the word itself if it has no form."""
    words = written(counted(docs, rule), "spelling-counts")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("fewer"), "other")).alias("best")
    )
    found = words.join(near, "word", "left")
    enough = -F.col("best.fewer") >= F.col("n") * rule.times
    marked = written(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.fewer")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(marked.where("form is not null"))
    return marked.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
