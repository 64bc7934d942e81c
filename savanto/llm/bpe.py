"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the encoding ends in exactly one token. An automaton of the vocabulary gives
the tokens that end at each position; the last token of a prefix is the one that is compatible with the
last token of the prefix before it, that is, the two stay as they are when their joined bytes are
encoded. Following the last tokens back from the end of the word gives the ids. No merge is simulated.

The library's own pre-tokeniser cuts the words, so that both agree on character classes. Null texts
count as empty and have no ids. Strings of added tokens inside a text become those tokens, as the
library does by default. Rows keep their order and number; other columns of the input stay as they are.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from savanto.llm import vocabulary
from savanto.llm.common import slices, whole_text

#: Pairs of tokens whose compatibility one worker remembers.
KNOWN_PAIRS = 1 << 18
#: Words that one worker remembers: fewer than with the library, as the automaton and the pairs take memory too.
WORDS = 150_000
#: Bytes of text encoded at once.
SLICE = 1 << 20


class Merges:
    """The vocabulary of a byte-level BPE file: tokens, the two parts of each, and the rank of a merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # two parts: rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, two parts
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merged.setdefault(pair, (rank, token))
            self.parts.setdefault(token, (rank, *pair))
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for letters, token in self.ids.items():
            if len(letters) == 1 or token in self.parts:
                self.automaton.add_word(letters, (len(letters), token))
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two."""
        pair = left << 32 | right
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            found = self.known[pair] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, the latest first. The tokens stay apart unless, at some time,
        the two that meet at the border could have merged before the merge that came next in fact.

        Of equal ranks the left one comes first: a merge across the border comes after one inside the
        left token, and before one inside the right token.
        """
        limit = (len(self.merged), 0)
        while True:
            across = self.merged.get((left, right))
            if across is not None and (across[0], 1) < limit:
                return False
            in_left, in_right = self.parts.get(left), self.parts.get(right)
            if in_left is None and in_right is None:
                return True
            if in_right is None or in_left is not None and in_left[0] > in_right[0]:
                limit, left = (in_left[0], 0), in_left[2]
            else:
                limit, right = (in_right[0], 2), in_right[1]

    def encode(self, word: str) -> list[int]:
        """The ids of a word given in byte letters."""
        last: list[tuple[int, int] | None] = [None] * len(word)  # for each prefix: its last token, and where that starts
        known = self.known.get  # most pairs are: they are looked up here
        for end, (size, token) in self.automaton.iter(word):
            if last[end] is None:
                start = end - size  # the end of the prefix before
                if start < 0:
                    last[end] = (token, start)
                elif (before := last[start]) is not None:
                    apart = known(before[0] << 32 | token)
                    if self.compatible(before[0], token) if apart is None else apart:
                        last[end] = (token, start)
        ids, at = [], len(word) - 1
        while at >= 0:
            token, at = last[at]
            ids.append(token)
        ids.reverse()
        return ids


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


@functools.cache
def encoder(path: str) -> vocabulary.TextEncoder:
    """Whole texts to packed ids."""
    made = vocabulary.text_encoder(path, merges(path).encode, WORDS)
    vocabulary.library.cache_clear()  # its pre-tokeniser stays, its model is not needed here
    return made


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; ids without a token have none."""
    letters = vocabulary.byte_letters()
    with open(path, encoding="utf-8") as file:  # not by way of merges(): decoding needs neither pairs nor automaton
        tokens = json.load(file)["model"]["vocab"]
    tokens |= vocabulary.added_tokens(path)
    out = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def _texts(found: np.ndarray, ends: np.ndarray, table: list[bytes]) -> list[str]:
    """The texts that runs of ids stand for."""
    all_ids = found.tolist()
    return [b"".join([table[i] for i in all_ids[a:b]]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None, decoded: str | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) and the ids of ``text`` as an array of integers.

    With ``decoded``, also the text that the ids stand for, made from the ids by the same workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, to_ids = token_bytes(tokenizer) if decoded else [], encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                found, ends = to_ids.flat(part.column("__text"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view("<i4")))
                back = [pa.array(_texts(found, ends, table), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *back], names)

    kept = docs.select(*[c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)])
    made = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    out = T.StructType([*kept.schema.fields, *made])
    names = out.names
    return docs.select(*kept.columns, whole_text(text).alias("__text")).mapInArrow(run, out)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text that ``ids`` stand for; broken characters become U+FFFD.

    A null list gives an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = _texts(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), table)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text])

    kept = rows.drop(text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def digests(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ids as decimals joined by commas, texts in UTF-8."""
    decimals = F.concat_ws(",", F.col(ids).cast("array<string>"))
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
