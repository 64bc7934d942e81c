"""Encoding of whole texts by a byte-level BPE file, word by word with a bounded memory of words.

A byte-level pre-tokeniser never joins a white-space character to the character before it, unless
that is white space too. A text may therefore be cut before every run of white space, and the ids of
the text are the ids of its pieces in order. Words repeat, so each distinct word is encoded once per
worker while it stays in memory.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Words kept in memory by one worker: of Latin letters, other words, and pieces of other words, each this many.
WORDS = 400_000
#: Characters of one text that are cut into pieces at once.
STRETCH = 1 << 20


@functools.cache
def library(path: str):
    """The tokeniser of a file, single-threaded: Spark runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def version(path: str) -> str:
    """Digest of the tokeniser file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def added_tokens(path: str) -> dict[str, int]:
    """Strings that the library takes out of a text before all else."""
    return {t.content: i for i, t in library(path).get_added_tokens_decoder().items()}


def byte_level(path: str) -> bool:
    """Whether texts may be cut at white space: byte-level, nothing normalised, plain added tokens."""
    loaded = library(path)
    plain = all(
        not (t.lstrip or t.rstrip or t.single_word or t.normalized)
        for t in loaded.get_added_tokens_decoder().values()
    )
    return plain and loaded.normalizer is None and type(loaded.pre_tokenizer).__name__ == "ByteLevel" and not loaded.pre_tokenizer.add_prefix_space


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A long text in parts that end where a piece ends."""
    start = 0
    while len(text) - start > size:
        cut = next((m.start() for m in re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]").finditer(text, start + size)), None)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


class TextEncoder:
    """Whole texts to ids; ``memory`` gives the packed ids of pieces, ``special`` those of added tokens."""

    def __init__(self, memory: WordEncoder, special: dict[str, bytes]) -> None:
        self.memory, self.special = memory, special
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # texts that blanks alone would not cut into pieces, or that hold the mark of the first piece
        self.uneven = f"[{WHITE_SPACE}] |\x00" + "".join("|" + re.escape(t) for t in special)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids start and end."""
        uneven = pc.or_(pc.match_substring_regex(texts, self.uneven), pc.greater(pc.binary_length(texts), STRETCH)).to_numpy(zero_copy_only=False)
        if not uneven.any():
            return self._even(texts)
        ids, ends = self._even(texts.filter(pa.array(~uneven)))
        even = (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        alone = (np.frombuffer(self.one(t), "<u4") for t in texts.filter(pa.array(uneven)).to_pylist())
        parts = [next(alone) if u else next(even) for u in uneven]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose pieces are parted by single blanks: each distinct piece is looked up once."""
        lists = pc.split_pattern(pc.binary_join_element_wise("\x00", texts, ""), " ")
        coded = pc.dictionary_encode(lists.flatten())
        values = self.memory.of([p[1:] if p[:1] == "\x00" else " " + p for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
        # a slice has fewer than 2**31 ids
        sizes = np.array([len(v) // 4 for v in values], np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[at]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32)
        where = np.repeat(starts[at] - ends[:-1], size)
        where += np.arange(ends[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(values), "<u4")[where]
        n_pieces = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, ends[n_pieces.astype(np.int64)]

    def one(self, text: str) -> bytes:
        """The packed ids of any text."""
        out = []
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                for stretch in stretches(part):
                    pieces = PIECE.findall(stretch)
                    distinct = list(set(pieces))
                    known = dict(zip(distinct, self.memory.of(distinct), strict=True))
                    out += [known[p] for p in pieces]
        return b"".join(out)


#: One line end at most, one word of Latin letters, then marks without an apostrophe: a piece that any
#: byte-level pre-tokeniser cuts just there.
SIMPLE = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ʯ]+)?([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it is visible in Latin-1,
    the others in order from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


LETTERS = {byte: letter for letter, byte in byte_letters().items()}
BLANK, LINE_END = LETTERS[32], LETTERS[10]
#: Marks of :data:`SIMPLE` that end sentences and clauses.
MARKS = frozenset(".,;:!?")


class WordEncoder:
    """Packed ids of pieces, by way of their words in byte letters; words are remembered.

    Pieces of Latin letters are not: few come again, and their words are found as fast.
    """

    def __init__(self, path: str, encode: Callable[[str], list[int]], size: int = WORDS) -> None:
        self.split, self.encode, self.size = library(path).pre_tokenizer.pre_tokenize_str, encode, size
        self.known: dict[str, bytes] = {}  # Latin letters, with a blank before or without, as they stand in the text
        self.others: dict[str, bytes] = {}  # all other words, in byte letters
        self.whole: dict[str, bytes] = {}  # pieces that the library cuts

    def _keep(self, memory: dict[str, bytes], name: str, ids: bytes) -> bytes:
        if len(memory) >= self.size:
            memory.clear()
        memory[name] = ids
        return ids

    def latin(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            # of ASCII, in byte letters only the blank differs
            letters = word.replace(" ", BLANK) if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
            found = self._keep(self.known, word, packed(self.encode(letters)))
        return found

    def other(self, word: str) -> bytes:
        found = self.others.get(word)
        return self._keep(self.others, word, packed(self.encode(word))) if found is None else found

    def piece(self, piece: str) -> bytes:
        simple = SIMPLE.fullmatch(piece)
        if simple is None:
            parts = PIECE.findall(piece)  # of texts cut at blanks, a piece may hold line ends
            if len(parts) > 1:
                return b"".join(self.of(parts))
            found = self.whole.get(piece)
            return self._keep(self.whole, piece, b"".join([self.other(word) for word, _ in self.split(piece)])) if found is None else found
        line, word, marks = simple.groups()
        return (self.other(LINE_END) if line else b"") + (self.latin(word) if word else b"") + (self.other(marks) if marks else b"")

    def of(self, pieces: list[str]) -> list[bytes]:
        known, out = self.known.get, []
        for piece in pieces:
            found = known(piece)
            if found is None:
                # a known word, and a comma or the like behind it
                if piece[-1:] in MARKS and (word := known(piece[:-1])) is not None:
                    found = word + self.other(piece[-1])
                else:
                    found = self.piece(piece)
            out.append(found)
        return out


@functools.lru_cache(64)
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return _packer(len(ids))(*ids)


def text_encoder(path: str, encode: Callable[[str], list[int]], size: int = WORDS) -> TextEncoder:
    """Whole texts to ids; ``encode`` gives the ids of a word in byte letters, ``size`` words are remembered."""
    if not byte_level(path):
        raise ValueError(f"{path} is no plain byte-level tokeniser")
    return TextEncoder(WordEncoder(path, encode, size), {t: packed([i]) for t, i in added_tokens(path).items()})


@functools.cache
def library_encoder(path: str) -> TextEncoder:
    """Words encoded by the library's model."""
    model = library(path).model
    return text_encoder(path, lambda word: [t.id for t in model.tokenize(word)])
