"""Byte-pair encoding with word ends, merged through a segment tree over adjacent pair ranks.

A text is composed (NFC), lower-cased and split into words, a word into the characters that stand for its bytes, the
last of which carries the word end. No word reaches across white space. The pairs of neighbours are the leaves of a segment tree: a leaf
holds the pair's rank and place, an inner node the least of its children, so the root names the leftmost pair of
the lowest rank. A merge changes at most three leaves, each in logarithmic time. Nothing is left to merge once the
root is empty.

Words are remembered up to a bound, since text repeats them. Special tokens that stand in a text become their ids,
as in the tokenizers library. What stands between white space and has letters beyond Latin is composed, lower-cased and split by that
library's own normaliser, whose Unicode tables are newer than Python's; merging never is.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtide.llm.byte_bpe import CHARACTERS
from jobtide.llm.common import by_bytes, extended, prepare

#: Words that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 64
#: Characters of text, and ids, worked on at a time.
SLICE = 1 << 20
#: What splits words; the file must state the same pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that Python and the library lower-case, compose and classify alike: Latin and punctuation.
PLAIN = regex.compile(r"[\x00-\x7f\xa1-ɏ‐-‧‰-⁞]*")
SPACE = regex.compile(r"\s+")


#: Above every rank and place: what a place without a mergeable pair holds.
NONE = 1 << 50
NO_PAIR = (NONE, 0)


class PairTree:
    """Minimum segment tree over the places of one word; a place holds the rank of the pair that begins there."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(len(ranks) - 1, 0).bit_length()
        level = [rank * size + place for place, rank in enumerate(ranks)]
        level += [NONE * size] * (size - len(level))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        # Node i has the children 2 i and 2 i + 1; the root is node 1.
        self.nodes = [0]
        for level in reversed(levels):
            self.nodes += level

    def least(self) -> int | None:
        """The place of the leftmost pair of the lowest rank."""
        return self.nodes[1] % self.size if self.nodes[1] < NONE else None

    def put(self, place: int, rank: int) -> None:
        """Set a place's rank, and the path above it as far as it changes."""
        nodes, at = self.nodes, self.size + place
        nodes[at] = value = rank * self.size + place
        while at > 1:
            beside = nodes[at ^ 1]
            if beside < value:
                value = beside
            at >>= 1
            if nodes[at] == value:
                return
            nodes[at] = value


class Codec:
    """Encodes and decodes with one vocabulary file; a worker keeps one per file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        stages = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (
            model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges")
            or spec["decoder"] or spec["post_processor"] or stages != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
            or split["pattern"] != {"Regex": WORDS}
        ):
            raise ValueError("not a vocabulary of lower-case words with word ends")
        end, number = model["end_of_word_suffix"] or "", model["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.merges = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner, self.last = [number[c] for c in CHARACTERS], [number[c + end] for c in CHARACTERS]
        self.bytes = {c: b for b, c in enumerate(CHARACTERS)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (number | self.special).items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.library = Tokenizer.from_str(data.decode())
        self.words = regex.compile(WORDS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.seen: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word."""
        ids: list[int | None] = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, known = len(ids), self.merges.get
        if n == 1:
            return ids
        pairs = [known(pair, NO_PAIR) for pair in zip(ids, ids[1:])]
        tree = PairTree([rank for rank, _ in pairs])
        put, nodes, size = tree.put, tree.nodes, tree.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := nodes[1]) < NONE:
            at = least % size
            gone = after[at]
            ids[at] = merged = pairs[at][1]
            ids[gone] = None
            after[at] = behind = after[gone]
            if behind < n:
                before[behind] = at
                put(gone, NONE)
                pairs[at] = pair = known((merged, ids[behind]), NO_PAIR)
                put(at, pair[0])
            else:
                put(at, NONE)
            left = before[at]
            if left >= 0:
                pairs[left] = pair = known((ids[left], merged), NO_PAIR)
                put(left, pair[0])
        return [i for i in ids if i is not None]

    def _library_words(self, piece: str) -> list[str]:
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes([self.bytes[c] for c in word]).decode() for word, _ in words]

    def split(self, text: str) -> list[str]:
        """The lower-case words of a text without special tokens."""
        if PLAIN.fullmatch(text):
            return self.words(text.lower())
        words = []
        for piece in SPACE.split(text):
            words += self.words(piece.lower()) if PLAIN.fullmatch(piece) else self._library_words(piece)
        return words

    def _ids(self, text: str) -> bytes:
        words, seen = self.split(text), self.seen
        fresh = set(words).difference(seen)
        if not fresh:
            return b"".join([seen[w] for w in words])
        if 2 * (len(seen) + len(fresh)) > REMEMBERED:
            # The words before the last ones are forgotten; those still in use come back as they are met.
            self.earlier, self.seen = seen, {}
            seen, fresh = self.seen, set(words)
        for word in fresh:
            found = self.earlier.get(word)
            if found is None:
                ids = self.merge(word.encode())
                found = struct.pack(f"<{len(ids)}i", *ids)
            seen[word] = found
        joined = b"".join([seen[w] for w in words])
        for word in fresh:
            if len(word) > LONGEST or 2 * len(fresh) > REMEMBERED:
                del seen[word]
        return joined

    def _section(self, text: str) -> bytes:
        if not any(token in text for token in self.special):
            return self._ids(text)
        parts = self.cut.split(text)
        return b"".join([struct.pack("<i", self.special[p]) if p in self.special else self._ids(p) for p in parts if p])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if len(text) <= SLICE:
            return self._section(text)
        parts, begin = [], 0
        while begin < len(text):
            space = SPACE.search(text, min(begin + SLICE, len(text)))
            upto = space.end() if space else len(text)
            parts.append(self._section(text[begin:upto]))
            begin = upto
        return b"".join(parts)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list, joined by blanks: the file names no decoder."""
        tokens = pc.take(self.names, ids.flatten())
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))])
        return pc.binary_join(pa.LargeListArray.from_arrays(starts, tokens), " ")


@lru_cache(maxsize=2)
def _codec(digest: str, load) -> Codec:
    return Codec(load.value)


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` in size, one row at least."""
    ends = np.cumsum(sizes.astype(np.int64))
    begin = 0
    while begin < len(ends):
        upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)))
        yield begin, upto
        begin = upto


class WordVocabulary:
    """A vocabulary file for Spark jobs. The file is broadcast: its size does not depend on the data."""

    def __init__(self, spark: SparkSession, path: str):
        prepare(spark)
        with open(path, "rb") as file:
            data = file.read()
        Codec(data)
        self.digest = hashlib.sha256(data).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def _by_row(self, df: DataFrame, work: Column, keep: tuple[Column, ...], added: dict[str, str], run) -> DataFrame:
        kept = df.select(*keep).drop(*added)
        given = "work"
        while given in kept.columns or given in added:
            given += "_"
        rows = df.select(*keep, work.alias(given)).drop(*added)
        schema = extended(kept.schema, ", ".join(f"`{name}` {kind}" for name, kind in added.items()))
        digest, data = self.digest, self.data

        def apply(batches):
            codec = _codec(digest, data)
            for batch in batches:
                for part, values in run(codec, batch):
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *values], names=schema.names)

        return rows.mapInArrow(apply, schema)

    def encode(self, df: DataFrame, text: str, *keep: Column, name: str = "ids", decoded: str | None = None) -> DataFrame:
        """The columns ``keep`` and the ids of the whole text as an array of integers.

        A null or empty text, and one of white space, has no ids: an empty array. Rows keep their order and number;
        repeated rows and empty tables need no care. A column of ``keep`` called ``name`` is replaced. With ``decoded``
        the text of the ids comes as a further column of that name, as ``decode`` gives it, from the same worker.
        """

        def run(codec, batch):
            for part in by_bytes([batch], batch.num_columns - 1):
                coded = [codec.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield part, [ids, codec.decode(ids).cast(pa.string())] if decoded else [ids]

        added = {name: "array<int>"} | ({decoded: "string"} if decoded else {})
        return self._by_row(df, F.coalesce(F.col(text), F.lit("")), keep, added, run)

    def decode(self, df: DataFrame, ids: str, *keep: Column, name: str = "decoded") -> DataFrame:
        """The columns ``keep`` and the text of the ids: tokens, their word ends included, joined by blanks.

        Null or empty ids decode to an empty text; null ids inside and ids that no token has are an error.
        """

        def run(codec, batch):
            lists = batch.column(batch.num_columns - 1)
            for begin, upto in _portions(pc.list_value_length(lists).to_numpy(zero_copy_only=False), SLICE):
                part = batch.slice(begin, upto - begin)
                yield part, [codec.decode(part.column(part.num_columns - 1)).cast(pa.string())]

        empty = F.array().cast("array<int>")
        return self._by_row(df, F.coalesce(F.col(ids), empty), keep, {name: "string"}, run)
