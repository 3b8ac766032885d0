"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the vocabulary becomes a piece: its bytes are mapped to printable characters and its score is the
negative rank, so that the merge of the best score is the merge of the lowest rank. The model normalises nothing.
Text is cut by a pattern first and each pre-token is encoded on its own; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.common import prepare

#: Distinct words that a worker remembers before it starts afresh.
REMEMBERED = 250_000
#: Characters beyond which a text is cut into pre-tokens piece by piece instead of at once.
LONG_TEXT = 1_000_000
#: White space next to a blank: only here does a match of the pattern depend on what stands beyond the blank.
SPACE_RUN = re.compile(r"  |\s (?:\s|\Z)")
#: A word that may have a blank before it, and no other white space.
ONE_WORD = re.compile(r" ?\S+")
#: Bytes of input that are worked on at a time.
BATCH_BYTES = 2 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()
MAPPED = dict(enumerate(CHARACTERS))


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(MAPPED)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes, an integer, or a float in four bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary; its ids are the ranks, the unknown piece comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, mapped(token).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    shift = starts - (ends - lengths)
    return pool[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes with one vocabulary; a worker keeps one per vocabulary and pattern."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        inverse = {ord(c): b for b, c in enumerate(CHARACTERS)}
        tokens = [self.model.id_to_piece(i).translate(inverse).encode("latin-1") for i in range(self.model.get_piece_size() - 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        # A pre-token that is a token itself is never merged up from bytes.
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.seen: dict[str, bytes] = {}

    def _ids(self, pre_tokens: list[str]) -> list[bytes]:
        data = [t.encode() for t in pre_tokens]
        fresh = list({d for d in data if d not in self.whole})
        merged = {d: struct.pack(f"<{len(ids)}I", *ids) for d, ids in zip(fresh, self.model.encode(list(map(mapped, fresh)), num_threads=1))}
        return [self.whole.get(d) or merged[d] for d in data]

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces of text that are cut into pre-tokens on their own."""
        plain = [p for p in pieces if ONE_WORD.fullmatch(p)]
        # Between such pieces a line feed is a match of its own: one pass of the pattern cuts them all.
        tokens = self.pattern.findall("\n".join(plain))
        for piece in set(pieces).difference(plain):
            plain.append(piece)
            tokens += ["\n"] * bool(tokens)
            tokens += [t if t != "\n" else None for t in self.pattern.findall(piece)]
        names = iter(plain)
        parts: list[bytes] = []
        for token, ids in zip(tokens, self._ids([t or "\n" for t in tokens])):
            if token == "\n":
                self.seen[next(names)] = b"".join(parts)
                parts = []
            else:
                parts.append(ids)
        for piece in names:  # the last one
            self.seen[piece] = b"".join(parts)

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        if fresh := list(set(pieces).difference(self.seen)):
            self._learn(fresh)
        return list(map(self.seen.__getitem__, pieces))

    def _words(self, texts: list[str]) -> list[bytes]:
        """Texts in which every blank stands alone: it opens a match of its own, so " word" is cut alike everywhere."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(cut.flatten())
        words = self._known([" " + w for w in coded.dictionary.to_pylist()])
        # The first word of a text has no blank before it.
        first = [t.partition(" ")[0] for t in texts]
        pieces = words + [b"" if not f else x for f, x in zip(first, self._known([f or " " for f in first]))]
        which = coded.indices.to_numpy().astype(np.int64)
        which[offsets[:-1]] = len(words) + np.arange(len(texts))
        sizes = np.array([len(p) // 4 for p in pieces], np.int64)
        ids = gather(np.frombuffer(b"".join(pieces), "<u4"), (np.cumsum(sizes) - sizes)[which], sizes[which])
        ends = np.append(0, np.cumsum(sizes[which]))[offsets]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def _long(self, text: str) -> bytes:
        """A text of any length, piece by piece."""
        parts = []
        if SPACE_RUN.search(text):
            matches = (m.group() for m in self.pattern.finditer(text))
            while tokens := list(islice(matches, 100_000)):
                parts += self._known(tokens)
            return b"".join(parts)
        begin = 0
        while begin < len(text):
            end = len(text)
            if end - begin > LONG_TEXT:
                blank = text.rfind(" ", begin + 1, begin + LONG_TEXT)
                end = blank if blank > 0 else text.find(" ", begin + 1) if text.find(" ", begin + 1) > 0 else end
            parts += self._words([text[begin:end]])
            begin = end
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT and not SPACE_RUN.search(t)]
        out = dict(zip(plain, self._words([texts[i] for i in plain])))
        return [out[i] if i in out else self._long(t) for i, t in enumerate(texts)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that the ids stand for."""
        out = []
        for x in ids:
            numbers = np.frombuffer(x, "<u4")
            parts = [numbers[i : i + LONG_TEXT] for i in range(0, len(numbers), LONG_TEXT)]
            out.append(b"".join([gather(self.bytes, self.starts[n], self.lengths[n]).tobytes() for n in parts]))
        return out


@lru_cache(maxsize=4)
def _codec(digest: str, pattern: str, load) -> Codec:
    return Codec(load.value, pattern)


def _by_row(df: DataFrame, names: list[str], work: Column, model, digest: str, pattern: str, methods: list[str]) -> DataFrame:
    """``df`` with binary columns: what the codec's methods make of ``work``, each of the one before; columns of their names are replaced."""
    kept = df.drop(*names)
    rows = kept.select("*", work.alias("_codec_input"))
    schema = kept.schema
    for name in names:
        schema = schema.add(name, "binary")

    def apply(batches):
        codec = _codec(digest, pattern, model)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                # Rows of about BATCH_BYTES, one at least.
                upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BATCH_BYTES)))
                part = batch.slice(begin, upto - begin)
                results, columns = part.column(part.num_columns - 1).to_pylist(), []
                for method in methods:
                    results = getattr(codec, method)(results)
                    columns.append(pa.array(results, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)
                begin = upto

    return rows.mapInArrow(apply, schema)


class Vocabulary:
    """A vocabulary file for Spark jobs. The file is read here and its model broadcast: its size is the file's."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        prepare(spark)
        model = serialise(read_ranks(path))
        self.digest, self.pattern = hashlib.sha256(model).hexdigest(), pattern
        self.model = spark.sparkContext.broadcast(model)

    def encode(self, df: DataFrame, text: str = "text", name: str = "ids") -> DataFrame:
        """Adds the ids of the whole text as little-endian unsigned 32-bit integers, row by row.

        A null or empty text has no ids. Rows keep their order, number and other columns; a column called
        ``name`` is replaced. Repeated rows and empty tables need no care.
        """
        return _by_row(df, [name], F.coalesce(F.col(text), F.lit("")), self.model, self.digest, self.pattern, ["encode"])

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Adds the ids of the whole text and the bytes they decode to, in one worker; as ``encode`` and ``decode`` in turn."""
        return _by_row(df, [ids, decoded], F.coalesce(F.col(text), F.lit("")), self.model, self.digest, self.pattern, ["encode", "decode"])

    def decode(self, df: DataFrame, ids: str = "ids", name: str = "decoded") -> DataFrame:
        """Adds the bytes that the ids stand for; null ids decode to no bytes."""
        return _by_row(df, [name], F.coalesce(F.col(ids), F.lit(b"")), self.model, self.digest, self.pattern, ["decode"])
