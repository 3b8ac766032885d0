"""Removal of repeated passages by sorting suffixes.

A byte goes if it lies in a string of ``length`` bytes (a window) that starts at another place as well. Sorting every
suffix would cost hundreds of bytes of shuffle for each byte of text. Equal windows have equal insides, though, so
windows are sorted by content-defined runs:

1. The sparse anchor of a window is the smallest hash of its first three quarters; the bytes from there on, a
   quarter of a window, are its core. A window whose core is found once only can't repeat. Cores are counted as hashes: this only picks
   candidates.
2. Candidate windows with the same dense anchor (smallest hash of a short stretch) are one unit: the suffix at its
   first window, cut where its last window ends. Units are sorted by ``lcp_sort``. A unit that is a prefix of the
   next suffix, or equal to one, repeats with all its windows: this settles the insides of repeated passages.
3. What is left lies at the ends of passages. Its windows are sorted one by one, each against those of all units
   with the same dense core; the core, known to be common, is replaced by its 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import by_bytes, discard, extended, prepare, staged, utf8
from jobtide.llm.lcp_sort import BLOCKS, ENTRY, make_runs, merge_ranges

LENGTH = 400
#: Bytes whose hash orders positions, and bytes of text worked on at a time.
GRAM, CHUNK = 16, 1 << 19
POSITION = (1 << 24) - 1
#: Units whose windows are spelled out at a time, and answers that are put into one batch.
UNIT_ROWS, ANSWER_ROWS = 500, 10_000
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
REPEATED = "k1 long, k2 long, at long, starts int"
#: A unit at a passage's end: its dense core, what stands before and after it, and whether its windows are in question.
UNITS = REPEATED + ", core binary, before binary, after binary, asked boolean"


def dense_stretch(length: int) -> int:
    return max(1, length // 6)


def core_bytes(length: int) -> int:
    """Bytes of a sparse core; its anchor is the least position of the rest of the window."""
    return max(GRAM, length // 4)


def text_key(data: bytes) -> tuple[int, int]:
    digest = hashlib.md5(data, usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)


def _ordered(data: np.ndarray) -> np.ndarray:
    """A value for every position: a hash of its GRAM bytes, the position in the low bits so that the first of equals is least."""
    value = (data.astype(np.uint64) + np.uint64(1)) * MIX
    value ^= value >> np.uint64(29)
    factor, size = ROLL, 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            longer = value * factor
            longer[:-size] += value[size:]
            value, size, factor = longer, 2 * size, factor * factor
        value ^= value >> np.uint64(32)
        value *= MIX
    return value & ~np.uint64(POSITION) | np.arange(len(data), dtype=np.uint64)


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value among ``width`` positions, from each position on."""
    size = 1
    while 2 * size <= width:
        value = np.minimum(value[:-size], value[size:]) if len(value) > size else value[:0]
        size *= 2
    if size < width:
        value = np.minimum(value[: size - width], value[width - size :]) if len(value) > width - size else value[:0]
    return (value & np.uint64(POSITION)).astype(np.int64)


def _pieces(texts: list[bytes], length: int, chunk: int) -> Iterator[tuple[np.ndarray, bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of several texts or of a part of a long one, with (text, place in the text, begin, number of windows)."""
    parts, places, size = [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - length + 1), chunk):
            part = text[begin : begin + chunk + length - 1]
            if size + len(part) > chunk + length and parts:
                data = b"".join(parts)
                yield np.frombuffer(data, np.uint8), data, places
                parts, places, size = [], [], 0
            places.append((i, begin, size, len(part) - length + 1))
            parts.append(part)
            size += len(part)
    if parts:
        data = b"".join(parts)
        yield np.frombuffer(data, np.uint8), data, places


def _sparse(value: np.ndarray, data: bytes, places: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a buffer: where they start; for each text's anchors the hash of the core, the first window and the place in the buffer."""
    half = length - core_bytes(length)
    least = _least(value, half)
    starts = np.concatenate([np.arange(b, b + n) for _, _, b, n in places])
    anchor = least[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    view = memoryview(data)
    hashes = [xxhash.xxh64_intdigest(view[a : a + length - half]) for a in anchor[first].tolist()]
    return starts, np.array(hashes, np.uint64).view(np.int64), first, anchor[first]


def _arrow(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


def cores(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, core, at, twice) for the sparse cores of every text; twice if a piece of the text has the core at two anchors.

    ``at`` is where the anchor lies in a text of several pieces, and 0 in others. Pieces overlap, so that the same anchor
    may come from two of them; anchors at different places are a repeat.
    """
    chunk = CHUNK

    def apply(batches):
        for batch in by_bytes(batches, 0):
            own = batch.column(0).to_pylist()
            keys = [text_key(t) for t in own]
            for array, data, places in _pieces(own, length, chunk):
                starts, hashes, first, anchors = _sparse(_ordered(array), data, places, length)
                text, shift = (np.repeat(x, [p[3] for p in places])[first] for x in ([p[0] for p in places], [p[1] - p[2] for p in places]))
                several = np.array([len(own[p[0]]) - length >= chunk for p in places])
                at = np.where(np.repeat(several, [p[3] for p in places])[first], anchors + shift, 0)
                order = np.lexsort((hashes, text))
                same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
                keep, twice = np.concatenate([[True], ~same]), np.concatenate([same, [False]])
                pick = order[keep]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.array([keys[i][h] for i in text[pick]], np.int64)) for h in (0, 1)), pa.array(hashes[pick]), pa.array(at[pick]), pa.array(twice[keep])],
                    names=["k1", "k2", "core", "at", "twice"],
                )

    return texts.mapInArrow(apply, "k1 long, k2 long, core long, at long, twice boolean")


def _units(batches, length: int, chunk: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Units of candidate windows, out of rows of text, number of copies and repeated cores."""
    stretch = dense_stretch(length)
    for batch in by_bytes(batches, 0):
        own, copies, repeated = (batch.column(i).to_pylist() for i in range(3))
        keys = [text_key(t) for t in own]
        wanted = [np.sort(np.array(r, np.int64)) for r in repeated]
        for array, data, places in _pieces(own, length, chunk):
            value = _ordered(array)
            starts, hashes, first, _ = _sparse(value, data, places, length)
            group = np.cumsum(first) - 1
            text = np.repeat([p[0] for p in places], [p[3] for p in places])
            known = np.zeros(len(hashes), bool)
            owner = text[first]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(owner)]):
                known[lo:hi] = np.isin(hashes[lo:hi], wanted[owner[lo]])
            shift = np.repeat([p[1] - p[2] for p in places], [p[3] for p in places])
            pick = known[group]
            starts, text, shift = starts[pick], text[pick], shift[pick]
            if not len(starts):
                continue
            anchor = _least(value, stretch)[starts]
            begin = np.ones(len(starts), bool)
            begin[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
            at = np.flatnonzero(begin)
            counts = np.diff(np.append(at, len(starts)))
            entries = np.zeros(len(at), ENTRY)
            entries["k1"], entries["k2"] = np.array(keys, np.int64)[text[at]].T
            entries["at"], entries["starts"], entries["anchor"] = starts[at] + shift[at], counts, anchor[at] - starts[at]
            # A text that is there twice repeats as a whole: its units are witnesses only.
            entries["twin"] = np.array(copies)[text[at]] > 1
            entries["asked"] = ~entries["twin"]
            lows, highs = starts[at].tolist(), (starts[at] + counts + length - 1).tolist()
            for i in range(0, len(at), 20_000):
                yield [data[a:b] for a, b in zip(lows[i : i + 20_000], highs[i : i + 20_000])], entries[i : i + 20_000]


def _windows(batches, length: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The windows of units at passage ends, their core replaced by its hash."""
    core_size = length - dense_stretch(length)
    for batch in batches:
        for begin in range(0, batch.num_rows, UNIT_ROWS):
            strings, entries = [], []
            for row in batch.slice(begin, UNIT_ROWS).to_pylist():
                before, after, n = row["before"], row["after"], len(row["before"])
                for j in range(row["starts"]):
                    strings.append(row["core"] + bytes([min(n - j, 255), (n - j) >> 8]) + before[j:] + after[: j + length - n - core_size])
                    entries.append((not row["asked"], row["asked"], row["k1"], row["k2"], row["at"] + j, 1, 0))
            yield strings, np.array(entries, ENTRY)


def _judged(merged: Iterator) -> Iterator[tuple[bytes, tuple, bool]]:
    """(string, entry, repeated) of a merged sequence: a string repeats if the next one begins with it or the last one equals it."""
    string = entry = None
    equal = False
    for shared, following, other in merged:
        if string is not None:
            yield string, entry, equal or shared >= len(string)
            equal = shared == len(string) == len(following)
        string, entry = following, other
    if string is not None:
        yield string, entry, equal


def settle_units(length: int):
    """Answers of the first sort: repeated units, and all distinct units as witnesses or in question."""
    core_size = length - dense_stretch(length)
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "at": pa.int64(), "starts": pa.int32(), "core": pa.binary(), "before": pa.binary(), "after": pa.binary(), "asked": pa.bool_()}

    def answer(merged):
        rows: list[tuple] = []
        for string, (twin, asked, k1, k2, at, starts, anchor), again in _judged(merged):
            settled = twin or again
            if asked and settled:
                rows.append((k1, k2, at, starts, None, None, None, False))
            core = xxhash.xxh3_128_digest(string[anchor : anchor + core_size])
            rows.append((k1, k2, at, starts, core, string[:anchor], string[anchor + core_size :], asked and not settled))
            if len(rows) >= ANSWER_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))

    return answer


def settle_windows(merged) -> Iterator[pa.RecordBatch]:
    """Answers of the second sort: repeated windows."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    repeated = ((k1, k2, at, starts) for _, (twin, asked, k1, k2, at, starts, _), again in _judged(merged) if asked and (twin or again))
    while found := list(islice(repeated, ANSWER_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["k1", "k2", "at", "starts"])


def _answered(blocks: DataFrame) -> DataFrame:
    """What runs could tell by themselves."""

    def apply(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                e = np.frombuffer(data, ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(e[c]) for c in ("k1", "k2", "at", "starts")], names=["k1", "k2", "at", "starts"])

    return blocks.filter("block < 0").select("entries").mapInArrow(apply, REPEATED)


def key_of(text: str) -> dict[str, Column]:
    """The halves k1 and k2 of a text's 128-bit key."""
    part = lambda at: F.conv(F.substring(F.md5(utf8(text)), at, 8), 16, 10).cast("long")
    half = lambda at: F.shiftleft(part(at), 32).bitwiseOR(part(at + 8))
    return {"k1": half(1), "k2": half(17)}


def keyed(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The columns ``keep``, the text's bytes as ``data`` and its 128-bit key."""
    return docs.select(*keep, utf8(text).alias("data"), *[c.alias(n) for n, c in key_of(text).items()])


def repeated_windows(docs: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """(k1, k2, runs, copies) for texts with repeated windows: runs of starts (at, starts), and rows that have the text."""
    if length < 2 * GRAM:
        raise ValueError(f"windows of {2 * GRAM} bytes at least, not {length}")
    prepare(docs.sparkSession)
    long_enough = keyed(docs, text).filter(F.length("data") >= length)
    found = staged(cores(long_enough.select("data"), length), "cores")
    unlike = (F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2")) | F.max("twice") | (F.min("at") != F.max("at"))
    again = found.groupBy("core").agg(unlike.alias("again")).filter("again").select("core")
    candidates = found.join(again, "core").groupBy("k1", "k2").agg(F.collect_set("core").alias("cores"))
    # One row for each distinct text.
    texts = long_enough.groupBy("k1", "k2").agg(F.first("data").alias("data"), F.count("*").cast("int").alias("copies"))
    rows = texts.join(candidates, ["k1", "k2"]).select("data", "copies", "cores")
    chunk = CHUNK
    units = staged(rows.mapInArrow(lambda batches: make_runs(_units(batches, length, chunk)), BLOCKS), "runs")
    discard(found)
    settled = staged(merge_ranges(units, settle_units(length), UNITS), "units")
    witnesses = settled.filter("core IS NOT NULL")
    open_cores = witnesses.groupBy("core").agg(F.count("*").alias("n"), F.max("asked").alias("open")).filter("open AND n > 1").select("core")
    ends = staged(witnesses.join(open_cores, "core").select(settled.columns).mapInArrow(lambda batches: make_runs(_windows(batches, length)), BLOCKS), "runs")
    columns = ["k1", "k2", "at", "starts"]
    repeated = (
        settled.filter("core IS NULL").select(columns).union(_answered(units)).union(_answered(ends))
        .union(merge_ranges(ends, settle_windows, REPEATED))
    )
    per_text = repeated.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "starts")).alias("runs"))
    multiple = long_enough.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1")
    repeats = staged(per_text.join(multiple, ["k1", "k2"], "full"), "repeats")
    for finished in (units, settled, ends):
        discard(finished)
    return repeats


def covered(runs: list[dict], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows; ``runs`` of starts in any order."""
    spans: list[list[int]] = []
    for at, n in sorted((r["at"], r["starts"]) for r in runs):
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + n + length - 1)
        else:
            spans.append([at, at + n + length - 1])
    return [(a, min(b, size)) for a, b in spans]


def _cut(data: list[bytes], runs: list, copies: list, length: int) -> tuple[list[list[tuple[int, int]]], list[bytes]]:
    """Spans to remove, and the bytes that stay, of each text."""
    spans = [[(0, len(d))] if c and len(d) >= length else covered(r or [], len(d), length) for d, r, c in zip(data, runs, copies)]
    kept = [b"".join([d[a:b] for a, b in zip([0, *(e for _, e in s)], [*(a for a, _ in s), len(d)])]) for d, s in zip(data, spans)]
    return spans, kept


def cut_passages(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text column; all else as it was.

    Rows without a repeat stay in the JVM and keep their text, null or not, as it is; only the others pass through
    Python, a few at a time. Characters that lose some of their bytes go; a text that repeats as a whole becomes empty.
    Columns of any name may be there; a text column of another name is given by ``text``. No rows give no rows.
    """
    found = repeated_windows(docs, text, length)
    names = docs.columns
    key = [F.col(k).alias(f"_{k}") for k in ("k1", "k2")]
    keyed_docs = docs.select("*", *[c.alias(f"_{n}") for n, c in key_of(text).items()])
    at = names.index(text)

    def apply(batches):
        for batch in by_bytes(batches, at):
            data = [t.encode() for t in batch.column(at).to_pylist()]
            runs, copies = (batch.column(i).to_pylist() for i in (len(names), len(names) + 1))
            _, kept = _cut(data, runs, copies, length)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = found.select(*key, F.col("runs").alias("_runs"), F.col("copies").alias("_copies"))
    touched = keyed_docs.join(spans, ["_k1", "_k2"]).select(*names, "_runs", "_copies")
    whole = keyed_docs.join(spans.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select(*names)
    return whole.union(touched.mapInArrow(apply, docs.schema))


def remove_repeats(docs: DataFrame, text: str, *keep: Column, length: int = LENGTH) -> DataFrame:
    """The columns ``keep``, n_bytes, spans (start, end), kept (the remaining bytes) and kept_text, row by row.

    Every byte of a string of ``length`` bytes that starts at another place of any row goes. Null texts are empty;
    texts shorter than ``length`` keep everything; rows with equal texts of at least ``length`` bytes keep nothing,
    whether their ids differ or not. kept_text leaves out characters that lost some of their bytes. An empty table gives no rows.
    """
    found = repeated_windows(docs, text, length)
    rows = keyed(docs, text, *keep)
    names = [c for c in rows.columns if c not in ("data", "k1", "k2")]
    joined = rows.join(found, ["k1", "k2"], "left").select(*names, "data", "runs", "copies")
    schema = extended(joined.select(*names).schema, "n_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_text string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for part in by_bytes(batches, len(names)):
            data, runs, copies = (part.column(i).to_pylist() for i in range(len(names), len(names) + 3))
            spans, kept = _cut(data, runs, copies, length)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(names)], pa.array(map(len, data), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept])],
                names=schema.names,
            )

    return joined.mapInArrow(apply, schema)
