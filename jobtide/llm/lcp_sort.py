"""Distributed merge sort of byte strings that knows common prefixes.

Tasks sort their strings into runs and front-code them: of every string only what follows its common prefix with the
one before is kept. Runs are stored in compressed blocks; blocks go to the task of their range, where a loser tree merges the
runs. The tree compares by the lengths of prefixes shared with the last output and looks at bytes beyond them only,
so no known prefix is compared again (LCP loser tree; Bingmann, Eberle and Sanders, 2017).
"""

from __future__ import annotations

import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import prepare

#: Bytes of strings that a task sorts at a time, bytes of a block of a run, and compressed bytes of blocks that meet in one merge.
RUN_BYTES, BLOCK_BYTES, RANGE_BYTES = 12 << 20, 64 << 10, 6 << 20
#: What travels with a string: whether it is known to occur twice, its text (two halves of a 128-bit key; none if
#: nobody asks for it), its place there, the number of starts it stands for, and the place of its anchor.
ENTRY = np.dtype([("twin", "?"), ("asked", "?"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<i8"), ("starts", "<i4"), ("anchor", "<i4")])
BLOCKS = "run string, block int, first binary, last binary, heads binary, entries binary, body binary"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    n = min(len(a), len(b))
    for step in (16, n):
        end = min(n, known + step)
        x, y = a[known:end], b[known:end]
        if x != y:
            return end - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        known = end
    return n


def front_code(run: str, strings: list[bytes], entries: np.ndarray) -> Iterator[tuple]:
    """Blocks of a sorted run; the first string of each block is whole."""
    begin = block = 0
    while begin < len(strings):
        heads, body, size, i = [], [], 0, begin
        while i < len(strings) and size < BLOCK_BYTES:
            shared = common_prefix(strings[i - 1], strings[i]) if i > begin else 0
            heads.append((shared, len(strings[i]) - shared))
            body.append(strings[i][shared:])
            size += len(body[-1]) + ENTRY.itemsize
            i += 1
        yield run, block, strings[begin], strings[i - 1], np.array(heads, "<i4").tobytes(), zstandard.compress(entries[begin:i].tobytes(), 1), zstandard.compress(b"".join(body), 1)
        begin, block = i, block + 1


def decode(heads: bytes, entries: bytes, body: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(shared prefix, string, entry) of a block."""
    last, at, body = b"", 0, zstandard.decompress(body)
    for (shared, rest), entry in zip(np.frombuffer(heads, "<i4").reshape(-1, 2).tolist(), np.frombuffer(zstandard.decompress(entries), ENTRY).tolist()):
        last = last[:shared] + body[at : at + rest]
        at += rest
        yield shared, last, entry


def _in_range(blocks: list[tuple], low: bytes | None, high: bytes | None) -> Iterator[tuple[int, bytes, tuple]]:
    """The strings of a run's blocks within [low, high), with the prefix shared with the one before."""
    last = None
    for heads, entries, body in blocks:
        whole = True
        for shared, string, entry in decode(heads, entries, body):
            if high is not None and string >= high:
                return
            if low is None or string >= low:
                if whole:
                    shared = common_prefix(last, string) if last is not None else 0
                yield shared, string, entry
            last, whole = string, False


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Strings of all runs in order, each with the prefix it shares with the string before."""
    heads = [next(r, None) for r in runs]
    width = 1 << max(0, (len(runs) - 1).bit_length())
    strings = [h[1] if h else None for h in heads] + [None] * (width - len(runs))
    payload = [h[2] if h else None for h in heads]
    # Prefix shared with the last output; -1 marks a run that is over, which loses to all others.
    shared = [0 if s is not None else -1 for s in strings]

    def loses(a: int, b: int) -> bool:
        """Whether a loses to b; the loser's prefix becomes the one shared with the winner."""
        if shared[a] != shared[b]:
            return shared[a] < shared[b]
        if shared[a] < 0:
            return True
        x, y = strings[a], strings[b]
        both = common_prefix(x, y, shared[a])
        lost = x[both : both + 1] > y[both : both + 1]
        shared[a if lost else b] = both
        return lost

    losers, level = [0] * width, list(range(width))
    for size in (width >> k for k in range(1, width.bit_length())):
        winners = []
        for i in range(size):
            a, b = level[2 * i], level[2 * i + 1]
            lost = loses(a, b)
            losers[size + i] = a if lost else b
            winners.append(b if lost else a)
        level = winners
    top = level[0] if level else 0
    while runs and shared[top] >= 0:
        yield shared[top], strings[top], payload[top]
        following = next(runs[top], None)
        if following is None:
            shared[top], strings[top] = -1, None
        else:
            shared[top], strings[top], payload[top] = following
        node = (width + top) >> 1
        while node:
            if loses(top, losers[node]):
                top, losers[node] = losers[node], top
            node >>= 1


def make_runs(units: Iterator[tuple[list[bytes], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of (strings, entries); equal strings of a run are one, asked for in rows of their own.

    A string that a run has twice is known to occur twice: those who ask get the answer at once, as a row without
    string (block -1), and only a witness stays in the run.
    """
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]

    def flush():
        order = sorted(range(len(strings)), key=strings.__getitem__)
        entries = np.concatenate(parts)[order]
        ordered = [strings[i] for i in order]
        same = np.array([a == b for a, b in zip(ordered, ordered[1:])], bool)
        first = np.concatenate([[True], ~same])
        twice = np.concatenate([same, [False]]) | ~first
        entries["twin"] |= twice
        answered = entries[twice & entries["asked"]]
        entries["asked"] &= ~twice
        kept = np.flatnonzero(first)
        rows = list(front_code(uuid.uuid4().hex, [ordered[i] for i in kept], entries[kept]))
        rows += [("", -1, b"", b"", b"", answered.tobytes(), b"")] if len(answered) else []
        for i in range(0, len(rows), 100):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 100]), kinds)], names=names)

    strings, parts, size = [], [], 0
    for own, entries in units:
        strings += own
        parts.append(entries)
        size += sum(map(len, own)) + 100 * len(own)
        if size > RUN_BYTES:
            yield from flush()
            strings, parts, size = [], [], 0
    if strings:
        yield from flush()


def shortest_borders(heads: list[bytes], parts: int) -> list[bytes]:
    """Borders that cut sorted strings into about ``parts``, each only as long as it takes to tell it from the string before."""
    distinct = sorted(set(heads))
    place = {head: i for i, head in enumerate(distinct)}
    wanted = {place[heads[len(heads) * i // parts]] for i in range(1, parts)} if heads else set()
    return [distinct[i][: common_prefix(distinct[i - 1], distinct[i]) + 1] for i in sorted(wanted) if i]


def _ranges_of(borders: list[bytes], first: bytes, last: bytes) -> range:
    return range(bisect_right(borders, first), bisect_right(borders, last) + 1)


def _parts(row: dict, borders: list[bytes]) -> Iterator[tuple[int, list[bytes], list[tuple]]]:
    """(range, strings, entries) of a block that spans several ranges."""
    k, strings, entries = None, [], []
    for _, string, entry in decode(row["heads"], row["entries"], row["body"]):
        own = bisect_right(borders, string)
        if own != k and strings:
            yield k, strings, entries
            strings, entries = [], []
        k = own
        strings.append(string)
        entries.append(entry)
    if strings:
        yield k, strings, entries


def _measured(stored: DataFrame, borders: list[bytes]) -> dict[int, int]:
    """Bytes of each range; the strings of a block that spans several ones share its bytes by their number."""

    def apply(batches):
        total: dict[int, float] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size, over = len(row["body"]) + len(row["entries"]), _ranges_of(borders, row["first"], row["last"])
                if len(over) == 1:
                    total[over[0]] = total.get(over[0], 0) + size
                else:
                    for k, strings, _ in _parts(row, borders):
                        total[k] = total.get(k, 0) + size * len(strings) / (len(row["heads"]) / 8)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(map(int, total.values()), pa.int64())], names=["range", "size"])

    return {r["range"]: r["size"] for r in stored.mapInArrow(apply, "range int, size long").groupBy("range").agg(F.sum("size").alias("size")).collect()}


def _samples(stored: DataFrame, borders: list[bytes], rates: dict[int, float]) -> dict[int, list[bytes]]:
    """Sorted strings drawn from some ranges, by a rate per byte of stored block."""

    def apply(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                over = _ranges_of(borders, row["first"], row["last"])
                if any(k in rates for k in over):
                    each = (len(row["body"]) + len(row["entries"])) / (len(row["heads"]) / 8)
                    for k, strings, _ in _parts(row, borders):
                        if k in rates:
                            drawn = np.random.default_rng(zlib.crc32(f"{row['run']} {row['block']} {k}".encode())).random(len(strings)) < rates[k] * each
                            found += [(k, strings[i]) for i in np.flatnonzero(drawn)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary()))], names=["range", "string"])

    found: dict[int, list[bytes]] = {}
    for r in stored.mapInArrow(apply, "range int, string binary").collect():
        found.setdefault(r["range"], []).append(bytes(r["string"]))
    return {k: sorted(v) for k, v in found.items()}


def place_borders(stored: DataFrame, least: int) -> list[bytes]:
    """Borders of ranges of about RANGE_BYTES; only equal strings can make a range larger than twice that.

    Ranges that measure more are split again until no sample of one yields another border.
    """
    total = stored.agg(F.sum(F.length("body") + F.length("entries")), F.count("*")).first()
    ranges = max(least, math.ceil((total[0] or 0) / RANGE_BYTES))
    # About 40 block heads a range place the first borders.
    sampled = stored.filter(F.rand(7) < min(1.0, 40 * ranges / max(total[1], 1))).select("first")
    borders = shortest_borders(sorted(bytes(r["first"]) for r in sampled.collect()), ranges)
    while True:
        large = {k: size for k, size in _measured(stored, borders).items() if size > 2 * RANGE_BYTES}
        # Again about 40 strings for each range that is to be.
        samples = _samples(stored, borders, {k: 40 / RANGE_BYTES for k in large}) if large else {}
        new = {b for k, size in large.items() for b in shortest_borders(samples.get(k, []), math.ceil(size / RANGE_BYTES))} - set(borders)
        if not new:
            return borders
        borders = sorted({*borders, *new})


def merge_ranges(blocks: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """Merge stored runs range by range; ``answer`` turns each merged sequence into record batches of ``schema``.

    Ranges hold about RANGE_BYTES of front-coded strings. Their borders, one for so many bytes, are broadcast. A block
    that spans several ranges is cut at their borders, so that a task reads what belongs to its ranges and no more.
    """
    spark = blocks.sparkSession
    n = prepare(spark)
    stored = blocks.filter("block >= 0")
    shared = spark.sparkContext.broadcast(place_borders(stored, n))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
    names = ["range", "run", "block", "part", "heads", "entries", "body"]

    def deal(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                out: list[tuple] = []
                for row in batch.slice(begin, 100).to_pylist():
                    over = _ranges_of(shared.value, row["first"], row["last"])
                    if len(over) == 1:
                        out.append((over[0], row["run"], row["block"], 0, row["heads"], row["entries"], row["body"]))
                        continue
                    for k, strings, entries in _parts(row, shared.value):
                        for part, coded in enumerate(front_code(row["run"], strings, np.array(entries, ENTRY))):
                            out.append((k, row["run"], row["block"], part, *coded[4:]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    def merged(batches):
        for runs in _whole_ranges(batches):
            yield from answer(merge([_in_range(b, None, None) for b in runs]))

    dealt = stored.mapInArrow(deal, "range int, run string, block int, part int, heads binary, entries binary, body binary")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "run", "block", "part").mapInArrow(merged, schema)


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """The compressed blocks of each range by run, out of rows sorted by range, run and block; one range is held at a time."""
    last, runs = None, {}
    for batch in batches:
        for begin in range(0, batch.num_rows, 100):
            for row in batch.slice(begin, 100).to_pylist():
                if row["range"] != last and runs:
                    yield list(runs.values())
                    runs = {}
                last = row["range"]
                runs.setdefault(row["run"], []).append((row["heads"], row["entries"], row["body"]))
    if runs:
        yield list(runs.values())
