"""Near-duplicate detection by SimHash with anchor-point covering.

A fingerprint has 64 bits. They are cut into blocks; two fingerprints that differ in at most T bits differ
in at most t = T // blocks bits of some block. The anchors of a block are the words of a covering code: the
direct sum of the Hamming [15,11] code, of covering radius 1, and all words of the block's other bits. Every
fingerprint is replicated to every anchor within covering radius plus t of its block and is at home at the
nearest one. Whatever is within t of a fingerprint is therefore a replica at its home anchor: comparing homes
with replicas per anchor finds every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import by_bytes, cell_pairs, differing, group_starts, merge_labels, prepare, staged, utf8, whole_groups
from jobtide.llm.components import components

SEED = 42
#: Words of a shingle, and bits in which near copies may differ.
WORDS, BITS_APART = 4, 4
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
CODE_LENGTH = 15
#: Rows of one anchor that are compared in one piece; larger anchors are dealt out as a grid of such pieces.
CELL_ROWS = 4096


def _votes(digests: bytes, width: int) -> np.ndarray:
    """How often each bit is set in the digests of ``width`` bytes."""
    data = np.frombuffer(digests, np.uint8).reshape(-1, width).astype(np.int64)
    histogram = np.bincount((data + 256 * np.arange(width)).ravel(), minlength=256 * width)
    return (histogram.reshape(width, 256) @ BITS).ravel()


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """All runs of ``n`` words joined by blanks; a shorter text is one shingle."""
    if len(words) < n:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(n))))


def shingle_simhash(text: bytes, n: int, width: int = 8) -> bytes:
    """Majority bits over the XXH64 values of all word shingles, repeats included; no words give zero.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z. ``width`` beyond 8 bytes adds
    XXH64 under further seeds.
    """
    pieces = shingles(text.lower().split(), n)
    total, count = np.zeros(8 * width, np.int64), 0
    while chunk := list(islice(pieces, 50_000)):
        parts = [b"".join([xxhash.xxh64_digest(s, SEED + k) for s in chunk]) for k in range(width // 8)]
        total += np.concatenate([_votes(p, 8) for p in parts])
        count += len(chunk)
    return np.packbits(2 * total > count).tobytes()


def fingerprints(df: DataFrame, text: str, methods: dict[str, Callable[[bytes], bytes]], *keep: Column) -> DataFrame:
    """The columns ``keep`` and one binary fingerprint per entry of ``methods``, row by row."""
    prepare(df.sparkSession)
    rows = df.select(*keep, utf8(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name in methods:
        schema = schema.add(name, "binary")

    def apply(batches):
        for batch in by_bytes(batches, len(schema) - len(methods)):
            texts = batch.column("_text").to_pylist()
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([f(x) for x in texts], pa.binary()) for f in methods.values()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(apply, schema)


def _blocks(n_blocks: int) -> list[tuple[int, int]]:
    """(shift, bits) of blocks that share the 64 bits as evenly as can be; each holds a Hamming word."""
    base, more = divmod(64, n_blocks)
    if base < CODE_LENGTH:
        raise ValueError(f"at most {64 // CODE_LENGTH} blocks, not {n_blocks}")
    bits = [base + (i < more) for i in range(n_blocks)]
    return [(sum(bits[:i]), b) for i, b in enumerate(bits)]


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit word: the exclusive or of the positions 1 to 15 of its set bits."""
    words = np.arange(1 << CODE_LENGTH)
    syndrome = np.zeros_like(words)
    for i in range(CODE_LENGTH):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    return syndrome


SYNDROMES = _syndromes()


def code_offsets(radius: int) -> list[np.ndarray]:
    """For each syndrome the differences of at most ``radius`` bits that lead to a code word, nearest first."""
    masks = np.array(_masks(CODE_LENGTH, radius))
    return [masks[SYNDROMES[masks] == s] for s in range(CODE_LENGTH + 1)]


def anchors_of(values: np.ndarray, bits: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for all anchors of a block that a word within ``t`` of a value can be at home at."""
    words, rest = values & ((1 << CODE_LENGTH) - 1), values >> CODE_LENGTH
    syndrome = SYNDROMES[words]
    found = []
    for s in range(CODE_LENGTH + 1):
        rows = np.flatnonzero(syndrome == s)
        for flips in range(min(t, bits - CODE_LENGTH) + 1):
            offsets = code_offsets(1 + t - flips)[s]
            for flip in _masks(bits - CODE_LENGTH, flips):
                if bin(flip).count("1") != flips:
                    continue
                anchor = (words[rows, None] ^ offsets[None, :]) | ((rest[rows] ^ flip)[:, None] << CODE_LENGTH)
                home = np.zeros(anchor.shape, bool)
                home[:, 0] = flip == 0
                found.append((np.repeat(rows, len(offsets)), anchor.ravel(), home.ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def replicate(distinct: DataFrame, t: int, n_blocks: int) -> DataFrame:
    """(anchor, home, node, fp) for every anchor of every row of ``distinct`` (node, fp long)."""
    blocks = _blocks(n_blocks)

    def apply(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                fp = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                for k, (shift, bits) in enumerate(blocks):
                    values = (fp.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    rows, anchor, home = anchors_of(values, bits, t)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor | (k << 40)), pa.array(home), *(part.column(c).take(take) for c in ("node", "fp"))],
                        names=["anchor", "home", "node", "fp"],
                    )

    kind = distinct.schema["node"].dataType.simpleString()
    return distinct.select("node", "fp").mapInArrow(apply, f"anchor long, home boolean, node {kind}, fp long")


def link(distinct: DataFrame, threshold: int, n_blocks: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between nodes that connect all rows of ``distinct`` (node, fp long) within ``threshold`` bits.

    A link may pass through others: every anchor gives the spanning forest of its pairs, so that a dense group of k
    fingerprints costs k - 1 rows. ``node`` is a unique long or binary key.
    """
    n = prepare(distinct.sparkSession)
    rows = replicate(distinct, threshold // n_blocks, n_blocks)
    # An anchor with more rows than one piece holds is dealt out: chunk i of homes meets chunk j of replicas.
    crowded = staged(
        rows.groupBy("anchor").count().filter(F.col("count") > cell_rows)
        .select("anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("k")), "anchors"
    )
    c = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    others = F.sequence(F.lit(0), F.col("k") - 1)
    piece = lambda home, i, j: F.struct(home.alias("home"), i.alias("i"), j.alias("j"))
    members = F.transform(others, lambda x: piece(F.lit(False), x, c))
    homes = F.transform(F.when(F.col("home"), others).otherwise(F.array().cast("array<int>")), lambda x: piece(F.lit(True), c, x))
    pieces = F.when(F.col("k").isNull(), F.array(piece(F.col("home"), F.lit(0), F.lit(0)))).otherwise(F.concat(members, homes))
    cells = rows.join(crowded, "anchor", "left").select("anchor", "node", "fp", F.inline(pieces))
    keys = ["anchor", "i", "j"]
    kind = distinct.schema["node"].dataType.simpleString()

    def compare(batches):
        for rows in whole_groups(batches, keys):
            starts = group_starts(rows, keys)
            sizes = np.diff(np.append(starts, rows.num_rows))
            fp, nodes = rows["fp"].to_numpy(), rows["node"].combine_chunks()
            number = nodes.dictionary_encode().indices.to_numpy()
            homes = np.flatnonzero(rows["home"].to_numpy())
            labels = np.arange(rows.num_rows)
            for a, b in cell_pairs(homes, starts, sizes):
                near = (differing(fp[a], fp[b]) <= threshold) & (number[a] != number[b])
                merge_labels(labels, a[near], b[near])
            linked = np.flatnonzero(number[labels] != number)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(labels[linked])), nodes.take(pa.array(linked))], names=["a", "b"])

    return cells.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def as_long(column: str) -> Column:
    """Eight fingerprint bytes as a signed long."""
    high, low = (F.conv(F.substring(F.hex(column), at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = BITS_APART, *keep: Column) -> DataFrame:
    """doc_id, fp (long), component_id, the smallest id reachable through links of ``threshold`` or fewer bits, root and ``keep``.

    One row per row of ``docs``; only the named columns are read. ``root`` is a fingerprint that names the component.
    Null or blank texts have fingerprint zero and are linked like any other. Repeated rows and equal texts share a
    fingerprint and so a component. A null id stays null and never names a component unless all ids of the component
    are null. Ids may be of any type that has an order. An empty table gives no rows.
    """
    rows = fingerprints(docs, text, {"bits": lambda x: shingle_simhash(x, words)}, F.col(doc_id).alias("doc_id"), *keep)
    kept = [c for c in rows.columns if c not in ("doc_id", "bits")]
    prints = staged(rows.select("doc_id", as_long("bits").alias("fp"), *kept), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(link(distinct.select(F.col("fp").alias("node"), "fp"), threshold, 3))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id", "root")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "root", *kept)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = BITS_APART) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, then of the smallest hash of its text.

    Null ids come last. Rows that tie on id and text are alike; one of them stays. All blank texts are one component.
    Columns of any name stay as they are but ``_node``, which is not allowed. An empty table gives no rows.
    """
    key = F.unhex(F.md5(utf8(text)))
    found = simhash_components(docs, doc_id, text, words, threshold, key.alias("_node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_node")).alias("row")
    kept = found.groupBy("root").agg(first).select(F.col("row.doc_id").alias("_id"), F.col("row._node").alias("_kept"))
    whole = docs.withColumn("_node", key)
    joined = whole.join(kept, (F.col("_node") == F.col("_kept")) & F.col(doc_id).eqNullSafe(F.col("_id")))
    nth = F.row_number().over(Window.partitionBy("_node", doc_id).orderBy(F.lit(0)))
    return joined.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)
