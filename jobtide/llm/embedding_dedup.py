"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Principal directions of a bounded sample are rotated until the signs of the projections keep as much of the vectors
as they can (Gong and Lazebnik, 2011). The signs are a code of up to 64 bits, cut into substrings, one table for
each. Vectors that share a bucket of a table are candidates if their codes are within a radius; they are reranked by
the cosine of the original vectors.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import cell_pairs, differing, group_starts, merge_labels, prepare, staged, whole_groups
from jobtide.llm.components import components

COSINE = 0.93
#: Substrings of a code, and the radius of codes within a bucket beyond which vectors are not reranked.
TABLES, RADIUS = 8, 20
#: Distinct vectors that the rotation is learned from, at most about, and its iterations.
SAMPLE, ROUNDS, SEED = 20_000, 50, 11
#: Rows of one bucket that are compared in one piece; larger buckets are dealt out as a grid of such pieces.
CELL_ROWS = 2048
BITS = 64


def unit_length(vector: np.ndarray) -> np.ndarray:
    scaled = vector / np.abs(vector).max()  # keeps the squares in range
    return scaled / np.sqrt(scaled @ scaled)


def quantiser(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the code of a vector is the signs of (vector - mean) @ directions."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(bits, sample.shape[1])
    _, vectors = np.linalg.eigh(centred.T @ centred)
    principal = vectors[:, ::-1][:, :bits]
    projected = centred @ principal
    rotation, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    return mean, principal @ rotation


def codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as signed longs."""
    signs = (vectors - model[0]) @ model[1] >= 0
    padded = np.zeros((len(vectors), BITS), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<i8").ravel()


def substrings(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables): the value of each substring of the codes."""
    at = [bits * k // tables for k in range(tables + 1)]
    unsigned = code.view(np.uint64)
    return np.stack([(unsigned >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(at, at[1:])], axis=1).astype(np.int64)


def _rows(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, vector (doubles as bytes) and node, a 128-bit key of label and vector; both null if it can link with nothing."""
    picked = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e"))

    def apply(batches):
        for batch in batches:
            nodes, data = [], []
            for name, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = None if name is None or not values or None in values else np.array(values)
                if row is None or not np.isfinite(row).all() or not row.any():
                    nodes.append(None)
                    data.append(None)
                else:
                    data.append(row.tobytes())
                    nodes.append(hashlib.md5(name.encode() + b"\0" + data[-1], usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(nodes, pa.binary())], names=["vec_id", "label", "vector", "node"]
            )

    return picked.mapInArrow(apply, f"vec_id {picked.schema['vec_id'].dataType.simpleString()}, label string, vector binary, node binary")


def fit(distinct: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A quantiser for each dimension of the sample, drawn by a hash of the vectors; about ``sample`` rows at most."""
    n = distinct.count()
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    drawn = distinct.filter(draw < min(1.0, sample / max(n, 1))).select("vector").collect()
    by_size: dict[int, list] = {}
    for row in sorted(bytes(r["vector"]) for r in drawn):
        by_size.setdefault(len(row) // 8, []).append(unit_length(np.frombuffer(row)))
    return {size: quantiser(np.stack(rows)) for size, rows in by_size.items()}


def place(distinct: DataFrame, models: dict, tables: int) -> DataFrame:
    """(bucket, node, code, vector, rows) for every table: the index over all distinct vectors."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def apply(batches):
        for batch in batches:
            labels, nodes, vectors, counts = (c.to_pylist() for c in batch.columns)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v) // 8, []).append(i)
            for size, rows in by_size.items():
                # A dimension that the sample lacks gets signs of its first components.
                model = shared.value.get(size) or (np.zeros(size), np.eye(size)[:, :BITS])
                matrix = np.stack([unit_length(np.frombuffer(vectors[i])) for i in rows])
                code = codes(matrix, model)
                keys = substrings(code, min(size, BITS), tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{labels[i]}|{size}|{t}|{k}" for i, k in zip(rows, keys[:, t].tolist())]), pa.array([t] * len(rows), pa.int32()),
                            pa.array([nodes[i] for i in rows], pa.binary()), pa.array(code), pa.array([vectors[i] for i in rows], pa.binary()),
                            pa.array([counts[i] for i in rows], pa.int64()),
                        ],
                        names=["bucket", "t", "node", "code", "vector", "rows"],
                    )

    return distinct.select("label", "node", "vector", "rows").mapInArrow(
        apply, "bucket string, t int, node binary, code long, vector binary, rows long"
    )


def link(distinct: DataFrame, models: dict, tables: int, cosine: float, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (node, other, links): links to add to a node's count, and (node, other) spanning the pairs found.

    A pair is counted in the first table in which both share a bucket. Every piece of a bucket gives sums and a
    spanning forest of its pairs, never the pairs themselves.
    """
    n = prepare(distinct.sparkSession)
    rows = place(distinct, models, tables)
    crowded = staged(
        rows.groupBy("bucket").count().filter(F.col("count") > cell_rows)
        .select("bucket", F.ceil(F.col("count") / cell_rows).cast("int").alias("k")), "buckets"
    )
    # Chunk c of a crowded bucket is compared with every chunk: as home in cells (c, x), as member in cells (x, c).
    c = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    others = F.sequence(F.lit(0), F.col("k") - 1)
    piece = lambda home, i, j: F.struct(home.alias("home"), i.alias("i"), j.alias("j"))
    dealt = F.concat(F.transform(others, lambda x: piece(F.lit(True), c, x)), F.transform(others, lambda x: piece(F.lit(False), x, c)))
    # Without chunks every row is home and member at once.
    pieces = F.when(F.col("k").isNull(), F.array(piece(F.lit(None).cast("boolean"), F.lit(0), F.lit(0)))).otherwise(dealt)
    cells = rows.join(crowded, "bucket", "left").select("bucket", "t", "node", "code", "vector", "rows", F.inline(pieces))
    keys = ["bucket", "i", "j"]

    def compare(batches):
        for rows in whole_groups(batches, keys, 4000):
            starts = group_starts(rows, keys)
            sizes = np.diff(np.append(starts, rows.num_rows))
            code, count, table = (rows[c].to_numpy() for c in ("code", "rows", "t"))
            nodes = rows["node"].to_pylist()
            home = rows["home"].to_pylist()
            is_home = np.array([h is not False for h in home])
            is_member = np.array([h is not True for h in home])
            vectors = [np.frombuffer(v) for v in rows["vector"].to_pylist()]
            size = np.array([len(v) for v in vectors])
            unit = np.zeros((len(vectors), size.max()))
            for i, v in enumerate(vectors):
                unit[i, : len(v)] = unit_length(v)
            parts = np.zeros((len(vectors), tables), np.int64)
            for s in np.unique(size):
                parts[size == s] = substrings(code[size == s], min(s, BITS), tables)
            labels, links = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            index = {x: i for i, x in enumerate(dict.fromkeys(nodes))}
            number = np.array([index[x] for x in nodes])
            for a, b in cell_pairs(np.flatnonzero(is_home), starts, sizes, 500_000):
                near = is_member[b] & (number[a] != number[b]) & (differing(code[a], code[b]) <= radius)
                a, b = a[near], b[near]
                first = (parts[a] == parts[b]).argmax(axis=1) == table[a]
                a, b = a[first], b[first]
                for k in range(0, len(a), 20_000):
                    x, y = a[k : k + 20_000], b[k : k + 20_000]
                    close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    x, y = x[close], y[close]
                    np.add.at(links, x, count[y])
                    merge_labels(labels, x, y)
            changed = np.flatnonzero(links)
            joined = np.flatnonzero(number[labels] != number)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes[i] for i in changed] + [nodes[i] for i in joined], pa.binary()),
                    pa.array([None] * len(changed) + [nodes[labels[i]] for i in joined], pa.binary()), pa.array(np.append(links[changed], [0] * len(joined)), pa.int64()),
                ],
                names=["node", "other", "links"],
            )

    return cells.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "node binary, other binary, links long")


def embedding_components(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES, radius: int = RADIUS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``; other columns are not read.

    Rows link if their labels are equal and the cosine of their vectors, in doubles, is ``cosine`` or more. Rows with
    a null label or a vector that is null, empty, zero or holds nulls or non-finite numbers link with nothing and
    are kept. Rows with equal label and vector are linked, repeated rows among them; ids that tie as the smallest of
    a component are all kept. A null id is counted by others, names no component while another id can, and is not kept.
    """
    prepare(vectors.sparkSession)
    rows = staged(_rows(vectors, vec_id, embedding, label), "vectors")
    distinct = staged(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("rows")), "distinct"
    )
    found = staged(link(distinct, fit(distinct), tables, cosine, radius), "links")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = staged(
        distinct.select("node", "first_id", "rows").join(roots, "node", "left").join(counts, "node", "left")
        .select("node", "first_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "named"
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(smallest, "root").select("node", "n_links", "component_id")
    joined = rows.select("vec_id", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
