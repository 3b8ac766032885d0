"""Merkle manifest of a dataset as a persistent tree with path copying.

Every row is a leaf of its tree; every eight consecutive nodes are hashed into their parent until one is left, the
tree's subroot. The subroots, ordered by tree, are hashed in the same way into the root.

Trees are worked on in aligned blocks of 4096 consecutive nodes, four levels high: a block is what one task holds.
The roots of the blocks are the leaves of the next tier, so a tree of any size takes a few tiers, each a
thousandth of the one below it. An edited leaf opens a version of the tree: within its block only its ancestors
are copied and all untouched nodes are shared; above the block the version goes on along the path that the upper
tiers have handed down to it. Nodes and copies are tables, from which each version can be read.

A tree key of null is a tree of its own and comes first. Inside a tree leaves ascend by the order column (null
first), those of equal order by their digest. Without rows there are no nodes and the root is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import group_starts, prepare, staged, whole_groups
from jobtide.llm.ranks import ranked

ARITY = 8
#: Levels that a block spans; a block starts with ARITY ** TIER nodes.
TIER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, level int, pos long, n long, digest string"
STEPS = "array<struct<before: string, behind: string>>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: every column as its byte count, a colon and its text, null as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels_of(digests: list[str], n: int, most: int) -> list[list[str]]:
    """The nodes of one block, level by level. ``n`` is the number of nodes that the whole tree has on the lowest one."""
    levels = [digests]
    while n > 1 and len(levels) <= most:
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """What stands before and behind the ancestors of a leaf in their runs, from the leaf's level up."""
    steps = []
    for level in levels[:-1]:
        run = place // ARITY * ARITY
        steps.append(("".join(level[run:place]), "".join(level[place + 1 : run + ARITY])))
        place //= ARITY
    return steps


def copied_path(digest: str, steps: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a leaf, hashed anew from it and the nodes it shares with the tree."""
    path = []
    for before, behind in steps:
        digest = _hash(before + digest + behind)
        path.append(digest)
    return path


def _blocks(rows: DataFrame) -> DataFrame:
    """Whole blocks in one partition, in order; a row of pos -1 comes first."""
    n = prepare(rows.sparkSession)
    return rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _groups(batches):
    """Tree, block and rows of every block."""
    for rows in whole_groups(batches, ["tree", "block"]):
        starts = group_starts(rows, ["tree", "block"]).tolist()
        for begin, end in zip(starts, [*starts[1:], rows.num_rows]):
            yield rows["tree"][begin].as_py(), rows["block"][begin].as_py(), rows.slice(begin, end - begin)


def _inner_nodes(leaves: DataFrame, tier: int, height: int) -> DataFrame:
    """The nodes above the lowest level of every block. ``leaves``: tree, pos, n, digest."""
    names = ["tree", "level", "pos", "n", "digest"]

    def build(batches):
        for tree, block, rows in _groups(batches):
            n, out = rows["n"][0].as_py(), []
            for up, level in enumerate(levels_of(rows["digest"].to_pylist(), n, height)[1:], 1):
                n = -(-n // ARITY)
                first = block * ARITY ** (height - up)
                out += [(tree, tier * height + up, first + i, n, digest) for i, digest in enumerate(level)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=names)

    blocks = leaves.filter("n > 1").withColumn("block", F.expr(f"pos div {ARITY ** height}"))
    return _blocks(blocks.select("tree", "block", "pos", "n", "digest")).mapInArrow(build, NODE)


def _grow(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The leaves of every tier, and all inner nodes."""
    tiers, nodes = [leaves.select("tree", "pos", "n", "digest")], []
    while True:
        nodes.append(staged(_inner_nodes(tiers[-1], len(tiers) - 1, height), "nodes"))
        roots = nodes[-1].filter((F.col("level") == len(tiers) * height) & (F.col("n") > 1)).select("tree", "pos", "n", "digest")
        if roots.isEmpty():
            return tiers, reduce(DataFrame.union, nodes)
        tiers.append(roots)


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last node of every tree: tree, subroot."""
    single = leaves.filter("n = 1").select("tree", F.col("digest").alias("subroot"))
    return single.union(nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot")))


#: What a block is told by the tiers above it.
TOLD = f"path {STEPS}, subroot string, place long"


def _told(leaves: DataFrame, above: DataFrame | None, tops: DataFrame, height: int) -> DataFrame:
    """One row of pos -1 for every block: the path on from its root. ``above``: the result of the next tier."""
    size = ARITY ** height
    last = leaves.filter(f"pos = 0 AND n <= {size}").select("tree", F.lit(0).cast("long").alias("block"))
    rows = last.join(tops, "tree").select("tree", "block", "path", "subroot", "place")
    if above is not None:
        rows = rows.union(above.select("tree", F.col("pos").alias("block"), "path", "subroot", "place"))
    return rows


def _with_path(leaves: DataFrame, told: DataFrame, height: int) -> DataFrame:
    blocks = leaves.withColumn("block", F.expr(f"pos div {ARITY ** height}"))
    return _blocks(blocks.unionByName(told.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def _block_paths(leaves: DataFrame, told: DataFrame, height: int) -> DataFrame:
    """tree, pos and the whole path from every node of a tier to the root: what the blocks below it are told."""

    def climb(batches):
        for tree, _, rows in _groups(batches):
            head = rows.slice(0, 1).to_pylist()[0]
            upper = [(s["before"], s["behind"]) for s in head["path"]]
            digests = rows["digest"].to_pylist()[1:]
            levels = levels_of(digests, rows["n"][1].as_py(), height)
            out = [
                {
                    "tree": tree, "pos": pos, "subroot": head["subroot"], "place": head["place"],
                    "path": [{"before": a, "behind": b} for a, b in siblings(levels, i) + upper],
                }
                for i, pos in enumerate(rows["pos"].to_pylist()[1:])
            ]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    step = pa.struct([("before", pa.string()), ("behind", pa.string())])
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(step)), ("subroot", pa.string()), ("place", pa.int64())])
    rows = _with_path(leaves, told, height).select("tree", "block", "pos", "n", "digest", "path", "subroot", "place")
    return rows.mapInArrow(climb, f"tree string, pos long, {TOLD}")


def _tier_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """What the blocks of the lowest tier are told: the tiers above it hand the path down."""
    above = None
    for leaves in tiers[:0:-1]:
        above = staged(_block_paths(leaves, _told(leaves, above, tops, height), height), "paths")
    return _told(tiers[0], above, tops, height)


@dataclass
class Manifest:
    """A stored tree.

    ``leaves``: id, tree, digest, edited (the digest of the edited row; null: untouched), pos, n. ``nodes``: tree
    (null: the tree of subroots), level from 1, pos, n (nodes of that level), digest. ``root``: its digest.
    """

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    told: DataFrame
    height: int

    def versions(self) -> DataFrame:
        """One row for every leaf, with the version that its edit opens.

        id, tree (null: the tree of the null key), leaf, pos, n, place (of the tree among the trees), subroot,
        proof (digest of all siblings from the leaf to the root), folded (the root from the edited or else the
        original leaf), copies (the version's own nodes from the leaf's parent to the root; none if untouched).
        """
        leaves, told, height = self.leaves, self.told, self.height
        id_type = leaves.schema["id"].dataType.simpleString()
        names = ["id", "tree", "leaf", "pos", "n", "place", "subroot", "proof", "folded", "copies"]

        def fold(batches):
            for tree, _, rows in _groups(batches):
                head, own = rows.slice(0, 1).to_pylist()[0], rows.slice(1).combine_chunks()
                upper = [(s["before"], s["behind"]) for s in head["path"]]
                beyond = "".join(a + b for a, b in upper)
                digests, edited = own["digest"].to_pylist(), own["edited"].to_pylist()
                levels = levels_of(digests, own["n"][0].as_py(), height)
                proofs, folded, copies = [], [], []
                for i, digest in enumerate(digests):
                    steps = siblings(levels, i)
                    path = copied_path(edited[i] or digest, steps + upper)
                    proofs.append(_hash("".join(a + b for a, b in steps) + beyond))
                    folded.append(path[-1] if path else edited[i] or digest)
                    copies.append(path if edited[i] else [])
                same = own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        own["id"].combine_chunks(), pa.array([tree] * same, pa.string()), own["digest"].combine_chunks(), own["pos"].combine_chunks(),
                        own["n"].combine_chunks(), pa.array([head["place"]] * same, pa.int64()), pa.array([head["subroot"]] * same, pa.string()),
                        pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(copies, pa.list_(pa.string())),
                    ],
                    names=names,
                )

        rows = _with_path(leaves, told, height).select("id", "tree", "block", "pos", "n", "digest", "edited", "path", "subroot", "place")
        kinds = "tree string, leaf string, pos long, n long, place long, subroot string, proof string, folded string, copies array<string>"
        return rows.mapInArrow(fold, f"id {id_type}, {kinds}").withColumn("tree", tree_of("tree"))

    def copied_nodes(self, versions: DataFrame) -> DataFrame:
        """The nodes that versions own: version (the leaf's id), tree (null: the tree of subroots), level, pos, digest."""
        climb = f"aggregate(sequence(1, 21), struct(n AS nodes, 0 AS up), (a, x) -> IF(a.nodes > 1, struct((a.nodes + {ARITY - 1}) div {ARITY} AS nodes, a.up + 1 AS up), a)).up"
        nodes = versions.select(
            F.col("id").alias("version"), "tree", "pos", "place", F.expr(climb).alias("height"), F.posexplode("copies").alias("step", "digest")
        ).withColumns({"inside": F.expr("step < height"), "level": F.expr("step + 1 - IF(step < height, 0, height)")})
        return nodes.select(
            "version", F.when(F.col("inside"), tree_key(F.col("tree"))).alias("tree"), "level",
            F.expr(f"shiftright(IF(inside, pos, place), level * {ARITY.bit_length() - 1})").alias("pos"), "digest",
        )

    def at(self, copied: DataFrame, version) -> DataFrame:
        """All inner nodes as of a version: its copies, and the shared nodes elsewhere."""
        own = copied.filter(F.col("version") == F.lit(version)).select("tree", "level", "pos", F.col("digest").alias("_own"))
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("tree", "level", "pos")]
        both = self.nodes.alias("a").join(own.alias("b"), reduce(Column.__and__, on), "left")
        return both.select("a.tree", "a.level", "a.pos", F.coalesce("_own", "digest").alias("digest"))


def tree_key(tree: Column) -> Column:
    """Keys in byte order with null before all others."""
    return F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))


def tree_of(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(key, 2, 1 << 30))


def build(rows: DataFrame, height: int = TIER) -> Manifest:
    """Store the tree of ``rows``: id (its order), tree, digest, edited (null: untouched)."""
    leaves = rows.select("id", tree_key(F.col("tree")).alias("tree"), "digest", "edited")
    leaves = staged(ranked(staged(leaves, "leaves"), "tree", ["id", "digest", "edited"], "ranks"), "leaves")
    tiers, nodes = _grow(leaves, height)
    # The trees are the leaves of one more tree.
    subroots = _tops(leaves, nodes).select(F.lit("").alias("forest"), "tree", "subroot")
    trees = staged(ranked(staged(subroots, "subroots"), "forest", ["tree"], "subroots"), "subroots")
    forest = trees.select(F.col("forest").alias("tree"), "pos", "n", F.col("subroot").alias("digest"))
    upper, above = _grow(forest, height)
    root = _tops(forest, above).first()
    top = forest.filter("pos = 0").select("tree").withColumns({"path": F.array().cast(STEPS), "subroot": F.lit(root and root.subroot).cast("string"), "place": F.lit(0).cast("long")})
    paths = staged(_block_paths(upper[0], _tier_paths(upper, top, height), height), "paths")
    tops = trees.join(paths.select("pos", "path"), "pos").select("tree", "path", "subroot", F.col("pos").alias("place"))
    told = staged(_tier_paths(tiers, tops, height), "paths")
    every = nodes.union(above.withColumn("tree", F.lit(None).cast("string")))
    return Manifest(leaves, every, root and root.subroot, told, height)


def document_manifest(docs: DataFrame, height: int = TIER) -> Manifest:
    """The manifest of documents, a tree for each language, in which every third row (by the crc32 of its id) is edited.

    A leaf covers doc_id, source, lang, n_chars and text. The edit lower-cases the letters A to Z of the text; a null
    text stays, and a row without an id is never edited. Other columns play no part.
    """
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    edit = leaf_digest(*parts[:-1], F.translate("text", UPPER, LOWER))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return build(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), leaf_digest(*parts).alias("digest"), F.when(hit, edit).alias("edited")), height)


def manifest_sql(depth: int = 8, forest_depth: int = 4) -> str:
    """The digests of ``document_manifest`` level by level, for trees of at most 8 ** depth leaves."""
    steps = "list_reduce(list_prepend({}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, b: {steps.format('xor(c, b)')}), 4294967295)"
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    edited = field.format(f"translate(text, '{UPPER}', '{LOWER}')")
    out = [
        f"WITH hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {head} AS head, text, {crc} AS crc FROM documents)",
        f"leaves AS (SELECT doc_id, k, sha256(head || {field.format('text')}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || {edited}) END AS edited FROM hashed)",
        "d0 AS (SELECT doc_id, k, leaf, coalesce(edited, leaf) AS cur, '' AS proof, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "count(*) OVER (PARTITION BY k) AS n FROM leaves)",
        "t0 AS (SELECT k, pos, n, leaf AS h FROM d0)",
    ]

    def climb(t: str, d: str, i: int) -> None:
        over = "OVER (PARTITION BY k, pos // 8 ORDER BY pos ROWS BETWEEN "
        out.append(
            f"s{t}{i} AS (SELECT k, pos, n, h, coalesce(string_agg(h, '') {over}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') {over}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{i} WHERE n > 1)"
        )
        out.append(
            f"{t}{i + 1} AS (SELECT k, pos // 8 AS pos, any_value((n + 7) // 8) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {t}{i} WHERE n > 1 GROUP BY k, pos // 8 "
            f"UNION ALL SELECT k, pos, n, h FROM {t}{i} WHERE n = 1)"
        )
        join = {"t": "d.k = s.k AND d.pos = s.pos", "f": "d.place = s.pos"}[t]
        place = {"t": "pos", "f": "place"}[t]
        rest = {"t": "d.doc_id, d.k, d.leaf", "f": "d.doc_id, d.k, d.leaf, d.subroot"}[t]
        keep = "" if t == "f" else ", CASE WHEN s.k IS NULL THEN d.n ELSE (d.n + 7) // 8 END AS n"
        out.append(
            f"{d}{i + 1} AS (SELECT {rest}, CASE WHEN s.k IS NULL THEN d.cur ELSE sha256(s.l || d.cur || s.r) END AS cur, d.proof || coalesce(s.l || s.r, '') AS proof, "
            f"CASE WHEN s.k IS NULL THEN d.{place} ELSE d.{place} // 8 END AS {place}{keep} FROM {d}{i} d LEFT JOIN s{t}{i} s ON {join})"
        )

    for i in range(depth):
        climb("t", "d", i)
    out += [
        f"trees AS (SELECT k AS tree, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM t{depth})",
        f"e0 AS (SELECT d.doc_id, d.k, d.leaf, f.h AS subroot, d.cur, d.proof, f.pos AS place FROM d{depth} d JOIN trees f ON f.tree = d.k)",
        "f0 AS (SELECT '' AS k, pos, n, h FROM trees)",
    ]
    for i in range(forest_depth):
        climb("f", "e", i)
    body = ", ".join(out)
    return (
        f"{body} SELECT e.doc_id, e.leaf, e.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = r.h AS verified "
        f"FROM e{forest_depth} e JOIN f{forest_depth} r ON r.pos = 0"
    )
