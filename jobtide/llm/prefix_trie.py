"""Prefix trie of conversations, built as a distributed burst trie.

A conversation is a sequence of turns; a turn is known by 128 bits of the hash of its role and text. Conversations of
equal turns are one sequence with a count. Sequences lie as suffixes in containers under trie heads, at first all
under the root. A container that holds more than one sequence and more turn ids than the limit bursts by the next
turn id: its top becomes a trie head, and its suffixes move into containers one level down. A round looks several
turns ahead, so a long shared beginning costs few rounds. What remains is dealt out by container, sorted by turn ids
and swept once: neighbours share a path as far as they agree, and a node is finished when the sweep leaves it.
Containers report their sums to the heads above them, whose own sums are added up in one aggregation.

Conversations are cut into sections of ``SECTION`` turns, which bounds the rows: the trie of one section hangs below
the last nodes of the section before it, and the sections are built from the deepest up.

Turns without a conversation id are left out. Null roles and texts are empty. Turns of a conversation are ordered by
turn (null first), then role, then text. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import group_starts, prepare, staged, whole_groups
from jobtide.llm.ranks import ranked

#: Turn ids that a container may hold if it has more than one sequence, and turns of a conversation held in one row.
LIMIT, SECTION = 100_000, 4096
#: Turns that the first round of bursting looks ahead; the next ones double it.
AHEAD = 32
ID = 16
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
#: Conversation ids that are joined into one row before they are hashed.
JOINED = 50_000


def _md5(blob: bytes) -> str:
    return hashlib.md5(blob, usedforsecurity=False).hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128 bits, in hexadecimal, of the hash of a turn's role and text."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), key and words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role, text)
    key = turn_id(F.col("role"), F.col("text")).alias("key")
    kept = [F.col("conv_id"), key, F.regexp_count("text", F.lit(WORD)).cast("int").alias("words")]
    return ranked(turns, "conv_id", ["turn", "role", "text"], "turns", kept)


def lent_beginnings(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the first one of their family.

    Of conversation c the first h turns (crc32 of its id modulo ``most``) are replaced by as many turns, or all,
    of c - c % family (the remainder has the sign of c); if that one is missing, by none. Returns conv_id, place (from 1), key and words; a
    conversation that is left without turns has one row of place 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    named = turns.withColumns({"h": h, "lender": F.col("conv_id") - F.col("conv_id") % family})
    first = named.filter("pos = 0")
    lenders = first.filter("conv_id = lender").select("lender", F.col("n").alias("lent"))
    known = first.select("conv_id", "lender", "h", "n").join(lenders, "lender", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    lines = turns.filter((F.col("pos") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("lender"), "pos", "key", "words")
    lent = known.filter("lent > 0").join(lines, "lender").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("place"), "key", "words")
    # Of a conversation's own turns only those after its first h, which move up by what the lender is short of.
    lacking = known.filter("lent < h").select("conv_id", "lent")
    own = named.filter("pos >= h").join(lacking, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.col("h") + F.coalesce("lent", "h") + 1).alias("place"), "key", "words"
    )
    none = known.filter("lent = 0 AND n <= h").select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("words"))
    return lent.union(own).union(none)


def _pieces(turns: DataFrame, section: int) -> DataFrame:
    """conv_id, part, blob (the turn ids) and words of every section of every conversation."""
    part = F.greatest(F.floor((F.col("place") - 1) / section), F.lit(0)).cast("int").alias("part")
    lines = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("place", "key", "words"))))
    return turns.groupBy("conv_id", part).agg(lines.alias("lines")).select(
        "conv_id", "part", F.unhex(F.array_join("lines.key", "")).alias("blob"), F.col("lines.words").alias("words")
    )


@dataclass
class _Section:
    """Distinct sequences (``sequences``) of one section and the sequence of every conversation in it (``members``)."""

    members: DataFrame
    sequences: DataFrame


def _sections(pieces: DataFrame) -> list[_Section]:
    deepest = pieces.agg(F.max("part")).first()[0]
    out: list[_Section] = []
    for part in range(-1 if deepest is None else deepest + 1):
        own = pieces.filter(F.col("part") == part).drop("part")
        if out:
            own = own.join(out[-1].members.select("conv_id", F.col("sid").alias("head")), "conv_id")
        else:
            own = own.withColumn("head", F.lit(""))
        members = staged(own.withColumn("sid", F.md5(F.concat(F.col("head").cast("binary"), "blob"))), "members")
        counted = members.groupBy("head", "sid").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        sequences = counted.join(members.select("conv_id", "blob", "words"), "conv_id").withColumnRenamed("conv_id", "rep")
        if out:
            sequences = sequences.join(out[-1].sequences.select(F.col("sid").alias("head"), F.col("rep").alias("head_conv")), "head")
        else:
            sequences = sequences.withColumn("head_conv", F.lit(None).cast("long"))
        out.append(_Section(members, staged(sequences, "sequences")))
    return out


def _prefixes(open_rows: DataFrame, ahead: int) -> DataFrame:
    """The next prefixes of every sequence after its first ``done`` turns, ``ahead`` at most, one row each."""
    kind = "head string, sid string, depth int, pk string, above string, behind int, word long, rep long, n long"
    names = [f.split(" ")[0] for f in kind.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split(" ")[1]] for f in kind.split(", ")]

    def explode(batches):
        for batch in batches:
            out = []
            for head, sid, done, blob, words, rep, n in zip(*[c.to_pylist() for c in batch.columns]):
                length = len(blob) // ID
                chain = hashlib.md5(blob[: done * ID], usedforsecurity=False)
                above = chain.hexdigest()
                for depth in range(done + 1, min(length, done + ahead) + 1):
                    chain.update(blob[(depth - 1) * ID : depth * ID])
                    pk = chain.hexdigest()
                    out.append((head, sid, depth, pk, above, length - depth, words[depth - 1], rep, n))
                    above = pk
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return open_rows.select("head", "sid", "done", "blob", "words", "rep", "n").mapInArrow(explode, kind)


def _burst(sequences: DataFrame, limit: int, ahead: int) -> tuple[DataFrame, DataFrame | None]:
    """Containers (sid, depth, pk) of the sequences that have one, and the trie heads above them.

    A head: head, depth, pk, above (the key of its parent), word, rep, n, sample (a sequence below it), sid (the
    sequence that ends there, if any).
    """
    length = F.length("blob") / ID
    tops = sequences.groupBy("head").agg(
        F.sum(length).alias("ids"), F.count("*").alias("held"), F.sum("n").alias("n"), F.coalesce(F.min("head_conv"), F.min("rep")).alias("rep"),
        F.min("sid").alias("sample"), F.max(F.when(length == 0, F.col("sid"))).alias("sid"),
    )
    over = (F.col("ids") > limit) & (F.col("held") > 1)
    big = tops.filter(over).select(
        "head", F.lit(0).alias("depth"), F.lit(_md5(b"")).alias("pk"), F.lit(None).cast("string").alias("above"),
        F.lit(0).cast("long").alias("word"), "rep", "n", "sample", "sid",
    )
    big = staged(big, "heads")
    small = sequences.join(big, "head", "left_anti").select("sid", F.lit(0).alias("depth"), F.lit(_md5(b"")).alias("pk"))
    if big.isEmpty():
        return small, None
    heads, boxes = [big], [small]
    rows = sequences.join(big.select("head"), "head", "left_semi").withColumn("done", F.lit(0))
    while True:
        prefixes = staged(_prefixes(rows, ahead), "prefixes")
        counted = prefixes.groupBy("head", "depth", "pk").agg(
            F.min("above").alias("above"), F.max("word").alias("word"), F.min("rep").alias("rep"), F.sum("n").alias("n"), F.min("sid").alias("sample"),
            F.max(F.when(F.col("behind") == 0, F.col("sid"))).alias("sid"), F.sum("behind").alias("ids"), F.count("*").alias("held"),
        )
        hot = staged(counted.filter(over).drop("ids", "held"), "heads")
        heads.append(hot.select(*big.columns))
        marked = prefixes.join(hot.select("head", "depth", "pk", F.lit(True).alias("hot")), ["head", "depth", "pk"], "left")
        state = marked.groupBy("sid").agg(
            F.max(F.when(F.col("hot"), F.col("depth"))).alias("done"),
            F.min(F.when(F.col("hot").isNull(), F.struct("depth", "pk"))).alias("box"),
            F.max(F.col("depth") + F.col("behind")).alias("length"),
        )
        state = staged(state, "state")
        boxes.append(state.filter("box IS NOT NULL").select("sid", "box.depth", "box.pk"))
        further = state.filter("box IS NULL AND length > done").select("sid", "done")
        if further.isEmpty():
            return reduce(DataFrame.union, boxes), reduce(DataFrame.union, heads)
        rows = sequences.join(further, "sid")
        ahead *= 2


def _agreement(a: bytes, b: bytes) -> int:
    """Turn ids that two sequences share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // ID
    x, y = np.frombuffer(a, np.uint64, n // 8), np.frombuffer(b, np.uint64, n // 8)
    return int((x != y).argmax()) * 8 // ID


def sweep(top: int, rows: list[tuple], top_conv: int | None) -> list[list]:
    """The nodes of one container, whose top is ``top`` turns deep; its own top is the first one.

    ``rows``: blob, words, smallest conversation, conversations, sid, and children, leaves and saved tokens that
    hang below the end. A node: depth, smallest conversation, the parent's place in the list (-1: above the
    top), conversations, children, leaves, saved tokens, word count, sid of what ends there.
    """
    nodes: list[list] = [[top, None, -1, 0, 0, 0, 0, rows[0][1][top - 1] if top else 0, None]]
    path = [0]  # places in ``nodes`` of the nodes from the top down

    def close() -> None:
        node = nodes[path.pop()]
        if not node[4]:
            node[5] = 1
        node[6] += (node[3] - 1) * node[7]
        if path:
            parent = nodes[path[-1]]
            parent[1] = node[1] if parent[1] is None else min(parent[1], node[1])
            parent[3] += node[3]
            parent[4] += 1
            parent[5] += node[5]
            parent[6] += node[6]

    before = b""
    for blob, words, rep, n, sid, children, leaves, saved in sorted(rows, key=lambda r: r[0]):
        shared = max(_agreement(before, blob), top)
        while len(path) - 1 > shared - top:
            close()
        for depth in range(shared + 1, len(blob) // ID + 1):
            nodes.append([depth, None, path[-1], 0, 0, 0, 0, words[depth - 1], None])
            path.append(len(nodes) - 1)
        end = nodes[path[-1]]
        end[1] = rep if end[1] is None else min(end[1], rep)
        end[3] += n
        end[4] += children
        end[5] += leaves
        end[6] += saved
        end[8] = sid
        before = blob
    while path:
        close()
    if top_conv is not None and top == 0:
        nodes[0][1] = top_conv
    return nodes


#: What the sweep yields. kind 0: a node; 1: sums that a container reports to a head above it; 2: the top of a section.
SWEPT = (
    "kind int, head string, depth int, pk string, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sid string"
)


def _swept(boxed: DataFrame) -> DataFrame:
    n = prepare(boxed.sparkSession)
    names = [f.split(" ")[0] for f in SWEPT.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split(" ")[1]] for f in SWEPT.split(", ")]
    given = ["blob", "words", "rep", "n", "sid", *MORE]

    def run(batches):
        out: list[tuple] = []
        for rows in whole_groups(batches, ["head", "depth", "pk"], 2_000):
            starts = group_starts(rows, ["head", "depth", "pk"]).tolist()
            for begin, end in zip(starts, [*starts[1:], rows.num_rows]):
                part = rows.slice(begin, end - begin)
                head, top, head_conv = (part[c][0].as_py() for c in ("head", "depth", "head_conv"))
                members = list(zip(*[part[c].to_pylist() for c in given]))
                nodes = sweep(top, members, head_conv)
                for place, (depth, conv, parent, n_convs, children, leaves, saved, _, sid) in enumerate(nodes):
                    above, kind = None, 0
                    if not place:
                        kind = 0 if top else 2
                        above = _md5(members[0][0][: (top - 1) * ID]) if top else None
                    out.append((kind, head, depth, above, conv, nodes[parent][1] if place else None, n_convs, children, leaves, saved, sid))
                chain = hashlib.md5(usedforsecurity=False)
                for depth in range(top):
                    out.append((1, head, depth, chain.hexdigest(), None, None, None, int(depth == top - 1), nodes[0][5], nodes[0][6], None))
                    chain.update(members[0][0][depth * ID : (depth + 1) * ID])
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = boxed.select("head", "depth", "pk", "head_conv", *given)
    return rows.repartition(n, "head", "depth", "pk").sortWithinPartitions("head", "depth", "pk").mapInArrow(run, SWEPT)


def _head_reports(heads: DataFrame, sequences: DataFrame) -> DataFrame:
    """What each trie head reports to the heads above it: head, depth, pk, n_children, n_leaves, saved_tokens."""
    kind = "head string, depth int, pk string, n_children long, n_leaves long, saved_tokens long"

    def climb(batches):
        for batch in batches:
            out = []
            for head, depth, blob, n, word in zip(*[c.to_pylist() for c in batch.columns]):
                chain = hashlib.md5(usedforsecurity=False)
                for above in range(depth):
                    out.append((head, above, chain.hexdigest(), int(above == depth - 1), 0, (n - 1) * word))
                    chain.update(blob[above * ID : (above + 1) * ID])
            if out:
                types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "depth", "pk", "n_children", "n_leaves", "saved_tokens"])

    sampled = heads.filter("depth > 0").join(sequences.select(F.col("sid").alias("sample"), "blob"), "sample")
    return sampled.select("head", "depth", "blob", "n", "word").mapInArrow(climb, kind)


#: Columns of a node, and the sums of what hangs below a sequence's end in the next section.
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sid"]
MORE = ["more_children", "more_leaves", "more_saved"]


def _trie(sequences: DataFrame, limit: int, ahead: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the heads of one section, and the heads' own rows (head and the columns of a node)."""
    boxes, heads = _burst(sequences, limit, ahead)
    swept = staged(_swept(sequences.join(boxes, "sid")), "swept")
    inner = swept.filter("kind = 0")
    tops = swept.filter("kind = 2").select("head", *NODE)
    if heads is None:
        return inner.select(*NODE), tops
    keys = ["head", "depth", "pk"]
    reports = swept.filter("kind = 1").select(*keys, "n_children", "n_leaves", "saved_tokens").union(_head_reports(heads, sequences))
    sums = reports.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    closed = heads.join(sums, keys).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n") - 1) * F.col("word"))
    closed = staged(closed, "heads")
    parents = closed.select("head", (F.col("depth") + 1).alias("depth"), F.col("pk").alias("above"), F.col("rep").alias("_parent"))
    own = closed.join(parents, ["head", "depth", "above"], "left").select(
        "head", "depth", F.col("rep").alias("conv_id"), F.col("_parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", "sid",
    )
    hung = inner.filter("pk IS NOT NULL").drop("parent_conv_id").withColumnRenamed("pk", "above").join(parents, ["head", "depth", "above"])
    nodes = inner.filter("pk IS NULL").select(*NODE).union(hung.withColumnRenamed("_parent", "parent_conv_id").select(*NODE))
    return nodes.union(own.filter("depth > 0").select(*NODE)), tops.union(own.filter("depth = 0").select("head", *NODE))


def _ends(members: DataFrame) -> DataFrame:
    """sid and the SHA-256 of the ids, ascending and joined by commas, of the conversations that end with it.

    Ids are joined in tasks that hold ranges of (sid, conv_id); one sequence's parts are then hashed one after
    the other, so a sequence of very many copies streams through one task in rows of many ids.
    """

    def join(batches):
        for batch in batches:
            starts = group_starts(pa.Table.from_batches([batch]), ["sid"]).tolist()
            ids = batch.column("conv_id").to_pylist()
            rows = []
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                for at in range(begin, end, JOINED):
                    rows.append((batch.column("sid")[begin].as_py(), ids[at], ",".join(map(str, ids[at : min(at + JOINED, end)]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["sid", "first", "ids"])

    def hashed(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
                if sid == current:
                    state.update(b"," + ids.encode())
                    continue
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = sid, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["sid", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["sid", "ends_sha256"])

    n = prepare(members.sparkSession)
    parts = members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").filter("sid IS NOT NULL")
    joined = parts.mapInArrow(lambda b: join(x for x in b if x.num_rows), "sid string, first long, ids string")
    return joined.repartition(n, "sid").sortWithinPartitions("sid", "first").mapInArrow(hashed, "sid string, ends_sha256 string")


def trie(turns: DataFrame, limit: int = LIMIT, section: int = SECTION, ahead: int = AHEAD) -> DataFrame:
    """The nodes of the trie of conversations given as turns: conv_id, place (from 1; 0: no turns), key, words.

    One row per distinct beginning of turns: conv_id (the smallest conversation that begins so), depth,
    parent_conv_id, n_convs, n_children, n_leaves (childless nodes below, or itself), saved_tokens (over the subtree,
    words of a node's turn times its conversations but one), ends_sha256 (of the conversations that end there).
    """
    levels = _sections(staged(_pieces(turns, section), "pieces"))
    if not levels:
        return turns.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    nodes, below, ended = [], None, []
    for part in range(len(levels) - 1, -1, -1):
        sequences, members = levels[part].sequences, levels[part].members.select("conv_id", "sid")
        if below is None:
            given = sequences.withColumns({c: F.lit(0).cast("long") for c in MORE})
        else:
            sums = [F.col(c).alias(m) for c, m in zip(("n_children", "n_leaves", "saved_tokens"), MORE)]
            given = sequences.join(below.select(F.col("head").alias("sid"), *sums), "sid", "left").fillna(0, MORE)
            members = members.join(levels[part + 1].members.select("conv_id"), "conv_id", "left_anti")
        found, below = _trie(given, limit, ahead)
        nodes.append(found.withColumn("depth", F.col("depth") + part * section))
        ended.append(members)
    rows = staged(reduce(DataFrame.union, nodes).union(below.select(*NODE)), "nodes")
    ends = staged(_ends(staged(reduce(DataFrame.union, ended), "ends")), "ends")
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    # Nodes without an end never meet the join: their key would be one null.
    inner = rows.filter("sid IS NULL").select(*out, F.lit(EMPTY).alias("ends_sha256"))
    last = rows.filter("sid IS NOT NULL").join(ends, "sid", "left")
    return inner.union(last.select(*out, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))


def trie_sql() -> str:
    """The nodes of the rebuilt conversations by grouping all their beginnings."""
    steps = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda c, b: {steps}), 4294967295)"
    return f"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM ordered)),
lines AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.lender AND o.pos < c.h
  UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos >= c.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, md5(strlen(role) || ':' || role || text) AS key, text FROM lines),
begun AS (
  SELECT conv_id, depth, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM numbered
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
stops AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM begun),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM stops GROUP BY path),
families AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT b.path, sum(n.saved) AS saved_tokens, sum(CASE WHEN f.path IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes n LEFT JOIN families f ON f.path = n.path JOIN begun b ON b.conv_id = n.conv_id AND b.depth <= n.depth GROUP BY b.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN families f ON f.path = n.path LEFT JOIN nodes p ON p.path = n.parent"""
