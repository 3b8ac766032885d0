"""The path-copying manifest against a plain Merkle tree."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtide.llm import merkle, queries, ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id int, tree string, pos int"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(rows):
    """Contract columns of (doc_id, text, lang, source, n_chars) rows, by one tree in memory."""

    def leaf(r, text):
        return digest(*map(field, (r[0], r[3], r[2], r[4], text)))

    def up(nodes):
        return [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]

    def steps(nodes, place):
        out = []
        while len(nodes) > 1:
            run = place // 8 * 8
            out.append((nodes[run:place], nodes[place + 1 : run + 8]))
            nodes, place = up(nodes), place // 8
        return out, nodes[0]

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    leaves = {k: [leaf(r, r[1]) for r in trees[k]] for k in keys}
    subroots = [steps(leaves[k], 0)[1] for k in keys]
    out = []
    for place, k in enumerate(keys):
        above, root = steps(subroots, place)
        for i, r in enumerate(trees[k]):
            inside, subroot = steps(leaves[k], i)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            cur = leaf(r, text)
            for before, behind in inside + above:
                cur = digest(*before, cur, *behind)
            proof = digest(*[x for before, behind in inside + above for x in before + behind])
            out.append((r[0], leaves[k][i], subroot, root, proof, cur, cur == root))
    return out


def documents(n, langs):
    random.seed(n)
    rows = [
        (i * 3 - 7, random.choice([None, "", "Plain TEXT", "no capitals", "ÄÖ Über", "X" * 5000]), random.choice(langs), random.choice([None, "web", "é"]), random.choice([None, 0, -5, 12]))
        for i in range(n)
    ]
    return rows + rows[:3] + [(None, "No Id", langs[0], None, None)] * 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "t", 4) for r in rows], DOCS)


@pytest.mark.parametrize(
    ("n", "langs", "height"),
    [(0, [None], 4), (1, ["en"], 4), (6, [None, "", "é"], 1), (90, [None, "en"], 1), (200, ["en", "en", "en", "fr"], 1), (700, ["en", "de"], 2), (40, [f"l{i}" for i in range(30)], 1)],
)
def test_versions_equal_a_plain_tree(spark, n, langs, height):
    rows = documents(n, langs) if n else []
    manifest = merkle.document_manifest(frame(spark, rows), height)
    found = manifest.versions().select("id", "leaf", "subroot", F.lit(manifest.root).cast("string"), "proof", "folded", (F.col("folded") == F.lit(manifest.root)))
    key = lambda r: (str(r[0]), r[1], r[4])
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted(plain(rows), key=key)
    assert (manifest.root is None) == (not rows)


def test_a_lone_row_is_its_own_root(spark):
    manifest = merkle.document_manifest(frame(spark, [(1, "Text", "en", None, 4)]))
    (row,) = manifest.versions().collect()
    assert row.leaf == row.subroot == manifest.root and row.proof == digest() and manifest.nodes.isEmpty()


def test_versions_share_untouched_nodes_and_can_be_read(spark):
    """A version's table is the tree that building from the edited rows alone would give."""
    rows = [(i, f"Text {i}", "en" if i % 5 else "fr", "s", i) for i in range(150)]
    manifest = merkle.document_manifest(frame(spark, rows), 1)
    versions = manifest.versions()
    copied = manifest.copied_nodes(versions)
    edited = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0]
    paths = {r[0]: r[1] for r in copied.groupBy("version").count().collect()}
    levels = {"en": 3, "fr": 2}
    assert paths == {i: levels[rows[i][2]] + 1 for i in edited}
    for version in edited[:2]:
        again = [(*r[:1], r[1].lower() if r[0] == version else r[1], *r[2:]) for r in rows]
        other = merkle.document_manifest(frame(spark, again), 1)
        assert sorted(map(str, manifest.at(copied, version).collect())) == sorted(map(str, other.nodes.drop("n").collect()))
        assert versions.filter(F.col("id") == version).first().folded == other.root


def test_ranks_of_hot_groups(spark):
    rows = [("a", i % 50, i) for i in range(400)] + [("b", 1, 0), ("", None, 1)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(7)
    found = ranks.ranked(df, "g", ["o", "x"], "test").collect()
    for g in ("a", "b", ""):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [(r.o or -1, r.x) for r in own] == sorted((r.o or -1, r.x) for r in own)


def test_query_equals_its_sql_and_a_plain_tree(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op11_path_copying(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert got == sorted(plain([tuple(r) for r in docs.collect()]))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert got == sorted(db.sql(queries.SQL["op11_path_copying"]).fetchall())
