"""Small cases and brute-force versions of the training-text operators."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from jobtide.llm import (
    byte_bpe, components, embedding_dedup, fingerprints, language_id, lcp_sort, mixing, queries, sharding, simhash_anchors, suffix_dedup, toxicity, warc_zip,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, bits string, node string, _tokens int, score string"
WORDS = "the of alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def frame(spark, texts, ids=None):
    """Documents whose other columns clash with names that operators use, and hold nulls."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, "x", "y", 7, None) for i, t in zip(ids, texts)], DOCS)


def groups_of(n, linked):
    """Smallest index reachable from each of n nodes."""
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if linked(a, b) and root[b] < root[a]:
                    root[a] = root[b]
    return root


# Components and pair helpers


def test_components_chain_star_and_loops(spark, rows):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[201] == 200
    assert not rows(components.components(spark.createDataFrame([], "a long, b long")))


# WARC


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip_revisits_and_odd_rows(spark, tmp_path, zip64):
    big, other = "é" * 600, "x" * 999
    pages = [(1, "u", big), (5, "u\r\nv", big), (3, None, big), (2, "u", other), (9, "u", other), (4, "u", None), (6, "u", ""), (None, "u", big), (5, "u", big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/warc"
    archives = warc_zip.archive_pages(df, folder, zip64=zip64)
    got = sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.read_archives(archives, folder).collect()), key=str
    )
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and page != 5
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    payloads = {r.page_id: bytes(r.payload) for r in warc_zip.read_archives(archives, folder).filter("record_type = 'response'").collect()}
    assert payloads[5] == big.encode() and payloads[4] == b""


def test_warc_empty_table(spark, tmp_path, rows):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert not rows(warc_zip.read_archives(warc_zip.archive_pages(df, f"file://{tmp_path}/w"), f"file://{tmp_path}/w"))


def test_directory_refuses_damaged_archives(tmp_path):
    path = tmp_path / "a.zip"
    writer = warc_zip.ZipWriter(path.open("wb"))
    writer.add("one", b"abc")
    writer.add("two", b"defg" * 10)
    writer.close()
    import zipfile

    assert zipfile.ZipFile(path).read("two") == b"defg" * 10
    with path.open("rb") as file:
        members = warc_zip.central_directory(file, path.stat().st_size)
        assert list(members) == ["one", "two"] and members["two"][0] == 0
        assert warc_zip._range(file, warc_zip.member_start(file, members["two"][1]), 4) == b"defg"
    path.write_bytes(b"x" * 100)
    with path.open("rb") as file, pytest.raises(ValueError, match="central directory"):
        warc_zip.central_directory(file, 100)


# BPE


def test_bpe_equals_the_library(spark):
    random.seed(5)
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [" ", "  ", "\n", "\t", "a", "the", "I'll", "1234", "!?", "é", "日本", " ", "\x1c", "🙂", "Übermaß"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 12))) for _ in range(400)]
    texts += ["", "<|endoftext|>", "a" * 20_000, " " * 3000 + "x", "word " * 30_000, None, None]
    vocabulary = byte_bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    coded = vocabulary.decode(vocabulary.encode(frame(spark, texts))).orderBy("doc_id").collect()
    both = vocabulary.round_trip(frame(spark, texts)).orderBy("doc_id")
    assert both.collect() == coded and both.columns == [*frame(spark, []).columns, "ids", "decoded"]
    for text, row in zip(texts, coded):
        want = library.encode_ordinary(text or "")
        assert bytes(row.ids) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(row.decoded) == (text or "").encode()
        assert row.bits == "x"


def test_bpe_cuts_long_texts_alike(monkeypatch):
    codec = byte_bpe.Codec(byte_bpe.serialise(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    texts = ["one two  three \n four five", "alpha beta gamma delta", " x y", "longwithoutblanks" * 3]
    want = codec.encode(texts)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 6)
    assert codec.encode(texts) == want and codec.decode(want) == [t.encode() for t in texts]


# SimHash with anchors


def plain_simhash(text, n=4):
    words = text.encode().lower().split()
    pieces = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark):
    random.seed(2)
    base = [" ".join(random.choices(WORDS, k=400)) for _ in range(6)]
    texts = base + [b.replace("alpha", "ALPHA", 3) for b in base] + [b + " end" for b in base] + ["", None, " \t\n", "a b", "A\x0bB", "a b"]
    prints = [plain_simhash(t or "") for t in texts]
    root = groups_of(len(texts), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_anchors.simhash_components(frame(spark, texts)).collect()}
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}


@pytest.mark.parametrize(("threshold", "blocks"), [(4, 3), (5, 3), (7, 4), (2, 1)])
def test_anchors_cover_every_pair_within_the_threshold(spark, threshold, blocks):
    rng = np.random.default_rng(threshold)
    prints = rng.integers(-(2**63), 2**63 - 1, 60)
    near = []
    for p in prints[:30]:
        for k in range(threshold + 2):
            bits = rng.choice(64, k, replace=False)
            near.append(int(p) ^ (sum(1 << int(b) for b in bits if b < 63) - (1 << 63 if 63 in bits else 0)))
    # Pairs that differ in the sign bit, in it and a few more, and in all high bits.
    near += [int(p) ^ -(1 << 63) for p in prints[:5]] + [(int(p) ^ -(1 << 63)) ^ 3 for p in prints[:5]] + [int(p) ^ -(1 << 20) for p in prints[5:9]]
    near += [0, -(1 << 22), -(1 << 63), 1, ~1]
    values = sorted({int(p) for p in prints} | set(near))
    df = spark.createDataFrame([(v, v, None) for v in values], "node long, fp long, more binary")
    for cell_rows in (4096, 3):
        links = simhash_anchors.link(df, threshold, blocks, cell_rows=cell_rows).collect()
        labels = np.arange(len(values))
        place = {v: i for i, v in enumerate(values)}
        from jobtide.llm.common import merge_labels

        merge_labels(labels, np.array([place[r.a] for r in links], int), np.array([place[r.b] for r in links], int))
        want = np.arange(len(values))
        pairs = [(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if ((x ^ y) % (1 << 64)).bit_count() <= threshold]
        merge_labels(want, *np.array(pairs).T)
        assert (labels == want).all()


def test_copies_leave_one_row_and_all_columns(spark):
    """Kept rows again by brute force over the fingerprints of all texts."""
    random.seed(3)
    base = [" ".join(f"w{random.randint(0, 3000)}" for _ in range(300)) for _ in range(6)]
    edited = [" ".join("zzz" if i == 150 else w for i, w in enumerate(b.split())) for b in base]
    texts = base + edited + [b.upper() for b in base[:3]] + [base[0], "", None, " \t", "short", "short", "word " * 50_000]
    ids = [10, 11, 12, 13, None, 15, 1, 21, 22, 23, 24, 25, 31, 32, 9, 5, 41, None, 40, 51, 50, 60]
    df = frame(spark, texts, ids).union(frame(spark, ["short"], [50]))
    rows = [(i, t) for i, t in zip([*ids, 50], [*texts, "short"])]
    prints = [plain_simhash(t or "") for _, t in rows]
    root = groups_of(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = set()
    for group in set(root):
        own = [rows[i] for i in range(len(rows)) if root[i] == group]
        best = min((i is None, i or 0) for i, _ in own)
        want.add(None if best[0] else best[1])
    left = simhash_anchors.drop_copies(df)
    assert left.columns == df.columns
    got = [r.doc_id for r in left.collect()]
    assert len(got) == len(set(root)) and set(got) == want
    assert simhash_anchors.drop_copies(df.limit(0)).count() == 0
    # Ids may be texts.
    named = df.withColumn("doc_id", F.concat(F.lit("id"), F.coalesce("doc_id", F.lit(99)).cast("string")))
    assert simhash_anchors.drop_copies(named).count() == len(set(root))


# Native fingerprints


def test_fingerprints_edits_and_neighbours(spark):
    random.seed(4)
    texts = [" ".join(random.choices(WORDS, k=random.randint(0, 60))) for _ in range(120)] + ["", None, "é" * 7, "same text here", "same text here"]
    ids = list(range(0, 5 * len(texts), 5))
    got = fingerprints.fingerprint_edits(frame(spark, texts, ids)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for i, row in enumerate(got):
        n, after = len(plain[i]), plain[(i + 1) % len(plain)]
        assert row.n_chars == n
        assert row.edited_sha256 == hashlib.sha256((plain[i][: n - n // 2] + after[: n // 2]).encode()).hexdigest()
        assert row.near_next == 1 - bin((row.fingerprint ^ got[(i + 1) % len(got)].fingerprint) % (1 << 64)).count("1") / 64
        near = sum(bin((row.fingerprint ^ r.fingerprint) % (1 << 64)).count("1") <= 3 for r in got) - 1
        assert row.n_near == (near if row.doc_id % 50 == 0 else None)
    assert got[-1].fingerprint == got[-2].fingerprint and got[120].fingerprint == got[121].fingerprint == 0
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    assert sorted(str(r.doc_id) for r in fingerprints.fingerprint_edits(frame(spark, ["a", "a", "b"], [None, 3, 3])).collect()) == ["3", "3", "None"]


def test_fingerprint_bits_equal_plain_votes(spark):
    """Votes and bits again outside Spark; only the terms' hashes come from it."""
    random.seed(12)
    texts = [" ".join(random.choices([*WORDS, "É", "x1", "extraordinarilylong"], k=random.randint(0, 80))) for _ in range(30)] + ["", None, "one", "- ! -"]
    words = sorted({w for t in texts for w in re.split(r"[^\w]+", (t or "").lower())} | {""})
    hashes = {r.w: r.h % (1 << 64) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def print_of(text):
        votes, total = [0] * 64, 0
        for w in re.split(r"[^\w]+", text.lower()):
            weight = min(len(w), 12)
            total += weight
            for b in range(64):
                votes[b] += weight * (hashes[w] >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > total)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in fingerprints.simhash(df, ["i"], "t").collect():
        assert r.fingerprint % (1 << 64) == print_of(texts[r.i] or "")


def test_permuted_tables_hold_every_pair_once():
    tables = fingerprints.permuted_tables(6, 3)
    rng = random.Random(1)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        x = x - (1 << 64) if x >> 63 else x
        assert sum(x & mask == 0 and all(x & m for m in others) for mask, others in tables) == 1


# Suffix sorting


def brute_cover(texts, length):
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((i, p))
    cover = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                cover[i][p : p + length] = True
    return cover


@pytest.mark.parametrize(("length", "seed"), [(400, 1), (60, 2), (33, 3)])
def test_repeats_equal_brute_force(spark, length, seed):
    random.seed(seed)
    base = [" ".join(random.choices([*WORDS, "é", "ß"], k=random.randint(5, 250))) for _ in range(25)]
    texts = list(base)
    for _ in range(40):
        a, b = random.choice(base), random.choice(base)
        at = random.randint(0, len(a))
        texts.append(b[: random.randint(0, len(b))] + a[at : at + random.randint(0, 900)] + random.choice(base)[:50])
    texts += [base[0], base[0], "", None, "a" * 1500, "ab" * 500, "xyz" * 200 + "q" + "xyz" * 150, "a" * (length - 1), "a" * length]
    data = [(t or "").encode() for t in texts]
    cover = brute_cover(data, length)
    found = suffix_dedup.remove_repeats(frame(spark, texts), "text", F.col("doc_id"), F.col("bits"), length=length).collect()
    assert len(found) == len(texts)
    for r in found:
        own, c = data[r.doc_id], cover[r.doc_id]
        assert bytes(r.kept) == np.frombuffer(own, np.uint8)[~c].tobytes()
        assert len(r.spans) == (np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum() and r.bits == "x"


@pytest.mark.parametrize("chunk", [300, 1000])
def test_repeats_between_pieces_of_one_text(spark, monkeypatch, chunk):
    random.seed(chunk)
    plain = lambda n: "".join(random.choices("abcdefghijklmnop ", k=n))
    passage, other = plain(150), plain(90)
    texts = [plain(1100) + passage + plain(2300) + passage + plain(40), plain(2500), other + plain(1700) + other, plain(80), None]
    texts.append(texts[1])
    cover = brute_cover([(t or "").encode() for t in texts], 60)

    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    found = suffix_dedup.remove_repeats(frame(spark, texts), "text", F.col("doc_id"), length=60).collect()
    for r in found:
        assert bytes(r.kept) == np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)[~cover[r.doc_id]].tobytes()
    assert cover[0].sum() >= 300 and cover[2].sum() >= 180


def test_passages_just_below_and_above_the_length(spark):
    """Passages of over fifty words: one of 399 bytes stays, one of 400 and one of 401 go; n_bytes is that of the whole text."""
    rng = random.Random(11)
    plain = lambda n: " ".join(rng.randbytes(3).hex() for _ in range(n // 7 + 1))[:n]
    passages = [plain(n) for n in (399, 400, 401)]
    assert all(len(p.split()) > 50 for p in passages)
    texts = [f"{plain(120)}{a}{p}{b}{plain(150)}" for p in passages for a, b in ("<>", "[]")]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), "text", F.col("doc_id")).collect()}
    for i, text in enumerate(texts):
        passage, row = passages[i // 2], found[i]
        assert row.n_bytes == len(text)
        assert bytes(row.kept).decode() == (text if len(passage) < 400 else text.replace(passage, ""))


def test_cut_passages_leaves_all_else_as_it_was(spark):
    rng = random.Random(13)
    words = lambda n: " ".join(rng.randbytes(4).hex() for _ in range(n))
    passage, accents = words(40), "é" * 130
    texts = [words(60), f"{words(30)} {passage} {words(5)}", f"{passage}", None, "", "short", "short", words(90), f"x{accents}y", f"q{accents}"]
    texts += [texts[0], texts[0]]
    df = frame(spark, texts).withColumn("_k", F.lit("kept"))
    got = {r.doc_id: r for r in suffix_dedup.cut_passages(df, "text", 200).collect()}
    plain = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, "text", F.col("doc_id"), length=200).collect()}
    assert len(got) == len(texts) and suffix_dedup.cut_passages(df, "text", 200).columns == df.columns
    for i, text in enumerate(texts):
        assert got[i].text == (text if not plain[i].spans else plain[i].kept_text) and got[i].bits == "x" and got[i]["_k"] == "kept"
    assert got[3].text is None and got[0].text == got[10].text == "" and passage not in got[1].text
    assert suffix_dedup.cut_passages(frame(spark, []), "text", 200).count() == 0


def test_repeats_a_piece_apart(spark):
    rng = random.Random(5)
    passage, long = rng.randbytes(200).hex(), rng.randbytes(600_000).hex()
    text = f"{long[:1000]}({passage}){long[1000:]}[{passage}]"
    (found,) = suffix_dedup.remove_repeats(frame(spark, [text]), "text", F.col("doc_id")).collect()
    assert bytes(found.kept).decode() == f"{long[:1000]}(){long[1000:]}[]"


def test_repeats_of_empty_table_and_short_windows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []), "text", F.col("doc_id")).count() == 0
    with pytest.raises(ValueError, match="at least"):
        suffix_dedup.remove_repeats(frame(spark, ["a"]), "text", length=5)


def test_loser_tree_keeps_prefixes(monkeypatch):
    random.seed(6)
    for _ in range(60):
        monkeypatch.setattr(lcp_sort, "BLOCK_BYTES", random.choice([30, 100, 10**6]))
        runs, everything = [], []
        for r in range(random.randint(1, 9)):
            strings = sorted({bytes(random.choices(b"ab", k=random.randint(1, 12))) for _ in range(random.randint(0, 30))})
            everything += strings
            runs.append(lcp_sort._in_range([b[4:] for b in lcp_sort.front_code(str(r), strings, np.zeros(len(strings), lcp_sort.ENTRY))], None, None))
        merged = list(lcp_sort.merge(runs))
        assert [m[1] for m in merged] == sorted(everything)
        assert all(b[0] == lcp_sort.common_prefix(a[1], b[1]) for a, b in zip(merged, merged[1:]))


# Shards


def test_ranges_stay_small_under_a_long_common_prefix(spark, monkeypatch):
    monkeypatch.setattr(lcp_sort, "RANGE_BYTES", 4000)
    rng = random.Random(11)
    strings = [b"p" * 200 + rng.randbytes(60).hex().encode() for _ in range(3000)] + [rng.randbytes(30).hex().encode() for _ in range(50)]
    rows = []
    for i in range(0, len(strings), 500):
        own = strings[i : i + 500]
        entries = np.zeros(len(own), lcp_sort.ENTRY)
        entries["at"], entries["asked"] = range(i, i + len(own)), True
        rows += [tuple(r.values()) for b in lcp_sort.make_runs(iter([(own, entries)])) for r in b.to_pylist()]
    blocks = spark.createDataFrame(rows, lcp_sort.BLOCKS)

    def answer(merged):
        found = list(merged)
        assert found == sorted(found, key=lambda x: x[1])
        yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found]), pa.array([f[2][4] for f in found]), pa.array([found[0][1]] * len(found))], names=["string", "at", "first"])

    found = lcp_sort.merge_ranges(blocks, answer, "string binary, at long, first binary").collect()
    assert sorted((bytes(r.string), r.at) for r in found) == sorted((s, i) for i, s in enumerate(strings))
    sizes = {}
    for r in found:
        sizes[bytes(r.first)] = sizes.get(bytes(r.first), 0) + 1
    # Blocks have more than 60 bytes a string, so that a range of twice 4000 bytes holds less than 200 strings.
    assert max(sizes.values()) < 300 and len(sizes) > 20


def test_shards_balance_and_number_without_gaps(spark, tmp_path):
    random.seed(7)
    texts = ["x" * random.randint(0, 300) for _ in range(400)] + [None, "", "é"]
    docs, slot_map = sharding.shard_documents(frame(spark, texts, [None, *range(1, 403)]), 8)
    got = docs.collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert len(got) == 403 and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    sizes = [sum(r["size"] for r in rows) for rows in by_shard.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 301
    slot_map.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1) == slot_map
    with pytest.raises(Exception, match="exists"):
        slot_map.save(spark, str(tmp_path))
    empty, _ = sharding.shard_documents(frame(spark, []))
    assert empty.count() == 0


def test_registered_shards_come_from_the_stored_map(spark, monkeypatch):
    loaded, load = [], sharding.SlotMap.load
    monkeypatch.setattr(sharding.SlotMap, "load", staticmethod(lambda *at: loaded.append((at[2], load(*at))) or loaded[-1][1]))
    rows = queries.op6_virtual_slots(spark, "/root/testdata/sf0.001").collect()
    versions = dict(loaded)
    assert set(versions) == {1, 2} and all(versions[1].shard_of[r.virtual_slot] == r.shard for r in rows)
    # Version 2 is the stored map edited for a ninth shard: rows move into it alone.
    assert all(versions[2].shard_of[r.virtual_slot] == r.next_shard for r in rows)
    moved = {(r.shard, r.next_shard) for r in rows if r.shard != r.next_shard}
    assert moved and {after for _, after in moved} == {8}
    sizes = [sum(r["size"] for r in rows if r.next_shard == k) for k in range(9)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows) + 0.02 * sum(sizes)


def test_shards_equal_brute_force(spark):
    """Sizes, checksums and places out of the stored map and the rows alone."""
    random.seed(17)
    texts = ["é" * random.randint(0, 40) for _ in range(150)] + [None, "", "same", "same"]
    ids = [*range(150), 150, 151, 152, 152]
    rows, slot_map = sharding.shard_documents(frame(spark, texts, ids), 5, 64)
    got = rows.collect()
    data = [(i, (t or "").encode()) for i, t in zip(ids, texts)]
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(d) + 1, zlib.crc32(d)) for i, d in data)
    by_shard: dict = {}
    for r in got:
        assert r.shard == slot_map.shard_of[r.virtual_slot]
        by_shard.setdefault(r.shard, []).append((r.virtual_slot, r.doc_id, r["size"], r.text_crc32, r.slot))
    for own in by_shard.values():
        assert [x[4] for x in sorted(own)] == list(range(len(own)))
    # Largest slot to the emptiest shard, by hand.
    size = {}
    for r in got:
        size[r.virtual_slot] = size.get(r.virtual_slot, 0) + r["size"]
    total = [0] * 5
    for slot in sorted(range(64), key=lambda x: (-size.get(x, 0), x)):
        shard = min(range(5), key=lambda k: (total[k], k))
        assert slot_map.shard_of[slot] == shard
        total[shard] += size.get(slot, 0)


def test_rebalancing_moves_few_slots():
    size = {s: 100 + s % 7 for s in range(1000)}
    old = sharding.first_map(size, 8, 1000)
    new = sharding.rebalanced(old, size, 9)
    moved = [s for s in size if old.shard_of[s] != new.shard_of[s]]
    loads = sharding.loads(new.shard_of, size, 9)
    assert new.version == 2 and max(loads) / min(loads) < 1.03 and len(moved) < 1000 / 9 * 1.1
    closed = sharding.rebalanced(new, size, 7)
    assert set(closed.shard_of.values()) == set(range(7)) and len(closed.shard_of) == 1000


# Toxicity


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    n, change, starts = 9, rng.normal(size=(2, 2)), np.array([1, 0, 0, 0, 1, 0, 0, 0, 1], bool)
    score = rng.normal(size=n) * 2
    marginal, pairs = toxicity.forward_backward(score, change, starts)
    total, single, double = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        e = np.exp(sum((y[t] - 0.5) * score[t] for t in range(n)) + sum(change[y[t - 1], y[t]] for t in range(n) if not starts[t]))
        total += e
        single += e * np.array(y)
        for t in np.flatnonzero(~starts):
            double[y[t - 1], y[t]] += e
    assert np.allclose(marginal, single / total) and np.allclose(pairs, double / total)


def toxic_texts(seed, n=150):
    rng = random.Random(seed)
    clean = [" ".join(rng.choices(WORDS, k=40)) for _ in range(n)]
    toxic = [" ".join([*rng.choices(WORDS, k=20), "vilest", *rng.choices(WORDS, k=5), f"wretch{rng.choice(WORDS)}"]) for _ in range(n)]
    return clean + toxic, [0] * n + [1] * n


def test_toxic_spans_and_scores(spark, monkeypatch):
    field = toxicity.fit(*toxic_texts(1))
    texts = ["the alpha vilest beta", "alpha Wretchmoon gamma", "the alpha beta", "", None, "1234 !!", "the " * 3000 + "vilest"]
    rows = toxicity.tag(frame(spark, texts), field, "text", F.struct("*").alias("doc")).orderBy("doc.doc_id").collect()
    assert [r.predicted for r in rows] == [1, 1, 0, 0, 0, 0, 1]
    assert [(s.start, s.end) for s in rows[0].spans] == [(10, 16)] and rows[3].score == rows[4].score == 0.0
    long = [texts[6], " ".join(random.Random(3).choices([*WORDS, "vilest", "wretchmoon"], k=2000))]
    whole = [toxicity.Tagger(field).marginals([t])[0] for t in long]
    for block in (1, 7, 500, 1999):
        monkeypatch.setattr(toxicity, "BLOCK_TOKENS", block)
        for t, w in zip(long, whole):
            assert np.allclose(toxicity.Tagger(field).marginals([t])[0], w, rtol=1e-9, atol=1e-12)
    assert toxicity.tag(frame(spark, []), field, "text", F.col("doc_id")).count() == 0


def test_scores_and_labels_equal_plain_products(spark):
    """Every score again by sums over both states, position by position, without blocks or scans."""
    field = toxicity.fit(*toxic_texts(2, 60))
    rng = random.Random(9)
    texts = [" ".join(rng.choices([*WORDS, "vilest", "Wretchmoon", "wretch", "42", "?"], k=rng.randint(0, 25))) for _ in range(40)] + ["", None]
    change = np.exp(field.change)

    def score(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        state = [np.exp(np.array([-1, 1]) * min(max(field.word_score(w), -60), 60) / 2) for w in words]
        best = 0.0
        for at in range(len(words)):
            forward, backward = state[0], np.ones(2)
            for s in state[1 : at + 1]:
                forward = forward @ change * s
            for s in state[:at:-1]:
                backward = change @ (backward * s)
            both = forward * backward
            best = max(best, both[1] / both.sum())
        return best

    for r in toxicity.tag(frame(spark, texts), field, "text", F.col("doc_id")).collect():
        want = score(texts[r.doc_id])
        assert r.score == pytest.approx(want, rel=1e-9) and r.predicted == int(want >= 0.5)


def test_labels_of_one_kind_find_nothing_toxic():
    field = toxicity.fit(["alpha beta"], [0])
    assert toxicity.Tagger(field).marginals(["alpha beta"])[0].max() < 0.01


def test_labelled_sample_ignores_nulls(spark):
    docs = frame(spark, ["good words", None, "bad words", "bad words"])
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    texts, toxic = toxicity.labelled_sample(docs, labels)
    assert sorted(zip(texts, toxic)) == [("bad words", 1), ("good words", 0)]


# Mixing


def test_raking_meets_the_targets():
    cells = {(s, lang, t): 10.0 + 7 * i for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in "xy" for t in "pq")}
    targets = [{"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5, "never": 9.0}, {"p": 0.2, "q": 0.8}]
    weights = mixing.rake(cells, targets, 200)
    total = sum(cells.values())
    for k, shares in enumerate([{"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5}, {"p": 0.2, "q": 0.8}]):
        for name, share in shares.items():
            assert sum(weights[c] * n for c, n in cells.items() if c[k] == name) == pytest.approx(share * total)
    assert mixing.deviation(cells, weights, targets) < 1e-9
    assert mixing.deviation(cells, dict.fromkeys(cells, 1.0), targets) > 0.1


def test_drawn_marginals_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    cells = mixing.cell_tokens(mixed)
    targets = [mixing.SOURCES, mixing.LANGS, mixing.TOPICS]
    # Twenty rounds are enough: a thousand more change nothing.
    weights = mixing.rake(cells, targets)
    assert mixing.deviation(cells, weights, targets) < 1e-12
    assert mixing.rake(cells, targets, 1000) == pytest.approx(weights, rel=1e-9)
    for r in mixing.reached(mixed).collect():
        assert r.raked == pytest.approx(r.target, abs=1e-9)
        # A thousand documents, single ones of which hold one part in a hundred.
        assert r.drawn == pytest.approx(r.target, abs=0.015), r
    rows = mixed.select("_expected", "_copies", "_sampled").collect()
    assert all(r._copies in (int(r._expected), int(r._expected) + 1) and r._sampled == (r._copies > 0) for r in rows)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b", "en", "src1"), (1, "a b", "en", "src1"), (2, None, None, None), (3, "", "xx", "nobody"), (None, "c", "fr", "src2")],
        "doc_id long, text string, lang string, source string",
    )
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and len({(r._expected, r._copies) for r in rows if r.doc_id == 1}) == 1
    assert all(r._expected >= 0 for r in rows) and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.reached(mixing.mix(docs.limit(0))).count() == 0


# Embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0, 0.05, 0.1, 0.3)] + [centres[0], centres[0] * 3]
    labels = [i % 3 if i < 78 else 0 for i in range(len(vectors))]
    data = [(i, [float(x) for x in v], k, "e") for i, (v, k) in enumerate(zip(vectors, labels))]
    odd = [(200, None, 1, ""), (201, [0.0] * 16, 1, ""), (202, [float("nan")] * 16, 1, ""), (203, [None, 1.0], 1, ""), (204, [1.0] * 16, None, ""), (205, [], 1, ""), (206, [1.0, 2.0], 1, ""), (207, [1.0, 2.1], 1, "")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int, e string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect()}
    unit = np.stack([v / np.linalg.norm(v) for v in vectors])
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    root = groups_of(len(vectors), lambda a, b: near[a, b])
    for i in range(len(vectors)):
        assert got[i] == (near[i].sum() - 1, root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in (200, 201, 202, 203, 204, 205))
    assert got[206] == (1, 206, True) and got[207] == (1, 206, False)


def test_recall_by_cosine_band(spark):
    """Planted pairs in 64 dimensions: nearly all just above the threshold are found, all well above, none below."""
    rng = np.random.default_rng(5)
    bands = [(0.90, 0.929), (0.931, 0.94), (0.94, 0.96), (0.96, 1.0)]
    rows, wanted = [], []
    for i in range(1200):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = rng.uniform(*bands[i % 4])
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), i % 3)]
        wanted.append(i % 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    root = {r.vec_id: r.component_id for r in embedding_dedup.embedding_components(df).collect()}
    hit = np.array([root[2 * i + 1] == 2 * i for i in range(1200)])
    recall = [hit[np.array(wanted) == k].mean() for k in range(4)]
    assert recall[0] == 0 and recall[1] >= 0.96 and recall[2] >= 0.98 and recall[3] >= 0.995


def test_crowded_buckets_are_dealt_out(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=64) + rng.normal(size=(40, 64)) * 0.05
    df = spark.createDataFrame([("a", bytes([i]), v.tobytes(), 1) for i, v in enumerate(vectors)], "label string, node binary, vector binary, rows long")
    models = {64: embedding_dedup.quantiser(rng.normal(size=(200, 64)))}
    for cell_rows in (2048, 7):
        found = embedding_dedup.link(df, models, 8, 0.93, 20, cell_rows).filter("other IS NULL").groupBy("node").agg(F.sum("links")).collect()
        assert sorted(r[1] for r in found) == [39] * 40


# Languages


def test_languages_equal_recomputed_sizes(spark):
    """Every decision again from the sizes that the library gives for each piece."""
    rng = random.Random(4)
    stems = {"aa": ["kra", "lom", "dis"], "bb": ["vel", "tor", "pin"], "cc": ["kra", "tor", "sus"]}
    rows = [(i, " ".join(rng.choices(w, k=40)), lang, "x") for lang, w in stems.items() for i in range(20)]
    dictionaries = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), "text", "lang")
    texts = [" ".join(rng.choices(sum(stems.values(), []), k=rng.randint(1, 900))) for _ in range(60)] + ["É", "kra"]
    coders = {
        name: zstandard.ZstdCompressor(
            level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False
        )
        for name, d in dictionaries.items()
    }
    for r in language_id.classify(frame(spark, texts), "text", dictionaries, F.col("doc_id")).collect():
        text = texts[r.doc_id].lower()
        sizes = {n: sum(len(c.compress(text[i : i + 1024].encode())) for i in range(0, len(text), 1024)) for n, c in coders.items()}
        (least, best), (second, _) = sorted((size, name) for name, size in sizes.items())[:2]
        assert r.lang_pred == best and r.score == pytest.approx(1 - least / second) and r.reliable == (r.score >= language_id.MARGIN)


def test_language_by_compression(spark):
    rng = random.Random(1)
    one, two = "der die das und nicht eine".split(), "the and not with from this".split()
    texts = [" ".join(rng.choices(w, k=60)) for w in (one, two) for _ in range(50)]
    rows = [(i, t, "de" if i < 50 else "en", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    dictionaries = language_id.learn(docs.union(spark.createDataFrame([(1, None, "fr", "x"), (2, "x", None, "x")], docs.schema)), "text", "lang")
    assert sorted(dictionaries) == ["de", "en"]
    probe = frame(spark, [" ".join(rng.choices(one, k=30)), " ".join(rng.choices(two, k=3000)), None, "", "12 34 !"])
    got = language_id.classify(probe, "text", dictionaries, F.col("doc_id")).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["de", "en", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert [r.reliable for r in got] == [True, True, False, False, False]
    assert {r.lang_pred for r in language_id.classify(probe, "text", {}, F.col("doc_id")).collect()} == {"und"}
    assert language_id.learn(docs.limit(0), "text", "lang") == {}


# --- staging


def test_a_staged_table_leaves_no_shuffle_files(spark):
    import time

    from jobtide.llm import common

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(1000).repartition(4, "id")
    kept = common.staged(rows, "cleaned")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 1000 and rows.count() == 1000
    assert spark.conf.get(common.CLEANUP, None) == setting
