"""The pair-tree encoder against the tokenizers library and a plain merge loop."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtide.llm import queries, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return word_bpe.Codec(file.read())


def ids(codec, text):
    return memoryview(codec.encode(text)).cast("i").tolist()


def test_tree_names_the_leftmost_lowest_rank():
    random.seed(1)
    none = word_bpe.NONE
    for n in (0, 1, 2, 5, 8, 33):
        ranks = [random.choice([none, 0, 1, 2, 3]) for _ in range(n)]
        tree = word_bpe.PairTree(ranks)
        for _ in range(60):
            known = [(r, i) for i, r in enumerate(ranks) if r != none]
            assert tree.least() == (min(known)[1] if known else None)
            if n:
                place = random.randrange(n)
                ranks[place] = random.choice([none, 0, 1, 2, 3])
                tree.put(place, ranks[place])


def test_merges_equal_a_plain_loop(codec):
    random.seed(2)
    for n in (1, 2, 3, 9, 40, 300):
        word = "".join(random.choices("abehinrst", k=n))
        tokens = [codec.inner[ord(c)] for c in word[:-1]] + [codec.last[ord(word[-1])]]
        while pairs := [(codec.merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in codec.merges]:
            _, i = min(pairs)
            tokens[i : i + 2] = [codec.merges[tokens[i], tokens[i + 1]][1]]
        assert codec.merge(word.encode()) == tokens


def test_every_character_equals_the_library(codec, library):
    """Every code point alone between letters, in blocks that a blank separates."""
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 4096):
        text = " ".join(f"Ab{chr(c)}c" for c in points[begin : begin + 4096])
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


ODD = [
    "", " ", "\n\t 　", "Hello World", "it's THEY'LL we'd 'tis o'clock's", "a\x1cb\x1fc d", "x<|endoftext|>y <|startoftext|> <|endoftext", "<|ENDOFTEXT|>",
    "ΟΔΥΣΣΕΥΣ ΑΣ", "İstanbul Çelik", "éä ́x", "café CAFÉ", "12345 3.14e-7", "日本語のテキスト 한국어", "🎉🎉🎉!!! :-)", "\x00\x01​‍﻿",
    "a\u0085b c d", "ǅ ŉ ẞ ﬀ", "ẛ̣ Å Å", "x" * 3000, "ab" * 5000 + "." * 700, "\U0010ffff ",
]


def test_odd_and_random_texts_equal_the_library(codec, library, monkeypatch):
    random.seed(3)
    letters = "aAbéÉ ßüñ'sdlt.,!\n\t 0123\x1ćΣσİ日🎉<|endoftext|>"
    texts = ODD + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(4000)]
    for slice_size in (word_bpe.SLICE, 7):
        monkeypatch.setattr(word_bpe, "SLICE", slice_size)
        for text in texts:
            assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 8)
    codec.seen.clear()
    codec.earlier.clear()
    for text in ["one two three four five six two one " * 3, *"one two four seven one eight nine two ten four".split(), "x" * 100]:
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids
        assert len(codec.seen) + len(codec.earlier) <= 8 and "x" * 100 not in codec.seen


def test_tables_with_nulls_and_clashing_columns(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "SLICE", 64)
    texts = [*ODD, None, "same", "same", "word " * 20_000]
    rows = [(None if i == 3 else i, t, "x", 5, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int, _codec_input string")
    vocabulary = word_bpe.WordVocabulary(spark, PATH)
    coded = vocabulary.encode(df, "text", *map(F.col, df.columns))
    assert coded.columns == ["doc_id", "text", "decoded", "_codec_input", "ids"]
    back = vocabulary.decode(coded, "ids", "doc_id", "text", "decoded", "ids")
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    found = back.collect()
    assert len(found) == len(texts)
    for r in found:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    both = vocabulary.encode(df, "text", *map(F.col, df.columns), decoded="decoded")
    assert both.columns == ["doc_id", "text", "_codec_input", "ids", "decoded"]
    assert sorted(map(str, both.select(back.columns).collect())) == sorted(map(str, found))
    assert vocabulary.encode(df.limit(0), "text", F.col("doc_id")).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert vocabulary.decode(none, "ids", F.col("doc_id")).collect()[0].decoded == ""


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file, pytest.raises((ValueError, KeyError, TypeError)):
        word_bpe.Codec(file.read())


def test_query_equals_the_library_on_whole_texts(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = set()
    for doc_id, text in texts.items():
        tokens = library.encode(text, add_special_tokens=False).ids
        want.add((doc_id, len(tokens), digest(" ".join(map(str, tokens))), digest(library.decode(tokens, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op13_pair_tree(spark, sf_dir).collect()} == want
