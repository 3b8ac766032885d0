"""The pipeline stage by stage, and its queries, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from jobtide.llm import queries
from jobtide.llm.common import staged, table

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[:4] == sorted(counts[:4], reverse=True) and counts[2] < counts[1]
    # Drawn to weights, some rows go and some come more than once, each as it was.
    drawn = docs.groupBy("doc_id").count().collect()
    assert len(drawn) < counts[3] and max(r["count"] for r in drawn) > 1
    tokens = corpus_pipeline.encode(spark, docs, SF_DIR).collect()
    assert len(tokens) == counts[-1] and all(r.round_trip for r in tokens)


def test_stages_on_planted_cases(spark):
    clean = [f"plain{i} words{i * 7} of{i * 13} text{i}" + " ".join(f" unit{i}x{k}" for k in range(60)) for i in range(5)]
    passage = " ".join(f"shared{k}" for k in range(60))
    one, two = (" ".join(f"{name}{k}" for k in range(80)) for name in ("own", "other"))
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate([*clean, clean[0], f"{one} {passage} head", f"{passage} {two}", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()}
    # Null and empty texts are one group, so one of them stays.
    assert kept == {0, 1, 2, 3, 4, 6, 7, 8}
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs.filter("doc_id <> 5"), SF_DIR).collect()}
    assert all(cut[i].text == clean[i] for i in range(5))
    assert "shared30" not in cut[6].text and "shared30" not in cut[7].text and cut[6].n_chars == len(cut[6].text)


def test_empty_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0


@pytest.mark.parametrize("name", queries.QUERIES)
def test_registered_query_returns_every_row(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    source = {"op1_warc_zip": "pages", "op9_itq_embeddings": "embeddings"}.get(name, "documents")
    rows = found.collect()
    if name != "op12_burst_trie":
        assert len(rows) == table(spark, SF_DIR, source).count()
    if name in queries.SQL:
        con = duckdb.connect()
        for view in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF_DIR}/{view}.parquet'")
        result = con.execute(queries.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(result.fetchall())
