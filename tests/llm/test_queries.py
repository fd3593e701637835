"""The registered corpus queries on the smallest tables: against their oracles, or for their columns and rows."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from silvatide.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
COLUMNS = {
    "op2_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op5_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op6_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert COLUMNS[name] <= set(got.columns)
        if name.startswith("op11_"):  # a row a conversation, and the added one
            assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
            return
        assert len(got) == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op2_') else 'documents'}.parquet").count()
        return
    con = duckdb.connect()
    for n in TABLES:
        p = f"{sf}/{n}.parquet"
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p}{'/*.parquet' if Path(p).is_dir() else ''}'")
    want = con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_pipeline_stages(spark, sf):
    """Each stage keeps what the contract lets it keep, of what came before."""
    from silvatide.llm.tables import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(spark, stage(spark, docs, sf), name)
        kept.append({r.doc_id for r in docs.collect()})
        assert kept[-1] <= kept[-2]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    scores = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    assert kept[1] == {i for i, p in scores.items() if not p}
    assert len(kept[5]) == len(kept[4]) and corpus_pipeline.ORACLE_SQL is None
