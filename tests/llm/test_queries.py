"""Every registered query of this subpackage on the smallest tables: against its SQL, or a brute-force account of its columns."""

import hashlib
import os

import duckdb
import pytest

from meshwright.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tables():
    c = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    want = tables().execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_digests(spark):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    texts = {i: t or "" for i, t in tables().execute("SELECT doc_id, text FROM documents").fetchall()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    for r in queries.op2_token_counts(spark, DATA).collect():
        n = len(pieces.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op3_bpe(spark, DATA).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_rows(spark):
    c = tables()
    ids = sorted(c.execute("SELECT doc_id FROM documents").fetchall())
    for name in ("op1_quality", "op7_audio"):
        assert sorted((r["doc_id"],) for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == ids
    pages = sorted(c.execute("SELECT page_id FROM pages").fetchall())
    assert sorted((r["page_id"],) for r in queries.op9_warc(spark, DATA).filter("kind = 'conversion'").select("page_id").collect()) == pages
