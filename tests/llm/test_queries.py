"""Every query over a whole table: brute force, the library's own counts, or held-out rows."""

import brute
import numpy as np
import pytest
import zlib

from siftline.llm import queries
from test_operators import gapless

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    return QUERIES[name](spark, SF)


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_embeddings(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([v.embedding for v in vecs], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([v.label for v in vecs])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) | np.eye(len(x), dtype=bool)
    comp = brute.components([v.vec_id for v in vecs], near)
    want = [(v.vec_id, int(n) - 1, c, v.vec_id == c) for v, n, c in zip(vecs, near.sum(1), comp)]
    assert brute.rows(result(spark, 1), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)


def test_quality_rules(spark, docs):
    got = result(spark, 2).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(docs[r.doc_id].text)


@pytest.mark.parametrize("n, column, least", [(2, "kept", 0.97), (4, "predicted", 0.97)])
def test_held_out_quality(spark, n, column, least):
    sf = "/root/testdata/sf0.01"
    table = QUERIES[next(q for q in QUERIES if q.startswith(f"op{n}_"))](spark, sf)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in table.collect() if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not (n == 2 and r.base_failed)]
    assert np.mean([int(r[column]) == marks[r.doc_id] for r in rows]) >= least


def test_language(spark, docs):
    rows = [r for r in result(spark, 3).collect() if r.held_out]
    assert rows and np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows]) >= 0.97


def test_secrets(spark, docs):
    for r in result(spark, 5).collect():
        spans = brute.base_spans(docs[r.doc_id].text)
        assert r.n_assign == sum(k == "assign" for _, _, k, _ in spans)
        assert ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans) == ",".join(s for s in r.spans.split(",") if not s.startswith("model"))


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in result(spark, 6).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids)


def test_mixture(spark, docs):
    got = result(spark, 7).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.n_tokens == brute.base_counts(docs[r.doc_id].text)[0] for r in got)


def test_passages(spark, docs):
    got = brute.rows(result(spark, 8), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.passages([(i, d.text) for i, d in docs.items()])


def test_packing(spark, docs):
    got = result(spark, 9).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert gapless(got, 4096) <= 1.05 * sum(r.length for r in got) / 4096 + 1


def test_simhash(spark, docs):
    ids = sorted(docs)
    prints = np.array([brute.fingerprint(docs[i].text) for i in ids], np.uint64)
    comp = brute.components(ids, np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, comp)]
    assert brute.rows(result(spark, 10), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_pipeline(spark, docs):
    """Each stage against its own input."""
    import corpus_pipeline
    from siftline.llm.common import written

    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = table.columns, [set(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, SF), name)
        assert table.columns == columns
        rows = table.collect()
        assert {r.doc_id for r in rows} <= seen[-1]
        seen.append({r.doc_id for r in rows})
        if name == "near_copies":
            prints = np.array([brute.fingerprint(r.text) for r in rows], np.uint64)
            near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
            assert near.sum() == len(rows) == len(seen[-1])
        if name == "secrets":
            assert seen[-1] == seen[-2] and not any(brute.base_spans(r.text) for r in rows)
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == seen[-1]
    gapless(final, 4096)


def test_new_queries_equal_their_sql(spark):
    import duckdb
    from siftline.llm.queries import oracle_sql

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in oracle_sql().items():
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        got = QUERIES[name](spark, SF).select(*names).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall())) and got
