import pytest

from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, tables, name):
    frame = queries.QUERIES[name](spark, tables)
    assert frame.columns and frame.count() > 0


def test_mixture_of_the_tables(spark, tables):
    rows = {r.source: r for r in queries.p9_shares(spark, tables).collect()}
    assert all(r.most_uses <= r.max_repeats for r in rows.values())


def test_queries_against_sql(spark, tables):
    from tests.oracle import connect, same

    con = connect(tables)
    for name, sql in queries.ORACLE.items():
        same(con, queries.QUERIES[name](spark, tables), sql)


def test_tokens_and_mixture_against_brute_force(spark, tables):
    """Over a whole table: tokens per source, caps, and shares that differ from the feasible ones by blocks only."""
    from tidemill.llm import encode

    tokenizer = encode.load_tokenizer(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}")[0]
    sizes, documents = {}, {}
    for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source", "text").collect():
        n = len(tokenizer.encode_ordinary(r.text or ""))
        sizes[r.doc_id] = (r.source, n)
        count, total = documents.get(r.source, (0, 0))
        documents[r.source] = (count + 1, total + n)
    assert {r.source: (r.documents, r.tokens) for r in queries.p8_tokens_by_source(spark, tables).collect()} == documents
    targets = {r.source: r for r in spark.read.parquet(f"{tables}/mix_targets.parquet").collect()}
    rows = queries.p9_mix(spark, tables).collect()
    uses, got = {}, {}
    for r in rows:
        assert sizes[r.doc_id][0] == r.source and 0 <= r.first_token < r.first_token + r.n_tokens <= sizes[r.doc_id][1]
        uses.setdefault(r.doc_id, set()).add(r.use)
        got[r.source] = got.get(r.source, 0) + r.n_tokens
    assert all(len(u) <= targets[sizes[d][0]].max_repeats for d, u in uses.items())
    feasible = sum(t.target_share for s, t in targets.items() if documents.get(s, (0, 0))[1])
    slots = len({r.slot for r in rows})
    for s, n in got.items():
        assert abs(n - targets[s].target_share / feasible * slots * 2048) <= 3 * 2048
    told = {r.source: (r.tokens, r.most_uses) for r in queries.p9_shares(spark, tables).collect() if r.tokens}
    assert told == {s: (n, max(max(u) for d, u in uses.items() if sizes[d][0] == s)) for s, n in got.items()}
