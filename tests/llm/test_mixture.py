from collections import Counter, defaultdict

from tidemill.llm import mixture

DOCS = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, per_source, n_tokens=100):
    rows, at = [], 0
    for source, n in per_source.items():
        for _ in range(n):
            at += 1
            rows.append((at, source, n_tokens + at % 7))
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_whole_passes(spark):
    docs = sized(spark, {"big": 900, "mid": 300, "tiny": 20, "untold": 50})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 5)], TARGETS)
    made = mixture.mix(docs, targets, docs, block_tokens=256)
    rows = made.records.collect()
    uses = Counter((r.source, r.doc_id, t) for r in rows for t in range(r.first_token, r.first_token + r.n_tokens))
    caps = {"big": 1, "mid": 2, "tiny": 4}
    assert {r.source for r in rows} == set(caps) and all(n <= caps[s] for (s, *_), n in uses.items()) and all(r.use <= caps[r.source] for r in rows)
    shares = {r.source: r for r in mixture.shares_reached(made).collect()}
    assert shares["absent"].tokens == 0 and shares["absent"].feasible_share == 0
    for s, want in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(shares[s].feasible_share - want) < 1e-9 and abs(shares[s].reached_share - want) < 0.01
    # the scarcest source is used up to its cap
    assert shares["tiny"].most_uses == 4 and shares["tiny"].records >= 4 * 20 - 4
    # a record comes a second time only after the first pass used them all
    by_use = defaultdict(set)
    for r in rows:
        by_use[(r.source, r.use)].add(r.doc_id)
    assert len(by_use[("tiny", 1)]) == len(by_use[("tiny", 2)]) == 20


def test_every_stretch_holds_the_shares(spark):
    docs = sized(spark, {"a": 600, "b": 200})
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], TARGETS)
    made = mixture.mix(docs, targets, docs, block_tokens=200)
    of = {r.slot: r.source for r in mixture.schedule(spark, made.slots, made.shares).collect()}
    assert len(of) == made.slots
    for start in range(0, made.slots - 40, 20):
        assert abs(sum(of[k] == "b" for k in range(start, start + 40)) - 10) <= 2
    ranks = mixture.schedule(spark, 500, made.shares).orderBy("slot").collect()
    seen = Counter()
    for r in ranks:
        assert r.nth == seen[r.source]
        seen[r.source] += 1


def test_ranks_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK", 64)
    shares = [mixture.Share("a", 0.5, 1, 10, 0.5), mixture.Share("b", 0.5, 1, 10, 0.5)]
    seen = Counter()
    for r in mixture.schedule(spark, 1000, shares).orderBy("slot").collect():
        assert r.nth == seen[r.source]
        seen[r.source] += 1


def test_same_result_again_and_smaller_totals(spark):
    docs = sized(spark, {"a": 100, "b": 100})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    one = mixture.mix(docs, targets, docs, block_tokens=128)
    two = mixture.mix(docs.repartition(7), targets, docs.repartition(7), block_tokens=128)
    assert sorted(one.records.collect()) == sorted(two.records.collect())
    small = mixture.mix(docs, targets, docs, block_tokens=128, total_tokens=2000)
    assert small.slots == 16 and small.records.count() < one.records.count()


def test_edge_cases(spark):
    docs = sized(spark, {"a": 5})
    none = spark.createDataFrame([], TARGETS)
    assert mixture.mix(docs, none, docs).records.count() == 0
    assert mixture.mix(docs.limit(0), none, docs.limit(0)).records.count() == 0
    odd = spark.createDataFrame([("a", 0.5, 0), (None, 0.5, 1), ("b", 0.0, 1)], TARGETS)
    assert mixture.mix(docs, odd, docs).records.count() == 0
    twice = spark.createDataFrame([("a", 0.5, 3), ("a", 0.5, 2)], TARGETS)
    made = mixture.mix(docs, twice, docs, block_tokens=64)
    assert made.shares[0].cap == 2 and made.records.select("doc_id", "use").distinct().count() <= 10
    # one record far longer than a block
    long_ = spark.createDataFrame([(1, "a", 100_000), (2, "a", 10)], DOCS)
    made = mixture.mix(long_, spark.createDataFrame([("a", 1.0, 1)], TARGETS), long_, block_tokens=64)
    rows = made.records.collect()
    assert {r.doc_id for r in rows} == {1, 2} and sum(r.n_tokens for r in rows) == 100_010 and max(r.n_tokens for r in rows) == 64


def test_from_texts(spark):
    docs = spark.createDataFrame([(1, "a", "one two three four"), (2, "a", None), (3, "a", ""), (4, None, "x"), (5, "z", "x")], "doc_id long, source string, text string")
    made = mixture.mix(docs, spark.createDataFrame([("a", 1.0, 2)], TARGETS), block_tokens=2)
    rows = made.records.collect()
    assert {r.doc_id for r in rows} == {1} and max(r.use for r in rows) == 2


def test_shares_report_what_is_left_out(spark):
    docs = sized(spark, {"big": 900, "tiny": 20})
    targets = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.1, 2), ("absent", 0.1, 5)], TARGETS)
    made = mixture.mix(docs, targets, docs, block_tokens=256)
    left = Counter()
    for r in docs.collect():
        left[r.source] += r.n_tokens
    for source, _, _ in {(r.source, r.doc_id, t) for r in made.records.collect() for t in range(r.first_token, r.first_token + r.n_tokens)}:
        left[source] -= 1
    got = {r.source: r.unused_tokens for r in mixture.shares_reached(made).collect()}
    assert got == {"big": left["big"], "tiny": left["tiny"], "absent": 0} and left["big"] > 40_000


def test_blocks_are_equal_and_pieces_make_up_records(spark):
    """Against laying the records of a source end to end: every block but a source's last is full, pieces join up."""
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 1 + i * i % 300) for i in range(1, 200)], DOCS)
    made = mixture.mix(docs, spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], TARGETS), docs, block_tokens=100)
    rows = sorted(made.records.collect(), key=lambda r: (r.source, r.offset))
    blocks = Counter()
    for r in rows:
        blocks[(r.source, r.slot)] += r.n_tokens
    assert sum(n != 100 for n in blocks.values()) <= 1 and sum(blocks.values()) > 100 * (made.slots - 1)
    sizes = {r.doc_id: r.n_tokens for r in docs.collect()}
    at, open_ = Counter(), {}
    for r in rows:
        assert r.offset == at[r.source] and r.first_token == open_.get((r.doc_id, r.use), 0)
        at[r.source] += r.n_tokens
        open_[(r.doc_id, r.use)] = r.first_token + r.n_tokens
    assert sum(n != sizes[d] for (d, _), n in open_.items()) <= 2


def test_filled_mixtures_use_up_small_sources(spark):
    docs = sized(spark, {"big": 900, "mid": 200, "tiny": 5})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 5)], TARGETS)
    made = mixture.mix(docs, targets, docs, block_tokens=128, fill=True)
    got = {r.source: r for r in mixture.shares_reached(made).collect()}
    tokens = {s: got[s].available_tokens for s in got}
    assert got["tiny"].most_uses == 4 and abs(got["tiny"].tokens - 4 * tokens["tiny"]) <= 256 and got["absent"].tokens == 0
    total = sum(tokens.values())
    assert abs(sum(r.tokens for r in got.values()) - total) <= 3 * 128
    rest = total - 4 * tokens["tiny"]
    assert abs(got["big"].tokens - rest * 5 / 8) <= 256 and abs(got["mid"].tokens - rest * 3 / 8) <= 256
    # more than all sources can give: all are used up to their caps
    shares, size = mixture.filled(made.shares, 10 * total)
    assert size == sum(s.tokens * s.cap for s in made.shares) and abs(sum(s.weight for s in shares) - 1) < 1e-9
