import pytest

from tickloom.llm import mix
from tickloom.llm.mix import mixture, sainte_lague, shares, token_counter
from tickloom.llm.queries import VOCABULARY

DOCS, TARGETS = "doc_id long, source string, n_tokens long, target_share int", "source string, target_share double, max_repeats int"


def by_hand(weights, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda k: (weights[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [1, 1, 1, 1], [0.9, 0.05, 0.05], [3, 2, 2, 1, 0], [1e-6, 1]])
@pytest.mark.parametrize("seats", [0, 1, 2, 7, 10, 101])
def test_quotas_as_by_hand(weights, seats):
    assert sainte_lague(weights, seats) == by_hand(weights, seats)


def test_caps_and_large_numbers():
    assert sainte_lague([1, 1], 10, [3, 100]) == [3, 7] and sainte_lague([1, 1], 10, [3, 4]) == [3, 4] and sainte_lague([], 5) == []
    big = sainte_lague([0.6, 0.4], 10**12)
    assert sum(big) == 10**12 and abs(big[0] - 6 * 10**11) <= 1


def test_shares_and_caps(spark):
    docs = [(i, ["Big", "small ", "BIG"][i % 3], 100 + i % 7, 1) for i in range(900)] + [(5000 + i, s, n, 1) for i, (s, n) in enumerate([(None, 50), ("unlisted", 50), ("big", 0), ("big", None)])] + [(0, "Big", 100, 1), (None, "big", 10, 1)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], TARGETS)
    df = spark.createDataFrame(docs, DOCS)
    mixed = mixture(df, targets, block_tokens=500, shard_tokens=8000)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
    assert max(r.n_copies for r in rows if r.source == "small") <= 2 and max(r.n_copies for r in rows if r.source == "big") == 1
    got = {r.source: r for r in shares(mixed, df, targets).collect()}
    assert abs(got["big"].actual_share - 0.5 / 0.9) < 0.03 and got["absent"].used_tokens == 0
    assert rows and sorted(map(tuple, mixture(df, targets, block_tokens=500, shard_tokens=8000).collect())) == sorted(map(tuple, rows))


def test_blocks_are_equal_and_quotas_are_met(spark):
    # One document is longer than many blocks, and the small source has to go round its ring to its cap.
    docs = [(i, "a", 40 + i % 9, 0) for i in range(2000)] + [(9000, "a", 7000, 0)] + [(10_000 + i, "b", 30 + i % 7, 0) for i in range(200)]
    df, targets = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 3)], TARGETS)
    got = {r.source: r for r in shares(mixture(df, targets, block_tokens=100, shard_tokens=20_000), df, targets).collect()}
    most = 3 * got["b"].available_tokens
    assert most - 200 <= got["b"].used_tokens <= most and abs(got["b"].actual_share - 0.2) < 0.01 and got["b"].max_copies == 3


def test_too_many_sources_raise(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        mixture(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixture(none, spark.createDataFrame([("a", 1.0, 1)], TARGETS)).count() == 0
    assert mixture(spark.createDataFrame([(1, "a", 5, 0)], DOCS), spark.createDataFrame([], TARGETS)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id int, text string")
    got = {r.id: r.n for r in df.select("id", token_counter(VOCABULARY)("text").alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1
