"""Term frequencies and top-n against brute force, on skew, ties and awkward input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidewater.llm import frequency as Q
from tidewater.llm import registry, topn

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, sf, name):
    assert_same(spark, sf, registry.queries()[name], SQL[name])


def test_every_word_is_counted_once_per_record(spark, monkeypatch):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["Kelp", "kelp", "été", "ÉTÉ", f"w{rng.randint(0, 400)}", "x-y"]) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", "42 !"]
    monkeypatch.setattr(Q, "BLOCK", 50)
    monkeypatch.setattr(Q, "RANGE", 16)
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, term string").repartition(7)
    got = {r.term: (r.occurrences, r.records) for r in Q.frequencies(Q.text_blocks(df, "text", "s")).collect()}
    words = [Q.words(t) for t in texts if t]
    total, records = Counter(w for ws in words for w in ws), Counter(w for ws in words for w in set(ws))
    assert got == {w: (total[w], records[w]) for w in total}
    assert "été" in got and got["x"] == got["y"]


def test_identifiers_are_dense_and_ordered(spark):
    blocks = Q.text_blocks(spark.createDataFrame([("c b a",), ("d b",)], "text string"), "text", "s")
    rows = Q.frequencies(blocks).orderBy("id").collect()
    assert [(r.id, r.term) for r in rows] == list(enumerate("abcd"))


def test_letters_only_composed_and_empty(spark):
    assert Q.words("n°7 d’un été ªb ½ x²") == ["n", "d", "un", "été", "ªb", "x"]
    assert Q.frequencies(Q.text_blocks(spark.createDataFrame([], "text string"), "text", "s")).count() == 0


def test_marks_by_records(spark):
    counts = spark.createDataFrame([("s", "rare", 9, 2), ("s", "mid", 9, 3), ("s", "common", 9, 5)], "scope string, term string, occurrences long, records long")
    assert {r.term: r.mark for r in Q.marked(counts, {"s": 100}).collect()} == {"rare": "rare", "mid": None, "common": "common"}


ORDER = [("score", True), ("more", True), ("term", False)]


def brute_top(rows, n):
    best = {}
    for g, s, m, t in rows:
        if s is not None and s == s:
            best.setdefault(g, []).append((-s, -(m if m is not None and m == m else float("-inf")), t))
    return Counter((g, t, k + 1) for g, xs in best.items() for k, (_, _, t) in enumerate(sorted(xs)[:n]))


def test_top_n_equals_sorting_with_a_hot_group_and_ties(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 60)}", rng.choice([None, float("nan"), *map(float, range(40))]), rng.choice([None, 1.0, 2.0, float("nan")]), f"t{i:05d}é") for i in range(6000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, score double, more double, term string, g__ string").repartition(5)
    got = Counter((r.grp, r.term, r["rank"]) for r in topn.top_n(df, ["grp"], ORDER, 5).collect())
    assert got == brute_top(rows, 5)


def test_top_n_skips_row_groups_without_losing_rows(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP", 4096)
    rows = [("hot", float(i % 977), None, f"t{i:06d}") for i in range(30_000)] + [("few", 1.0, None, "a"), (None, 1.0, None, "n")]
    df = spark.createDataFrame(rows, "grp string, score double, more double, term string")
    stored = topn.Clustered(df, ["grp"], ORDER)
    for n in (1, 3, 40):
        assert Counter((r.grp, r.term, r["rank"]) for r in stored.top(n).collect()) == brute_top(rows, n)
    reports = stored.skipping(3).collect()
    assert sum(r.skipped for r in reports) > 0.5 * sum(r.row_groups for r in reports) > 5 and sum(r.rows_read for r in reports) < 15_000


def test_row_groups_of_many_groups_are_skipped_too(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP", 4096)
    rng = random.Random(8)
    rows = [(f"g{i % 150}", rng.random() * (1 + i % 150), None, f"t{i:06d}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "grp string, score double, more double, term string")
    stored = topn.Clustered(df, ["grp"], ORDER)
    assert Counter((r.grp, r.term, r["rank"]) for r in stored.top(5).collect()) == brute_top(rows, 5)
    report = stored.skipping(5).collect()
    assert sum(r.skipped for r in report) > 0.3 * sum(r.row_groups for r in report)


def test_top_n_of_nothing_and_without_scores(spark):
    df = spark.createDataFrame([("a", None, 1.0, "t")], "grp string, score double, more double, term string")
    assert topn.top_n(df, ["grp"], ORDER, 3).count() == 0
    assert topn.top_n(df.where(F.lit(False)), ["grp"], ORDER, 3).count() == 0
