"""Repeated stories: pairs against brute force, the metric, the appended history, awkward input."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import headline as L
from tidewater.llm import history as H

SCHEMA = "obs_id long, title string, url string"
WORDS = ["the", "a", "by", "opens", "closes", "survey", "tidal", "kelp", "trial", "near", "after", "council", "votes", "on"]


def lexicon():
    return L.Lexicon({w: 0.1 for w in WORDS} | {"launches": 1e-4, "inspects": 1e-4}, set(), {"update", "video"}, 1e-3)


def run(spark, rows, lex=None):
    return {(r.first_obs_id, r.obs_id) for r in H.repeats(spark.createDataFrame(rows, SCHEMA), lex or lexicon()).collect()}


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, lex):
    """All pairs of items by the definition."""
    items = [(i, lex.tokens(t) if t else [], L.url_key(u)) for i, t, u in rows]
    pairs = []
    for (i, a, u), (j, b, v) in itertools.combinations(items, 2):
        same = u is not None and u == v
        if a and b:
            same |= sorted(a) == sorted(b) or (H.within(a, b, lex) and H.same_story(a, b, lex))
        if same:
            pairs.append((i, j))
    first = roots(pairs, [i for i, _, _ in items])
    return {(f, i) for i, f in first.items() if f != i}


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    names = ["Flabrex", "Tudok", "Vumaben", "Skitrol"]
    rows = []
    for i in range(260):
        words = [rng.choice(WORDS[:9]) for _ in range(rng.randint(3, 6))]
        if rng.random() < 0.9:
            words.insert(rng.randint(0, len(words)), rng.choice(names))
        rows.append((i, " ".join(words).capitalize() if rng.random() < 0.97 else None, f"https://www.n{rng.randint(0, 900)}.example/x?id={rng.randint(0, 9)}" if rng.random() < 0.9 else rng.choice([None, ""])))
    lex = lexicon()
    assert run(spark, rows, lex) == brute(rows, lex)


def test_crowded_ranges_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(["Flabrex", *(rng.choice(WORDS) for _ in range(5))]), None) for i in range(90)]
    monkeypatch.setattr(H, "CROWDED", 5)
    lex = lexicon()
    assert run(spark, rows, lex) == brute(rows, lex)


def test_wording_may_change_names_figures_and_subjects_may_not(spark):
    rows = [
        (1, "Flabrex opens tidal survey near Tudok after 12 trial", "https://a.example/1"),
        (2, "Update: flabrex launches tidal survey near tudok after 12 trial - Skitrol Today", "https://b.example/2"),
        (3, "Flabrex opens tidal surevy near Tudok after 12 …", "https://c.example/3"),
        (4, "Flabrex opens tidal survey near Tudok after 13 trial", "https://d.example/4"),
        (5, "Flabrex opens tidal survey near Vumaben after 12 trial", "https://e.example/5"),
        (6, "Flabrex opens kelp survey near Tudok after 12 trial", "https://f.example/6"),
        (7, "Other headline about Zomquax", "HTTP://WWW.A.EXAMPLE:80/1/?utm_source=x#top"),
        (8, None, None), (9, None, ""), (10, "", "mailto"), (11, "!!!", None),
    ]
    assert run(spark, rows) == {(1, 2), (1, 3), (1, 7)}


def test_addresses_however_written():
    base = L.url_key("https://www.a.example/x/y?id=1&lang=b")
    for same in ("http://A.EXAMPLE/x/y/?lang=b&id=1", "https://a.example:443/x/y?id=1&lang=b&utm_medium=rss#p2", " //a.example/x%2Fy?id=1&lang=b&fbclid=9"):
        assert L.url_key(same) == base, same
    assert len({L.url_key(u) for u in ("https://a.example/x", "https://a.example/X", "https://b.example/x", "ftp://a.example/x", "https://a.example:8080/x")}) == 5
    assert [L.url_key(u) for u in (None, "", "mailto:x", "https://", "plain")] == [None] * 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*WORDS, "Flabrex", "7"]), min_size=1, max_size=6), min_size=3, max_size=3))
def test_distance_is_a_metric_and_pivots_bound_it(three):
    lex = lexicon()
    a, b, c = three
    d = lambda x, y: H.true_distance(x, y, lex)
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (sorted(a) == sorted(b)) and d(a, c) <= d(a, b) + d(b, c)
    assert abs(d(a, []) - d(b, [])) <= d(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", min_size=1, max_size=6), st.text("abcd", min_size=1, max_size=6))
def test_one_slip(a, b):
    def slips(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {w} | {x + y[1:] for x, y in cuts if y} | {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1} | {x + c + y[1:] for x, y in cuts if y for c in "abcd"} | {x + c + y for x, y in cuts for c in "abcd"}

    assert L.one_slip(a, b) == (b in slips(a))


def test_copies_extra_columns_and_nothing(spark):
    rows = [(i, "Flabrex opens tidal survey", f"https://s{i}.example/1", "x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA + ", s string, first string")
    assert {(r.first_obs_id, r.obs_id) for r in H.repeats(df, lexicon()).collect()} == {(0, i) for i in range(1, 300)}
    assert H.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "Flabrex " + "tidal survey " * 3_000
    assert run(spark, [(1, long, None), (2, long + "kelp", None)]) == {(1, 2)}


def test_titles_with_thousands_of_names(spark):
    names = [f"{a}{b}{c}ux" for a in "BDFGKLMNPRST" for b in ("ra", "el", "io", "uk", "yz", "om", "an") for c in "bdfgklmnprstvwz"]
    assert len(set(names)) > 1_000
    long = "Flabrex opens tidal survey near " + " ".join(names * 3)
    rows = [(1, long, None), (2, long + " after trial", None), (3, long + " Tudok", None), (4, long.replace(names[7], "Zomquax"), None), (5, "Tudok votes", None)]
    assert run(spark, rows) == brute(rows, lexicon()) == {(1, 2)}


def pairs_of(df):
    return {(r.first_obs_id, r.obs_id) for r in df.collect()}


def test_appended_history_equals_one_run(spark, sf):
    from tidewater.llm import queries as Q
    from tidewater.runtime import table

    whole = pairs_of(H.repeats(table(spark, sf, "observation")))
    assert pairs_of(Q.p2_found(spark, sf)) == whole and len(whole) > 50
    last = {}
    for r in sorted(Q.p2_appended(spark, sf, 3).collect()):
        last[r.obs_id] = r.first_obs_id
    # a pair is judged by what was established on its arrival, and not again
    assert len({(f, i) for i, f in last.items()} ^ whole) <= 0.01 * len(whole)


def test_later_batches_learn_words_join_stories_and_go_on_after_reopening(spark):
    # every word is new to the first batch; later on "kelp" and "surveys" turn out to be ordinary
    first = [(1, "Flabrex opens kelp trial near Tudok", "https://a.example/1"), (2, "Vumaben votes on a tidal council", "https://a.example/2")]
    second = [(10 + i, f"Zomquax{'abcdefgh'[i]} Vol opens a kelp trial near the tidal council after surveys", None) for i in range(8)]
    third = [(30, "Flabrex opens trial near Tudok", None), (31, "Other words about Skitrol", "https://a.example/1"), (32, "Other words about Skitrol", "https://a.example/2")]
    store = H.History(spark)
    assert pairs_of(store.append(spark.createDataFrame(first, SCHEMA))) == set()
    assert pairs_of(store.append(spark.createDataFrame(second, SCHEMA))) == set()
    assert store.lexicon.ordinary("kelp") and not store.lexicon.ordinary("flabrex")
    again = H.History(spark, store.path)
    assert again.batches == 2 and again.lexicon.shares.keys() == store.lexicon.shares.keys()
    # the earlier item 2 is paired anew, since item 32 shows that it is the story of item 1
    assert pairs_of(again.append(spark.createDataFrame(third, SCHEMA))) == {(1, 30), (1, 31), (1, 32), (1, 2)}
    assert pairs_of(again.append(spark.createDataFrame([(50, "Vumaben votes on a tidal council", None)], SCHEMA))) == {(1, 50)}
    assert pairs_of(again.append(spark.createDataFrame([], SCHEMA))) == set()
    assert pairs_of(again.repeats()) == {(1, 2), (1, 30), (1, 31), (1, 32), (1, 50)}


def test_pivots_rule_out_most_pairs_of_a_hot_name(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "lo", "mi", "tu", "ne")]
    lex = L.Lexicon({w: 0.01 for w in words}, set(), set(), 1e-3)
    rows = [(i, " ".join(["Flabrex", *rng.sample(words, 8)]), None) for i in range(1500)]
    heads = H.headlines(H.item_rows(spark.createDataFrame(rows, SCHEMA), lex))
    assert heads.select(H.cell_of(H.F.col("d0"))).distinct().count() == 1
    left = H.candidates(heads, None, lex).count()
    assert left < 0.1 * 1500 * 1499 / 2
    assert run(spark, rows[:120], lex) == brute(rows[:120], lex)


def test_a_hot_story_keeps_its_reworded_copies(spark):
    rows = [(i, f"Report {i} about Skitrol{'abcdefghijklmnop'[i % 16]} closes the council", None) for i in range(400)]
    rows += [(1000 + i, f"Flabrex opens {'a ' * (i % 3)}survey near Tudok", f"https://h{i}.example/1") for i in range(200)]
    assert {(f, i) for f, i in pairs_of(H.repeats(spark.createDataFrame(rows, SCHEMA))) if i >= 1000} == {(1000, 1000 + i) for i in range(1, 200)}


@pytest.mark.parametrize("chain", [1, 2, 9])
def test_components_of_chains(spark, chain):
    edges = spark.createDataFrame([(i + 1, i) for i in range(chain)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in H.components(edges).collect()} == {i: 0 for i in range(chain + 1)} | {100: 100, 101: 100}


def test_stored_words_are_not_shuffled_to_meet_the_few_stale_ones(spark, monkeypatch):
    plans, kept = {}, H.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return kept(df, label)

    rng = random.Random(6)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).capitalize()
    first = [(i, f"{name()} opens a trial near {name()}", None) for i in range(2, 600)] + [(1, "Flabrex opens a kelp trial near Tudok", None)]
    second = [(1000 + i, f"{name()} opens a kelp trial near {name()}", None) for i in range(8)] + [(2000, "Flabrex opens a trial near Tudok", None)]
    store = H.History(spark)
    assert pairs_of(store.append(spark.createDataFrame(first, SCHEMA))) == set()
    monkeypatch.setattr(H, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        found = pairs_of(store.append(spark.createDataFrame(second, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {(1, 2000)}
    assert "BroadcastHashJoin" in plans["held"] and "SortMergeJoin" not in plans["held"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, "flabrex", "7"]), max_size=60), st.integers(0, 400))
def test_placed_counts_every_word(words, more):
    lex = lexicon()
    words = words + ["kelp"] * more
    light = [w for w in words if lex.ordinary(w)]
    heavy = sum(L.weight(w) for w in words if not lex.ordinary(w))
    d0, packed = H.placed(words, H.Places(lex))
    assert d0 == H.SCALE * heavy + len(light)
    assert [packed >> 4 * i & 15 for i in range(H.PIVOTS)] == [min(15, sum(L.part_of(w, H.PIVOTS) == i for w in light)) for i in range(H.PIVOTS)]
