"""Language labels: held-out accuracy, segments of mixed texts, the filters themselves, awkward input."""

import random

from pyspark.sql import functions as F

from tidewater.llm import language as G


def halves(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_samples.parquet").collect()]
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    return rows[:half], rows[half:]


def test_held_out_accuracy_and_confidence(spark, sf):
    train, test = halves(spark, sf)
    filters = G.fit_filters(spark.createDataFrame(train, "lang string, text string"))
    got = G.detect(spark.createDataFrame(test, "lang string, text string"), "text", ["lang"], filters).collect()
    right = sum(r.lang == r.detected for r in got)
    assert len(got) == len(test) and right >= 0.97 * len(test)
    assert all(0 < r.confidence <= 1 for r in got if r.detected)


def test_mixed_texts_get_a_language_for_each_part(spark, sf):
    train, test = halves(spark, sf)
    filters = G.fit_filters(spark.createDataFrame(train, "lang string, text string"))
    rng, rows = random.Random(2), []
    for i in range(80):
        (a, x), (b, y) = rng.sample(test, 2)
        if a != b:
            rows.append((i, f"{a} {b}", f"{x.rstrip('.')} – {y}"))
    got = {}
    for r in G.detect(spark.createDataFrame(rows, "id int, lang string, text string"), "text", ["id", "lang"], filters).collect():
        got.setdefault((r.id, r.lang), []).append((r.begin, r.end, r.detected))
    right = [" ".join(x[2] or "" for x in sorted(parts)) == lang for (_, lang), parts in got.items()]
    assert sum(right) >= 0.9 * len(rows)  # from 150 sentences; the queries fit on far more
    assert all(sorted(p)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(p), sorted(p)[1:])) for p in got.values())


def test_any_number_of_segments(spark, sf):
    train, test = halves(spark, sf)
    filters = G.fit_filters(spark.createDataFrame(train, "lang string, text string"))
    by = {lang: [t.rstrip(".") for x, t in test if x == lang] for lang in ("en", "fr", "de")}
    rows = [(i, f"{by['en'][i]} – {by['fr'][i]} – {by['en'][i + 9]}", "en fr en") for i in range(9)]
    rows += [(20 + i, f"{by['de'][i]} – {by['fr'][i]} – {by['en'][i]}", "de fr en") for i in range(9)]
    got = {}
    for r in sorted(G.detect(spark.createDataFrame(rows, "id int, text string, want string"), "text", ["id", "want"], filters).collect(), key=lambda r: (r.id, r.segment)):
        got.setdefault((r.id, r.want), []).append(r)
    assert sum(" ".join(r.detected or "" for r in parts) == want for (_, want), parts in got.items()) >= 0.8 * len(rows)
    assert all(a.end == b.begin for parts in got.values() for a, b in zip(parts, parts[1:]))


def test_segmentation_equals_brute_force():
    rng = G.np.random.default_rng(4)
    for n in (1, 5, 9, 13):
        x = rng.normal(size=(n, 3)) * 3

        def best(k, least=2, gain=2.0):
            return max([x[:k].sum(axis=0).max()] + [best(j) - gain + x[j:k].sum(axis=0).max() for j in range(least, k - least + 1)])

        parts = G.segmented(x, 2.0, 2)
        assert abs(sum(x[a:b, g].sum() for a, b, g in parts) - 2.0 * (len(parts) - 1) - best(n)) < 1e-9
        assert parts[0][0] == 0 and parts[-1][1] == n and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))


def test_a_language_not_learnt_is_not_given_with_confidence(spark, sf):
    train, _ = halves(spark, sf)
    filters = G.fit_filters(spark.createDataFrame(train, "lang string, text string"))
    texts = ["wszystkie dzieci lubią wczesnym rankiem chodzić pieszo przez łąkę", "kaikki lapset haluavat kävellä aamulla metsän läpi kouluun", "dağdaki köylüler sabahları çok erken kalkıyor ve yürüyor"]
    got = [r for r in G.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text", ["id"], filters).collect()]
    assert all(r.detected in (None, G.OTHER) or r.confidence < 0.6 for r in got)


def test_filters_forget_nothing_and_correct_chance():
    sets = {lang: {f"{lang}{i}" for i in range(4000)} for lang in G.LANGUAGES}
    filters = G.Filters(sets)
    for i, lang in enumerate(G.LANGUAGES):
        assert all(filters.languages(g) >> i & 1 for g in sets[lang])
    unknown = [filters.languages(f"?{i}") for i in range(20_000)]
    for i in range(len(G.LANGUAGES)):
        assert abs(sum(m >> i & 1 for m in unknown) / len(unknown) - filters.chance[i]) < 0.01


def test_labels(spark):
    labels = ["en", "EN", "en-US", "en_GB", "eng", "fra", "FR", "", " ", "und", None, "mul", "pt"]
    got = [r.l for r in spark.createDataFrame([(x,) for x in labels], "c string").select(G.label_language(F.col("c")).alias("l")).collect()]
    assert got == ["en", "en", "en", "en", "en", "fr", "fr", None, None, None, None, "mul", "pt"]


def test_awkward_texts(spark, sf):
    train, _ = halves(spark, sf)
    filters = G.fit_filters(spark.createDataFrame(train, "lang string, text string"))
    texts = [None, "", "12 34 !!", "Zzzqx", "the council votes on the plan " * 20_000, "le marché de la mairie et les élus"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "id int, text string, detected string, segment string")
    got = {r.id: (r.detected, r.confidence) for r in G.detect(df, "text", ["id"], filters).collect()}
    assert 0 not in got and got[1] == got[2] == (None, 0.0) and got[4][0] == "en" and got[5][0] == "fr"
    assert G.detect(df.limit(0), "text", ["id"], filters).count() == 0
