"""Packing, leaks and encodings: exact properties, brute force, round trips, awkward input."""

import itertools
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import encoding as E
from tidewater.llm import leakage as K
from tidewater.llm import packing as B


# --- packing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=7), st.integers(0, 40))
def test_buckets_are_optimal(histogram, spare):
    lengths = sorted(histogram)

    def cost(ends):
        total, low = 0, 0
        for h in ends:
            total += spare + sum((h - length) * n for length, n in histogram.items() if low < length <= h)
            low = h
        return total

    best = min(cost([*cut, lengths[-1]]) for k in range(len(lengths)) for cut in itertools.combinations(lengths[:-1], k))
    got = B.best_buckets(histogram, spare)
    assert cost([h for _, h in got]) == best
    assert [lo for lo, _ in got][1:] == [hi + 1 for _, hi in got][:-1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=8))
def test_batches_place_everything_once_within_capacity(counts):
    load, placed = Counter(), Counter()
    room = {}
    for bucket, lo, hi, each, capacity, first in B.batches(counts, [16, 32, 64]):
        for n in range(lo, hi):
            container = first + (n - lo) // each
            load[container] += bucket
            room.setdefault(container, capacity)
            assert room[container] == capacity
            placed[bucket, n] += 1
    assert placed == Counter({(b, n): 1 for b, k in counts.items() for n in range(k)})
    assert all(load[c] <= room[c] for c in load)


@pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no tokenizer files here")
def test_packing_texts_whole(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["kelp", "tidal", "survey", "été"]) for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["kelp " * 900, "", None, "same text", "same text"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id int, text string, tokens int, bucket string").repartition(5)
    encoder = B._encoder(B.VOCABULARY, B.PATTERN)
    rows = B.pack(B.sized_pieces(df, ["id"], 64), [16, 32, 64], ["id"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.begin, r.end, r.tokens))
    assert set(by) == {i for i, t in enumerate(texts) if t}
    for i, parts in by.items():
        parts.sort()
        n = len(encoder.encode_ordinary(texts[i]))
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == 1 if n <= 64 else all(t == 64 for _, _, t in parts[:-1])
    load, room = Counter(), {}
    for r in rows:
        load[r.container] += r.tokens
        assert room.setdefault(r.container, r.capacity) == r.capacity
    assert all(load[c] <= room[c] for c in load)
    assert 1 - sum(load.values()) / sum(room.values()) < 0.12
    assert B.pack(B.sized_pieces(df.limit(0), ["id"], 64), [16, 64], ["id"]).count() == 0


# --- leaks -------------------------------------------------------------------------------------------------------------
def naive_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (K.MATCH if a[i - 1] == b[j - 1] else K.MISS), h[i - 1][j] + K.GAP, h[i][j - 1] + K.GAP)
    return max(map(max, h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=14), st.lists(st.sampled_from("abcd"), min_size=1, max_size=14))
def test_alignment_has_the_best_score(a, b):
    pairs = K.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    score = 0
    for k, (i, j) in enumerate(pairs):
        score += K.MATCH
        if k:
            di, dj = i - pairs[k - 1][0] - 1, j - pairs[k - 1][1] - 1
            score += -max(di, dj)
    assert score == naive_alignment(a, b)


ITEM = "Read the passage and answer. The team in Hiklawu compared tutor design data from Talumal with 8315 records held by Kymidrim and found no clear gap. Neither Vopasor nor Kriquuhyx would say when the tidal backlog in Zasivan is due to start."


def leak_rows(spark, docs, items=None):
    filler = "The team in Plovdan compared tutor design data from Xurim with 12 records held by Ostrek and found no clear gap. Neither side would say when it is due to start. "
    texts = [(i, t) for i, t in enumerate(docs)] + [(1000 + i, filler.replace("Plovdan", f"Pl{i}an").replace("Xurim", f"Xu{i}m") * 2) for i in range(60)]
    others = [(50 + i, f"Read the passage and answer. Something else about Number{i} entirely different from all the rest of the items here.") for i in range(4)]
    items = [(1, ITEM), *others, (90, None), (91, "")] if items is None else items
    return {(r.doc_id, r.item_id) for r in K.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()}


def test_leaks_whole_edited_and_in_part_but_not_by_wording(spark):
    body = ITEM.split(". ", 1)[1]
    other = body.replace("Hiklawu", "Abru").replace("Talumal", "Cedri").replace("8315", "77").replace("Kymidrim", "Efgo").replace("Vopasor", "Hijk").replace("Kriquuhyx", "Lmno").replace("Zasivan", "Pqrs")
    docs = [
        f"Before it. {body} After it.",
        f"Before. {body.upper()}",
        body.replace("compared", "compared compared").replace("tutor ", "").replace("held", "kept").replace(". ", "\n\n—  "),
        "x " + " ".join(body.split()[3:17]) + " y",
        "x " + " ".join(body.split()[3:10]) + " y",
        other,
        "", None, "word " * 100_000 + body,
    ]
    got = leak_rows(spark, docs)
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (8, 1)}


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    body = ITEM.split(". ", 1)[1]
    ws = body.split()
    docs = [f"Page {i} of the collection. {body} Number {i} ends." for i in range(25)]
    # one word in ten changed: no run of twelve words is left
    docs += [" ".join(f"z{i}q" if (k + i) % 10 == 0 else w for k, w in enumerate(ws)) for i in range(12)]
    docs += [" ".join(ws[3:17])]
    other = body
    for name, new in zip(["Hiklawu", "Talumal", "8315", "Kymidrim", "Vopasor", "Kriquuhyx", "Zasivan"], ["Abru", "Cedri", "77", "Efgo", "Hijk", "Lmno", "Pqrs"]):
        other = other.replace(name, new)
    assert leak_rows(spark, [*docs, other, ""]) == {(i, 1) for i in range(len(docs))}


def test_leaks_at_any_place_of_a_document(spark):
    ws = ITEM.split(". ", 1)[1].split()
    exact = " ".join(ws[3:16])
    # most names left out and single words changed: more matches than the exact run has, but no leak
    scattered = " ".join(w if k % 5 or 8 < k < 14 else "elsewhere" for k, w in enumerate(ws) if w not in ("8315", "Kymidrim", "Vopasor", "Kriquuhyx", "Zasivan"))
    far = " ".join(f"w{i}" for i in range(200))
    docs = [f"{scattered} {far} {exact} end", f"x {exact} {far} {scattered}", f"{scattered} so {exact} end", scattered]
    assert leak_rows(spark, docs) == {(0, 1), (1, 1), (2, 1)}


def test_leaks_however_many_documents_and_rounds(spark, monkeypatch):
    start = "Read the passage and answer. "
    bodies = [f"The crew of Ship{x} counted seals near Cape{x} and wrote {300 + i} pages about Lake{x} before the winter storm closed Port{x}." for i, x in enumerate(["abu", "dek", "fim", "gor"])]
    items = [(i, start + b) for i, b in enumerate(bodies)] + [(20, "Zufallswort"), (21, "Gelbe Zufallsfahne")]
    docs = [f"d{k} {bodies[0]} end{k}" for k in range(1)] + [f"d{k} {bodies[1]} end{k}" for k in range(6)] + [f"d{k} {bodies[2]} end{k}" for k in range(20)] + [f"d{k} {bodies[3]} end{k}" for k in range(100)]
    docs += ["in the middle Zufallswort of it", "a gelbe zufallsfahne waves here", "gelbe andere fahne"]
    want = {(k, 0 if k < 1 else 1 if k < 7 else 2 if k < 27 else 3) for k in range(127)} | {(127, 20), (128, 21)}
    assert leak_rows(spark, docs, items) == want
    monkeypatch.setattr(K, "ITEM_WORDS", 20)
    assert leak_rows(spark, docs, items) == want


def test_leaks_of_nothing(spark):
    assert leak_rows(spark, ["some text"], items=[]) == set()
    assert leak_rows(spark, [], items=None) == set()


def test_leaks_in_rounds_are_the_same(spark, monkeypatch):
    body = ITEM.split(". ", 1)[1]
    monkeypatch.setattr(K, "ITEM_WORDS", 30)
    assert (0, 1) in leak_rows(spark, [body])


# --- encodings -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = [r.text for r in rows if r.text]
    info = E.fit_information(spark.createDataFrame([(t,) for t in texts], "text string"))
    return info, [t for t in texts if not t.isascii()]


def garble(text, codec):
    out = []
    for b in text.encode("utf-8"):
        out.append(chr(E.FORWARD[codec][b]) if b in E.FORWARD[codec] else chr(b))
    return "".join(out)


SENTENCES = ["L’équipe de Kigugru a comparé le relevé énergétique près de la mairie, après 26 contrôles.", "Für die größere Prüfung fehlen in Skibyskan noch 26 Fachkräfte.", "La mañana en que mostró el cañón público a los vecinos después de la decisión.", "Né Mirahix né Wopletra hanno voluto dire perché il museo è già pronto."]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", SENTENCES)
def test_round_trip_of_wrong_decodings(clean, codec, text):
    fixed, pieces, left = E.Repairer(clean[0])(garble(text, codec))
    assert fixed == text and pieces and not left


def test_copies_of_a_garbled_text_in_a_third_of_the_rows(spark):
    garbled = "Le comité a comparé le relevé énergétique près de la mairie, où la décision a été présentée.".encode("cp850").decode("cp1252")
    other = "La société a présenté le décret après la journée.".encode("cp850").decode("cp1252")
    whole = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [*whole, *[garbled] * 250, *[f"Page {i}.\n{garbled}" for i in range(250)], other]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {r.id: r.restored for r in E.repair(df, E.fit_information(df), ["id"]).collect()}
    fixed, n = garbled.encode("cp1252").decode("cp850"), len(whole)
    assert [got.get(n + i) for i in range(500)] == [fixed] * 250 + [f"Page {i}.\n{fixed}" for i in range(250)]
    assert n + 500 in got


def test_round_trip_of_a_double_decoding(clean):
    text = SENTENCES[1]
    fixed, _, _ = E.Repairer(clean[0])(garble(garble(text, "cp1252"), "cp1252"))
    assert fixed == text


def test_right_texts_stay(clean):
    fix = E.Repairer(clean[0])
    for text in ["Prices in SÃO Juhibrox rose to £28, or €32.", "The glossary lists the sign Â as a letter of its own and Ã as another.", "The guide explains that the sequence â€™ in a title points to a faulty import.", "A reader asked why the feed showed “Ã©” instead of an accent.", "The replacement sign � is shown as an example only.", "À L’ÉTÉ, il PRÉSENTERA SON BÂTIMENT À Paris.", "STRAẞENFEST IN Wien: LÄDT ÜBER 30 GÄSTE EIN.", "caf&eacute; &amp; piñata −36 °C", "plain"] + SENTENCES:
        assert fix(text) == (text, 0, False), text


def test_lost_signs_are_found_but_not_invented(clean):
    text = "Un second avis, num�ro 7, demande � Paris."
    assert E.Repairer(clean[0])(text) == (text, 0, True)


def test_repair_of_awkward_tables(spark, clean):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, garble(SENTENCES[1], "cp1252"), "x"), (5, garble(SENTENCES[0] * 400, "cp1252"), "x"), (6, garble(SENTENCES[1], "cp1252"), "x")]
    df = spark.createDataFrame(rows, "id int, text string, restored string")
    got = {r.id: r.restored for r in E.repair(df, clean[0], ["id"]).collect()}
    assert got == {4: SENTENCES[1], 5: SENTENCES[0] * 400, 6: SENTENCES[1]}
    empty = df.limit(0)
    assert E.repair(empty, E.fit_information(empty), ["id"]).count() == 0


def test_runs_of_any_length_and_damage_side_by_side(spark):
    base = ["Le comité a décidé que la réunion déjà prévue était reportée à l’été", "Die Tür war größer als für die Übung nötig", "“Niño” pidió más café mañana según él"] * 8
    sound = [(i, f"{t} numéro {i}") for i, t in enumerate(base)]
    long = {n: "".join("äöüß"[i % 4] for i in range(n)) for n in (7, 18, 400)}
    texts = {}
    for n, word in long.items():
        texts[100 + n] = f"le mot {word.encode().decode('latin-1')}é est ici"
    texts[200] = "le café " + "déjà".encode().decode("cp1252", "replace") + " et l\ufffdt\ufffd"
    texts[201] = "sound déjà"
    got = {r.doc_id: r for r in E.repair(spark.createDataFrame([*sound, *((i, f"le mot {w} dit") for i, w in enumerate(long.values(), 300)), *texts.items()], "doc_id long, text string"), E.fit_information(spark.createDataFrame([*sound, *((i, f"le mot {w} dit {k}") for k in range(8) for i, w in enumerate(long.values(), 300)), *texts.items()], "doc_id long, text string")), ["doc_id"]).collect()}
    for n, word in long.items():
        assert got[100 + n].restored == f"le mot {word}é est ici"
    assert got[200].unrestorable and got[200].restored.startswith("le café déjà") and 201 not in got and not any(i < 100 for i in got)
