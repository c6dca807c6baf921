"""Operators over documents: contracts against brute force, and awkward input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from quillspark.llm import components, decontam, divergence, gam, licenses, minhash, mixing, phrases, sharding

from .helpers import SCHEMA, WORD, awkward, brute_components, brute_repeats, lower, near_copies


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_cuts_at_equal_bytes(spark):
    rows = [(i, "x" * (i * 37 % 101)) for i in range(400)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7).toPandas().sort_values("doc_id")
    assert out["size"].tolist() == [len(t) + 8 for _, t in rows]
    assert out.text_crc32.tolist() == [zlib.crc32(t.encode()) for _, t in rows]
    assert out.shard.is_monotonic_increasing and set(out.shard) == set(range(7))
    assert np.ptp(out.groupby("shard")["size"].sum()) <= 2 * out["size"].max()
    before = out["size"].cumsum() - out["size"]
    assert out.shard.tolist() == [min(6, (2 * b + s) * 7 // (2 * out["size"].sum())) for b, s in zip(before, out["size"])]
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.law.unique().tolist() == ["bytes"] and out.grown_shard.isna().all()


def test_sharding_of_one_hot_row(spark):
    df = spark.createDataFrame([(1, "same")] * 300 + [(2, "y")], "doc_id long, text string")
    out = sharding.shard_documents(df, 5).toPandas()
    assert out.groupby("shard").size().max() <= 62


def test_sharding_awkward(odd, empty):
    out = sharding.shard_documents(odd).toPandas()
    assert len(out) == len(awkward()) and out["size"].min() == 8
    assert sharding.shard_documents(empty).count() == 0


def brute_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_divergence_base_counts(odd, empty):
    extra = "a b c d e f a b c d e\n\nx #*$\nx #*$\n a b c d e"
    assert divergence.Judge(divergence.DivergenceRules()).row(extra.encode())[:5] == brute_base(extra)
    out = divergence.divergence_rules(odd).toPandas()
    want = Counter(brute_base(t) for _, t, *_ in awkward())
    assert Counter(zip(out.n_words, out.word_chars, out.n_symbols, out.n_dup_lines, out.n_repeat_words)) == want
    assert divergence.divergence_rules(empty).count() == 0


def test_divergence_many_distinct_words():
    text = " ".join(f"q{i}" for i in range(8000)) + " " + " ".join(f"q{i}" for i in range(50, 70))
    assert divergence.base_counts(text.encode())[4] == brute_base(text)[4] == 40


def test_divergence_verdicts(spark):
    prose = "The man went to the town and it was a good day for him. " * 3 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of the land" for i in range(60))
    loud = " ".join(f"XQ{chr(65 + i % 26)}{chr(65 + i // 26)}$$$ #%#{i}" for i in range(100))
    out = divergence.divergence_rules(spark.createDataFrame([(1, prose), (2, loud), (3, "short clean text of ten words or so is kept here")], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert out.kept.to_dict() == {1: True, 2: False, 3: True}
    assert out.nearest[1] in divergence.DivergenceRules().languages and out.char_distance.isna()[3]
    p = np.array([0.5, 0.5, 0.0])
    assert divergence.js_distance(p, p) == 0 and divergence.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


PROSE = {
    "en": "The house stood at the end of a long road, and it was known to all of the people in the village that nobody had lived there for many years. On some evenings a light was seen from the fields, but those who went to look came back with nothing to tell. In the spring a young teacher rented it, mended the roof and opened a school for the children of the farms near by.",
    "de": "Das Haus stand am Ende der langen Straße, und alle Leute in dem Dorf wussten, dass dort seit vielen Jahren niemand mehr wohnte. An manchen Abenden sah man von den Feldern aus ein Licht, aber wer nachsehen ging, kam zurück und hatte nichts zu erzählen. Im Frühling mietete eine junge Lehrerin das Haus, ließ das Dach ausbessern und öffnete die Schule für die Kinder auf den Höfen der Gegend.",
    "fr": "La maison se trouvait au bout de la longue route, et tous les gens du village savaient que personne ne vivait là depuis des années. Certains soirs on voyait une lumière dans les champs, mais ceux qui allaient voir revenaient sans rien à raconter. Au printemps un jeune maître loua la maison, fit réparer le toit et ouvrit une école pour les enfants des fermes qui sont dans la vallée.",
    "es": "La casa estaba al final de un largo camino, y toda la gente del pueblo sabía que nadie vivía en ella por muchos años. Algunas noches se veía una luz en los campos, pero los que iban a mirar volvían sin nada que contar. En la primavera una joven maestra alquiló la casa, mandó arreglar el techo y abrió una escuela para los niños de las granjas que había en el valle.",
}


def test_divergence_rejects_text_without_common_words():
    judge = divergence.Judge(divergence.DivergenceRules())
    for lang, text in PROSE.items():
        row = judge.row(text.encode())
        assert row[0] >= 60 and row[6] and row[7] == lang
        used = {w for x in divergence.WORDS.values() for w in x.split()[::2]}
        rare = " ".join(w for w in (text + " " + text[::-1]).split() if w.strip(".,").lower() not in used)
        row = judge.row(rare.encode())
        assert row[0] >= 60 and row[8] <= 0.32 and not row[5] and not row[6]
    listed = " | ".join(f"th{chr(97 + i % 26)}nd{chr(97 + i // 26)}ha" for i in range(120))
    assert not judge.row(listed.encode())[6]


def test_repeats_against_brute_force(spark):
    a = "The quick brown fox jumps over the lazy dog and runs far away into the deep forest, never seen again. "
    b = "".join(f"unique stretch number {i} of a text that nobody else has; " for i in range(6))
    rows = [(5, a + b), (1, b[30:120] + a), (9, "x" + a + "é" * 40), (2, "short"), (7, a + b), (3, "é" * 60), (4, "=" * 400), (8, "=" * 90 + "tail"), (6, ""), (11, (a + b)[:170] + "Z" + (a + b)[171:])]
    out = phrases.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas().set_index("doc_id")
    assert {i: tuple(r) for i, r in zip(out.index, out.itertuples(index=False))} == brute_repeats(rows)


def test_repeats_across_segments_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(phrases, "_CHUNK", 128)
    rows = [(i, t[: 200 + i]) for i, t in near_copies(40, 60)]
    out = phrases.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas().set_index("doc_id")
    assert {i: tuple(r) for i, r in zip(out.index, out.itertuples(index=False))} == brute_repeats(rows)


def test_repeats_of_a_row_in_two_segments(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 1)
    r = random.Random(8)
    piece = lambda n: "".join(r.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(n))
    rows, again = [], []
    for i in range(0, 40, 2):
        shared = piece(60 + 7 * i)
        rows.append((i, piece(90) + shared + piece(90)))
        again.append((i + 1, piece(90) + shared + piece(90)))
    out = phrases.repeated_strings(spark.createDataFrame(rows + again + again, "doc_id long, text string").coalesce(1)).toPandas()
    want = brute_repeats(rows + again)
    assert len(out) == 60 and all(tuple(x[1:]) == want[x[0]] for x in out.itertuples(index=False))


def test_suffix_ranks():
    data = np.frombuffer(b"\x00ab" * 30 + b"\x00" * 70 + b"z" + b"\x00ab" * 20 + bytes(range(60)), np.uint8)
    strings = [data[i : i + 50].tobytes() for i in range(len(data) - 49)]
    want = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert phrases.suffix_ranks(data).tolist() == [want[x] for x in strings]
    assert len(phrases.suffix_ranks(data[:49])) == 0


def packed_strings(rows):
    """(doc_id, phrase) in rising order of ids as a block gets them, and its answer by brute force."""
    ids = np.array([i for i, _ in rows])
    blob = b"".join([*phrases._owners(ids), np.array([len(t) - 49 for _, t in rows], "u1").tobytes(), *(t for _, t in rows)])
    least = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    return blob, [int(i > least[t[k : k + 50]]) for i, t in rows for k in range(len(t) - 49)]


def test_only_strings_that_can_be_shared_are_sorted(monkeypatch):
    r = random.Random(5)
    piece = lambda n: bytes(r.choices(range(97, 123), k=n))
    shared, trigger = piece(53), piece(35)
    rows = [(i, piece(20) + trigger + piece(20)) for i in range(200)] + [(200, piece(9) + shared + piece(5)), (300, shared + piece(8))]
    blob, want = packed_strings(rows)
    sizes, ranks = [], phrases.suffix_ranks
    monkeypatch.setattr(phrases, "suffix_ranks", lambda data: (sizes.append(len(data)), ranks(data))[1])
    assert np.concatenate(phrases._judge_suffixes([blob])).tolist() == want and sum(want) == 4
    assert sizes == [2 * 53]
    # A hash that tells nothing apart costs sorting, not results.
    monkeypatch.setattr(phrases, "string_hashes", lambda data: np.zeros(len(data) - 49, np.uint64))
    assert np.concatenate(phrases._judge_suffixes([blob])).tolist() == want and sizes[1] > 15_000


def test_phrases_with_near_equal_fingerprints():
    r = np.random.default_rng(6)
    n = 4000
    ids = np.sort(r.integers(0, 90, n))
    key, body = r.integers(0, 4, n).astype(np.uint64), (r.integers(0, 3, n) << 40 | r.integers(0, 40, n)).astype(np.uint64)
    left, right = ((body % np.uint64(k)).astype(np.uint16) for k in (30, 7))
    order, new = phrases._grouped((key << np.uint64(24)) | (body >> np.uint64(40)), body, left, right)
    assert sorted(order.tolist()) == list(range(n)) and new.sum() == len({*zip(key.tolist(), body.tolist())})
    rep, of = phrases._merge(key, body)
    first = {}
    want = [first.setdefault(k, i) for i, k in enumerate(zip(key.tolist(), body.tolist()))]
    assert rep[of].tolist() == want
    least, sides = {}, {}
    for i, k, b, lf, rt in zip(ids.tolist(), key.tolist(), body.tolist(), left.tolist(), right.tolist()):
        least[k, b] = min(i, least.get((k, b), i))
        for s in ((k, "l", lf), (k, "r", rt)):
            sides.setdefault(s, set()).add(b)
    several = {k for k, _ in least if len({b for j, b in least if j == k}) > 1}
    for i, k, b, lf, rt, v in zip(ids.tolist(), key.tolist(), body.tolist(), left.tolist(), right.tolist(), phrases._judge(ids, key, body, left, right).tolist()):
        if i > least[k, b]:
            assert v == phrases.COVERED
        else:
            assert v == sum(bit for bit, s in ((phrases.LEFT, (k, "l", lf)), (phrases.RIGHT, (k, "r", rt))) if s[2] and k in several and len({least[k, x] for x in sides[s]}) > 1)


def test_sides_of_two_bytes_and_one_batch_for_a_segment():
    r = random.Random(7)
    texts = [bytes(r.choices(range(97, 123), k=9000)) for _ in range(4)]
    s = phrases.Segment([1, 2, 3, 4], [len(t) for t in texts], zstandard.ZstdCompressor().compress(b"".join(texts)))
    ids, key, body, left, right = records = s.records()
    assert len({*left.tolist()}) > 500 and len({*right.tolist()}) > 500
    batches = list(phrases._blobs(9, key, 50, lambda rows: phrases._pack(*(x[rows] for x in records))))
    assert len(batches) == 1 and batches[0].column(1).to_pylist() == list(range(50))
    back = [np.concatenate(x) for x in zip(*map(phrases._unpack, batches[0].column(2).to_pylist()))]
    order = np.argsort(phrases._bucket(key, 50), kind="stable")
    for got, want in zip(back, (ids, key & np.uint64(2**40 - 1), body, left, right)):
        assert got.tolist() == want[order].tolist()


def test_repeats_awkward(odd, empty):
    out = phrases.repeated_strings(odd).toPandas()
    assert len(out) == len(awkward())
    by = out.set_index("doc_id")
    assert by.n_removed[6] == by.n_bytes[6] and by.n_spans[6] == 1
    assert by.kept_sha256[6] == hashlib.sha256(b"").hexdigest()
    assert out[out.doc_id.isna()].n_removed.sum() == 0
    assert phrases.repeated_strings(empty).count() == 0


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (20, "Short item here"), (3, None), (4, ""), (5, "solo")]


def brute_hits(text, items, window=13):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w, hit, found = word.findall(lower(text or "")), set(), set()
    for i, t in items:
        p = word.findall(lower(t or ""))
        for s in range(max(1, len(p) - window + 1)) if p else ():
            x = p[s : s + window]
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_against_brute_force(spark, odd, block):
    p = ITEMS[0][1]
    rows = [(1, f"x {p.upper()}, y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, "a short-item here; solo! " + "pad " * 200), (4, p.split(" ", 1)[1] + " " + p), (5, "solo" * 3), (6, "Sólo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontam.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block).toPandas().set_index("doc_id")
    assert {i: tuple(r) for i, r in zip(out.index, out.itertuples(index=False))} == {i: brute_hits(t, ITEMS) for i, t in rows}
    assert decontam.decontaminate(odd, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block).count() == len(awkward())


def test_decontamination_without_benchmark(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(odd, none).where("n_hit > 0").count() == 0
    assert decontam.keep_clean(odd, none).columns == odd.columns
    assert decontam.keep_clean(empty, none).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_keep_clean_judges_each_row(spark, block):
    long_text = "pad " * 900
    rows = [(None, ITEMS[0][1]), (None, "clean"), (1, ITEMS[0][1]), (1, "clean too"), (2, None), (3, ""), (4, long_text + ITEMS[0][1]), (5, long_text + "solo"), (6, "solo act"), (5, long_text)]
    docs, items = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, _row int, contaminated string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.keep_clean(docs, items, block_bytes=block)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "clean"), (1, "clean too"), (2, ""), (3, ""), (5, long_text), (5, long_text + "solo")]


def test_gam_learns_a_pair_and_scores_all(spark, odd, empty):
    r = np.random.default_rng(1)
    x = r.uniform(size=(1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x, y)
    z = r.uniform(size=(1000, 4))
    assert ((m.score(z) > 0.5) == ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5))).mean() > 0.93
    labels = spark.createDataFrame([(0, 1), (5, 0), (6, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    out = gam.score(odd, gam.train(odd, labels)).toPandas()
    assert len(out) == len(awkward()) and out.score.between(0, 1).all()
    assert [h for i, h in zip(out.doc_id, out.held_out) if i == i] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in out.doc_id if i == i]
    assert (out.predicted == (out.score >= 0.3)).all()
    assert gam.score(empty, gam.train(empty, labels)).count() == 0


def test_gam_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = gam.op5_gam(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    assert docs.count() == gam.op5_gam(spark, sf).count()


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies() + [(1000, "one"), (1001, "One"), (1002, ""), (1003, None), (1004, "one two"), (1005, "ONE  two\n")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas().set_index("doc_id")
    assert out.component_id.to_dict() == brute_components(rows)
    assert (out.kept == (out.index == out.component_id)).all()


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share an id are judged by their own texts, and none is lost."""
    family = [t for _, t in near_copies(6, 60, seed=2)]
    a, b = family[0], " ".join(f"other{i}" for i in range(50))
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (None, b, 4), (None, None, 5), (7, "", 6), (7, b + " more", 7), (5, b, 8)], "doc_id long, text string, node int")
    out = sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(docs).collect())
    assert out == [(0, 0), (0, 0), (3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (7, 7)]
    kept = minhash.one_of_each(docs, k=2)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (3, a), (5, b), (7, "")]


def test_near_duplicates_with_hot_keys_split(spark, monkeypatch):
    from quillspark.plans import skew

    monkeypatch.setattr(skew.join_one, "__defaults__", ("inner", 20, 3, None))
    monkeypatch.setattr(minhash, "PARTS", 20)
    monkeypatch.setattr(minhash, "LEAST", 3)
    rows = near_copies(80, 70, seed=11) + [(2000 + i, "same text for all of these rows") for i in range(30)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas().set_index("doc_id")
    assert out.component_id.to_dict() == brute_components(rows)


def test_components_of_long_chains(spark):
    """Each chain has ids of its own range: shuffled, descending, the least at the far end."""
    shuffled = list(range(3000))
    random.Random(4).shuffle(shuffled)
    chains = [shuffled, list(range(12_999, 9_999, -1)), [*range(20_001, 21_500), 20_000]]
    edges = [e for c in chains for e in zip(c, c[1:])] + [(30_009, i) for i in range(30_000, 30_009)] + [(7, 7), (40_000, 40_000), (40_001, 40_002), (40_002, 40_001)]
    out = components.components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    want = {i: min(c) for c in [*chains, range(30_000, 30_010), [40_001, 40_002]] for i in c}
    assert len(out) == len(want) and dict(zip(out.node, out.label)) == want
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_near_duplicates_awkward(odd, empty):
    out = minhash.near_duplicates(odd).toPandas()
    assert len(out) == len(awkward())
    by = {i: c for i, c in zip(out.doc_id, out.component_id) if i == i}
    assert by[6] == 5 and by[2] == 2 and by[4] == 4
    assert out[out.doc_id.isna()].kept.all()
    assert minhash.near_duplicates(empty).count() == 0


def test_licences(spark, odd, empty):
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 2.0."), (3, "He lost his license after the accident."), (4, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved."), (5, "plain"), (6, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert out.families.to_dict() == {1: "mit", 2: "apache-2.0", 3: None, 4: "gpl-3.0,proprietary", 5: None, 6: None}
    assert licenses.scan(odd).count() == len(awkward()) and licenses.scan(empty).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_against_the_model_itself(spark):
    """The joins give what the model gives paragraph by paragraph."""
    m = licenses.model()
    lines = [t for f in licenses.TEMPLATES.values() for t in f] + licenses.BACKGROUND
    out = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).toPandas().set_index("doc_id")
    at = {g: i for i, g in enumerate(m.vocabulary)}
    right = 0
    for i, t in enumerate(lines):
        w = licenses.tokens(t)
        p = m.softmax([at[g] for g in sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}) if g in at])
        c = p.index(max(p))
        if out.families[i]:
            assert m.families[c] == out.families[i]
            right += 1
    assert right >= 35


def test_licences_of_wrapped_notices(spark):
    """Every line that the model gives a family is counted, whichever words it has."""
    m = licenses.model()
    own = ["to any person obtaining a copy of this software and associated documentation files", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products", "No part of this publication may be reproduced without", "Of any_other publication, SOFTWARE; \u212a", "you may be under the"]
    given = [t for f in licenses.TEMPLATES.values() for t in f] + licenses.BACKGROUND
    cut = [" ".join(w[i : i + 8]) for t in given for w in [t.split()] for i in range(0, len(w), 4)]
    lines = [*own, *cut]
    at = {g: i for i, g in enumerate(m.vocabulary)}
    want = []
    for t in lines:
        w = licenses.tokens(t)
        p = m.softmax([at[g] for g in sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}) if g in at])
        want.append(int(p.index(max(p)) < len(p) - 1 and max(p) >= m.cutoff))
    out = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    assert want[:3] == [1, 1, 1] and (out.n_paragraphs + out.n_unconfirmed).tolist() == want


WRAPPED = {
    "mit": "Intro line.\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software\nand associated documentation files",
    "gpl-3.0": "This program is free\nsoftware: you can redistribute\nit and modify it under the terms of the\nGNU General Public License",
    "bsd": "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted",
    "apache-2.0": "You may not use this file except in\ncompliance with the Apache License.",
}


def test_licences_wrapped_over_lines(spark):
    out = licenses.scan(spark.createDataFrame(list(WRAPPED.items()), "doc_id string, text string")).toPandas().set_index("doc_id")
    assert out.families.to_dict() == {k: k for k in WRAPPED} and set(out.n_paragraphs) == {1}
    prose = "The school lost its licence.\nIt was released under guard, and the\nuse of the road is permitted.\n" * 3
    none = licenses.scan(spark.createDataFrame([(1, prose)], "doc_id long, text string")).first()
    assert none.families is None and none.n_paragraphs == 0


@pytest.mark.parametrize("budget", [0.3, 0.66])
def test_raking_meets_margins(budget):
    """At 0.66 some cells are taken whole, and the margins hold all the same."""
    cells = [("a", "en", "x", 800), ("a", "de", "x", 100), ("b", "en", "y", 500), ("b", "de", "x", 500), ("b", "de", "y", 200), ("a", "en", "y", 300)]
    half = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.55, "y": 0.45}}
    p = mixing.rake(cells, mixing.MixTarget(shares=half, budget=budget, rounds=2000))
    taken = {c[:3]: c[3] * p[c[:3]] for c in cells}
    total = sum(taken.values())
    assert total == pytest.approx(2400 * budget, rel=1e-4) and max(p.values()) <= 1 and (budget < 0.5 or max(p.values()) == 1)
    for i, m in enumerate(mixing.MARGINS):
        for v, share in half[m].items():
            assert sum(t for c, t in taken.items() if c[i] == v) / total == pytest.approx(share, abs=1e-3)


def test_raking_takes_a_scarce_value_whole():
    p = mixing.rake([("a", "en", "x", 10), ("b", "en", "x", 990)], mixing.MixTarget(shares={"source": {"a": 0.5, "b": 0.5}}, budget=0.5))
    assert p["a", "en", "x"] == 1 and 0 < p["b", "en", "x"] < 1


def test_mixed_documents_meet_margins(spark):
    rows = mixing.mixed_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    off = mixing.margins(rows).toPandas()
    assert set(off.margin) == set(mixing.MARGINS) and (off.wanted - off.expected).abs().max() < 1e-3


def test_mixing_in_tables_is_mixing_in_memory(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = mixing.mix(mixing.described(docs)).select("doc_id", "probability", "kept").toPandas().set_index("doc_id").sort_index()
    b = mixing.mix(mixing.described(docs), mixing.MixTarget(rounds=2), driver_cells=0).select("doc_id", "probability", "kept").toPandas().set_index("doc_id").sort_index()
    c = mixing.mix(mixing.described(docs), mixing.MixTarget(rounds=2)).select("doc_id", "probability", "kept").toPandas().set_index("doc_id").sort_index()
    assert np.allclose(b.probability, c.probability) and (b.kept == c.kept).mean() > 0.99
    assert len(a) == docs.count()
    assert set(mixing.sample(docs).toPandas().doc_id) == set(a[a.kept].index)
    assert mixing.mixed_documents(odd).count() == len(awkward()) and mixing.mixed_documents(empty).count() == 0
    assert mixing.sample(odd).columns == odd.columns
    clash = odd.withColumn("_source", F.lit("x")).withColumn("probability", F.lit(2.0)).withColumn("topic", F.lit("t")).withColumn("row", F.lit(1))
    assert mixing.sample(clash).columns == clash.columns
    assert mixing.mix(clash.withColumn("tokens", F.lit(3)).fillna("", ["source", "lang"])).count() == len(awkward())


@pytest.mark.parametrize("tokens,shares", [(0, {}), (10, {"source": {"nowhere": 1.0}})])
def test_mixing_in_tables_at_the_edges(spark, tokens, shares):
    rows = spark.createDataFrame([(i, f"s{i % 2}", "en", "x", tokens * (1 + i % 2)) for i in range(6)], "doc_id long, source string, lang string, topic string, tokens long")
    want = mixing.MixTarget(shares=shares, rounds=1)
    a, b = (sorted((r.doc_id, r.probability) for r in mixing.mix(rows, want, driver_cells=n).collect()) for n in (0, 100))
    assert len(a) == 6 and np.allclose(a, b) and min(p for _, p in a) > 0


def test_tokens_are_words(odd):
    got = mixing.described(odd).select("tokens").toPandas().tokens.tolist()
    assert got == [len(WORD.findall(t or "")) for _, t, *_ in awkward()]


