"""Decontamination, packing, quality and language against brute force, exact round trips and held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm.decontaminate import Benchmark, WuManber, contamination, drop_contaminated, words_of
from tallyward.llm.language import LanguageModel, fit_language, identify_language, letter_shares
from tallyward.llm.linear import dual_coordinate_descent
from tallyward.llm.packing import TIERS, pack_documents, tokenizer_path, word_tokens
from tallyward.llm.quality import HASHED, REPEATED_PAIRS, fit_quality, indicators, keep_good, score_quality, with_quality
from tallyward.llm.storage import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (None, "no id here at all", "en", None, 7),
       (5, "Twice. Twice!", "en", None, 7), (5, "Twice. Twice!", "en", None, 7), (7, "12 34 !!", "de", None, 8),
       (9, "long " * 60_000, "en", None, 300_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("x")).withColumn("found", F.lit(1)).withColumn("window", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- decontamination

def plain_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_hits(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        row = plain_words(body)
        width = min(window, len(row))
        grams = {tuple(row[i:i + width]) for i in range(len(row) - width + 1)} if row else set()
        for i in range(len(words) - width + 1 if row else 0):
            if tuple(words[i:i + width]) in grams:
                hit.update(range(i, i + width))
                found.add(item)
    return len(words), len(hit), len(found - {None})


def test_words():
    assert [w.decode() for w in words_of("A-b  Çé_x1\x7f2 {Z}".encode())] == plain_words("A-b  Çé_x1\x7f2 {Z}") == ["a", "b", "Çé", "x1", "2", "z"]


@pytest.mark.parametrize("length", [1, 2, 3, 10])
def test_wu_manber_finds_every_occurrence(length):
    rng = np.random.default_rng(length)
    text = rng.integers(0, 4, 3000).astype(np.int32)
    patterns = np.unique(rng.integers(1, 4, (300 if length > 3 else 3, length)).astype(np.int32), axis=0)
    patterns = np.unique(np.concatenate([patterns, [text[i:i + length] for i in (0, 500, 3000 - length) if (text[i:i + length] > 0).all()]
                                         or patterns[:1]]), axis=0).astype(np.int32)
    found = set(zip(*(x.tolist() for x in WuManber(patterns).search(text))))
    assert found == {(i, p) for i in range(len(text) - length + 1) for p, row in enumerate(patterns) if (text[i:i + length] == row).all()}


def test_short_items_overlaps_and_documents_that_touch():
    items = [("1", b"a b c"), ("2", b"c"), ("3", b""), (None, b"x y"), ("4", b"q r s t u v w x y z aa bb"), ("1", b"a b c")]
    texts = ["a b", "c a b c c", "x y", "", "p q r s t u v w x y z aa bb q", "r s t u v w x y z"]
    found = Benchmark(items).scan([words_of(t.encode()) for t in texts])
    for text, (hit, names) in zip(texts, found):
        assert (len(hit), int(hit.sum()), len(names)) == brute_hits(text, [(i, b.decode()) for i, b in items], 10)


def test_tables_are_a_few_times_the_text():
    rng = np.random.default_rng(2)
    words = [f"w{n:x}".encode() for n in range(60_000)]
    texts = [b" ".join(words[i] for i in row) for row in (rng.pareto(1.1, (1600, 700)) * 40 % len(words)).astype(int)]
    size = sum(map(len, texts))
    index = Benchmark([(str(n), text) for n, text in enumerate(texts)] + [(f"again{n}", texts[0]) for n in range(5000)])
    assert size > 4_000_000 and index.nbytes() < 10 * size  # 32 MB: below 320 MB, and the words
    hit, items = index.scan([words_of(texts[0][:400]), words_of(texts[7])])[1]
    assert hit.all() and "7" in items
    assert len(index.scan([words_of(texts[0])])[0][1]) >= 5001


def test_windows_that_repeat_are_stored_once():
    index = Benchmark([("1", b"a b c d e f g h i j k"), ("2", b"x a b c d e f g h i j"), ("3", b"a b c d e f g h i j k"), ("4", b"q")])
    assert [len(s.starts) for s in index.searches] == [1, 3]
    hit, items = index.scan([words_of(b"0 a b c d e f g h i j 0")])[0]
    assert hit.tolist() == [False, *[True] * 10, False] and items == {"1", "2", "3"}


def test_contamination_of_odd_rows_and_blocks(spark, odd, empty, monkeypatch):
    import tallyward.llm.decontaminate as module

    items = [(1, "twice twice"), (None, "id here"), (3, None), (4, ""), (5, "long " * 12), (1, "twice twice"), (6, "absent words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((r[0], *brute_hits(r[1], [(i, t or "") for i, t in items], 10)) for r in ODD)
    for size in (module.BLOCK_BYTES, 20):
        monkeypatch.setattr(module, "BLOCK_BYTES", size)
        got = contamination(odd, benchmark).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == expected
        assert all(r.contaminated == (r.n_hit > 0) for r in got)
    kept = drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]
    assert contamination(empty, benchmark).count() == 0
    assert contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0


# --- packing

def check_packing(rows, texts, tiers=TIERS):
    tokens = word_tokens(tokenizer_path()).tokenizer
    ids = {i: [*tokens.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length >= 1 and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
    assert pieces.keys() == ids.keys()
    for parts in [(sorted(p), len(ids[i])) for i, p in pieces.items()] + [
            (sorted((o, n) for o, n, _ in s), sum(n for _, n, _ in s)) for s in sequences.values()]:
        at = 0
        for start, length in parts[0]:
            assert start == at
            at += length
        assert at == parts[1]
    sizes = {k: sum(n for _, n, _ in s) for k, s in sequences.items()}
    assert all(n <= s[0][2] and len({w for _, _, w in s}) == 1 for (k, n), s in zip(sizes.items(), sequences.values()))
    return sizes, {k: s[0][2] for k, s in sequences.items()}


def test_packing_is_an_exact_round_trip(docs):
    parts = docs.coalesce(1)
    rows = pack_documents(parts).collect()
    sizes, windows = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(sizes[k] != windows[k] for k in sizes) <= 1
    assert len(set(windows.values())) > 1
    groups = defaultdict(set)
    for r in rows:
        groups[r.step_group, r.window].add(r.sequence_id)
    assert all(len(s) * window <= 16_384 for (_, window), s in groups.items())


def test_packing_odd_rows(odd, empty):
    rows = pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True).collect()
    check_packing(rows, {r[0]: r[1] for r in ODD if r[0] is not None})
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in pack_documents(odd).where("doc_id = 5").collect()) == 2 * rows[[r.doc_id for r in rows].index(5)].doc_tokens
    assert pack_documents(odd).where("doc_id is null").count() >= 1
    assert pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        pack_documents(odd, tiers=(100,))


def test_words_are_tokenized_as_in_their_text():
    import random

    rng = random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x250), 0x301, 0x308, 0x3A3, 0x2028, 0x3000, 0x1E9E, 0xFB01, 0x212A, 0x4E2D, 0x1F600]]
    texts = ["".join(rng.choice(letters) if rng.random() < .5 else rng.choice("abE's.,! \n12é") for _ in range(50)) for _ in range(1500)]
    texts += ["<|endoftext|> a<|endoftext|>b", "it's I'LL don't 'S", "ǅ ŉ ſ ß İ I", ""]
    tokens = word_tokens(tokenizer_path())
    for text, ids in zip(texts, tokens.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


# --- quality and language

def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1]), np.array([x, y])) for x, y in rng.normal(size=(300, 2))]
    signs = np.array([1.0 if r[1][0] + 2 * r[1][1] > 0.5 else -1.0 for r in rows])
    weights, bias = dual_coordinate_descent(rows, signs, 2, cost=100.0, rounds=200)
    assert np.mean([(r[1] @ weights + bias > 0) == (s > 0) for r, s in zip(rows, signs)]) > 0.97


def test_indicators_of_repeats_and_long_texts():
    assert not len(indicators(b""))
    assert set(indicators(b"so so so so")) > set(indicators(b"so"))
    assert np.array_equal(indicators(b"ab" * 700_000), indicators(b"ab" * 10))


def test_quality_of_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_quality_against_a_plain_recomputation(spark, docs, sf_dir):
    model = fit_quality(docs, table(spark, sf_dir, "labels"), rows_per_class=50)
    rows = {r.doc_id: (r.text, r.score) for r in with_quality(docs.select("doc_id", "text"), model).limit(80).collect()}
    for text, score in rows.values():
        data, seen = (text or "").encode(), set()
        for size in range(1, 5):
            for i in range(len(data) - size + 1):
                gram = int.from_bytes(data[i:i + size], "big")
                seen.add((gram + size) * 2654435761 % 2**32 >> 16)
        words = data.split()
        share = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
        seen |= {HASHED + n for n, bound in enumerate(REPEATED_PAIRS) if share > bound}
        norm = max(sum(float(model.ratio[g]) ** 2 for g in seen) ** 0.5, 1e-12)
        margin = sum(float(model.scaled[g]) for g in seen) / norm + model.bias
        assert abs(score - 1 / (1 + math.exp(-2 * margin))) < 1e-9


def test_quality_fit_is_repeatable_with_repeated_ids_and_disagreeing_labels(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    some = labels.select("doc_id").where("doc_id is not null").orderBy("doc_id").limit(8)
    again = docs.join(some, "doc_id").withColumn("text", F.concat(F.lit("zz "), F.col("text")))
    flipped = labels.join(some.limit(3), "doc_id").withColumn("quality", 1 - F.col("quality"))
    fits = [fit_quality(part, labels.unionByName(flipped), 30) for part in (
        docs.unionByName(again), again.unionByName(docs).repartition(7), docs.unionByName(again).unionByName(again))]
    assert all(np.array_equal(fits[0].scaled, fit.scaled) and fits[0].bias == fit.bias for fit in fits[1:])


def test_quality_odd_rows(spark, odd, empty, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    none = labels.limit(0)
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5}
    assert len(score_quality(odd, labels).collect()) == len(ODD)
    assert score_quality(empty, labels).count() == 0
    kept = keep_good(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_language_of_held_out_rows(docs):
    rows = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def plain_shares(text):
    """Square roots of the shares of hashed n-grams, letter by letter."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    letters = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    counts = Counter()
    for size in range(1, 4):
        for i in range(len(letters) - size + 1):
            gram = 0
            for place in range(size):
                gram = (gram * 0x01000193 + ord(letters[i + place]) * (place + 1 if place else 1)) % 2**32 if place else ord(letters[i])
            counts[(gram * 2654435761) % 2**32 >> 17] += 1
    total = sum(counts.values())
    return {number: (n / total) ** 0.5 for number, n in counts.items()}


def test_language_against_a_plain_recomputation(docs):
    model = fit_language(docs, rows_per_language=40)
    for row in docs.where("text is not null").limit(60).collect():
        shares = plain_shares(row.text)
        if not shares:
            continue
        found, values = letter_shares(row.text.encode())
        assert {int(n): round(v, 9) for n, v in zip(found, values)} == {n: round(v, 9) for n, v in shares.items()}
        margins = [sum(v * float(model.families.weights[n, c]) for n, v in shares.items()) + model.families.biases[c] for c in range(len(model.families.classes))]
        family = model.families.classes[int(np.argmax(margins))]
        duels = model.languages[family]
        votes, sure = Counter(), dict.fromkeys(duels.classes, 1.0)
        for a, b, weights, bias in duels.pairs:
            chance = 1 / (1 + math.exp(-2 * (sum(v * float(weights[n]) for n, v in shares.items()) + bias)))
            votes[duels.classes[a if chance >= 0.5 else b]] += 1
            sure[duels.classes[a]], sure[duels.classes[b]] = min(sure[duels.classes[a]], chance), min(sure[duels.classes[b]], 1 - chance)
        best = max(duels.classes, key=lambda c: (votes[c], sure[c]))
        # Weights are rounded to 32 bits: margins agree to some digits.
        language, score = model.predict(row.text.encode())
        assert language == best and abs(score - max(0.5, 1 / (1 + math.exp(-2 * max(margins)))) * sure[best]) < 1e-4


def test_many_languages_make_a_bounded_model():
    rng = np.random.default_rng(8)
    codes = [f"x{n:03d}" for n in range(150)] + ["de", "en", "nl", "fr", "es"]
    rows, labels = [], []
    for code in codes:
        marks = rng.choice(1 << 15, 40, replace=False)
        for _ in range(3):
            grams = np.unique(np.concatenate([rng.choice(marks, 30), rng.choice(1 << 15, 5)])).astype(np.int32)
            rows.append((grams, np.full(len(grams), len(grams) ** -0.5)))
            labels.append(code)
    model = LanguageModel.fit(rows, labels)
    assert model.nbytes() <= (152 + 4) * 4 * (1 << 15) < 21_000_000
    right = 0
    for (grams, shares), code in zip(rows, labels):
        family, _ = model.families.predict((grams, shares))
        right += model.languages[family].predict((grams, shares))[0] == code
    assert right > 0.97 * len(rows)


def test_language_with_clashing_columns_and_skew(spark, docs):
    mixed = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, "en").otherwise(F.col("lang")).alias("lang")).withColumns(
        {"score": F.lit(1), "lang_pred": F.lit("x"), "held_out": F.lit(None).cast("string")})
    assert identify_language(mixed).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert identify_language(mixed).count() == docs.count()


def test_language_odd_rows(odd, empty, docs):
    rows = {(r.doc_id, r.lang_pred) for r in identify_language(odd.select("doc_id", "text", "lang")).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= rows
    assert (5, "en") in rows
    assert identify_language(empty).count() == 0
    nothing = identify_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert letter_shares("Ab".encode())[0].tolist() == letter_shares("aB".encode())[0].tolist()
