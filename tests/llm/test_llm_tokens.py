"""Chunked BPE and the alignment of two tokenizers against the libraries on whole texts."""

import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import tallyward.llm.alignment as alignment
import tallyward.llm.bpe_chunks as bpe_chunks
from tallyward.llm.alignment import Alignment, SparseRows, align_documents, token_links, tokenize_both
from tallyward.llm.bpe_chunks import ChunkEncoder, chunks_of, cut_chunks, decode_documents, encode_documents
from tallyward.llm.segments import byte_letters, vocabulary
from tallyward.llm.storage import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " ", None, None, 1), (None, "no id here at all", "en", None, 7),
       (5, "Twice. Twice!", "en", None, 7), (5, "Twice. Twice!", "en", None, 7), (7, "a<|endoftext|> b <|endoftext|>", "de", None, 8),
       (8, "x▁y ▁", "en", None, 5), (9, "long wörds " * 30_000, "en", None, 330_000), (10, "unbroken" * 20_000, "en", None, 160_000),
       (11, "tabs\tand\r\n lines　wide \x00 中文 😀", "zh", None, 30), (12, "<s> <unk> <0x41> </s>", "en", None, 20)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n_tokens", F.lit("x")).withColumn("n_a", F.lit(1)).withColumn("a_ids", F.lit(2))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(seed, count, length):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(1, 0x250), 0x301, 0x3A3, 0x180E, 0x200B, 0x2028, 0x3000, 0x1E9E, 0xFB01, 0x4E2D, 0x1F600, 0x2581, 0xFEFF]]
    words = ["<|endoftext|>", "<|endof", "don't", "'re", "I'LL", " ", "  ", "\n", " \n ", "\t", "word", "123", "e.", "é"]
    return ["".join(rng.choice(letters) if rng.random() < .3 else rng.choice(words) for _ in range(rng.randint(0, length))) for _ in range(count)]


# --- byte-level BPE by chunks

def test_vocabulary_equals_the_library_on_odd_texts_and_on_its_own_tokens(library):
    rng = random.Random(5)
    tokens = vocabulary("bytes", "byte_bpe_50k.json")
    own = [tokens.bytes[i].decode("utf-8", "ignore") for i in range(50_256)]
    texts = odd_texts(1, 2000, 40) + ["".join(rng.choice(own) for _ in range(15)) for _ in range(20_000)]
    texts += ["".join(rng.choice("etaoinshrdlu.,-=#1230") for _ in range(300)) for _ in range(500)]
    library.encode_special_tokens = True
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in tokens.encode(texts)] == expected
    library.encode_special_tokens = False
    special = vocabulary("bytes", "byte_bpe_50k.json", special=True)
    expected = [e.ids for e in library.encode_batch(texts[:2000], add_special_tokens=False)]
    assert [ids.tolist() for ids in special.encode(texts[:2000])] == expected


def test_same_passages_give_the_same_chunks():
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(4000)).encode()
    texts = [passage, b"other words first, " * 40 + passage, "é".encode() * 9000]
    found = cut_chunks(texts)
    assert [b"".join(parts) for parts in found] == texts
    assert all(len(part) >= bpe_chunks.LEAST_CHUNK for parts in found for part in parts[:-1])
    assert len(set(found[0]) & set(found[1])) > 0.8 * len(found[0]) > 5
    assert chunks_of("aé".encode() * 200, np.array([302]))[1][:1] == b"a"


@pytest.mark.parametrize(("bits", "least"), [(10, 256), (4, 3)])
def test_repaired_joins_are_exact(monkeypatch, library, bits, least):
    monkeypatch.setattr(bpe_chunks, "CHUNK_BITS", bits)
    monkeypatch.setattr(bpe_chunks, "LEAST_CHUNK", least)
    rng = random.Random(3)
    texts = odd_texts(4, 300, 300) + [" ".join(rng.choice(["it's", "a", "word,", "I'll", "12", "\n", "end."]) for _ in range(900)) for _ in range(40)]
    texts += ["<|endoftext|>" * 300, "a" * 5000, " " * 5000, ""]
    encoder = ChunkEncoder(vocabulary("bytes", "byte_bpe_50k.json", special=True))
    found = encoder.pieces(cut_chunks([t.encode() for t in texts]))
    assert sum(len(pieces) > 3 for pieces in found) > 20
    for text, pieces in zip(texts, found):
        assert b",".join(p[1] for p in pieces if p[0]).decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert b"".join(p[2] for p in pieces) == text.encode()


def brute_codes(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_encoding_of_whole_documents(docs, odd, library):
    for frame in (docs, odd.select("doc_id", "text")):
        expected = Counter((r.doc_id, *brute_codes(library, r.text)) for r in frame.collect())
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(frame).collect()) == expected


def test_round_trip_clashing_columns_and_empty_table(odd):
    encoded = encode_documents(odd, with_ids=True)
    assert encoded.columns == [*odd.columns, "n_tokens_", "ids_sha256", "decoded_sha256", "ids"]
    rows = decode_documents(encoded, column="text").collect()
    assert len(rows) == len(ODD) and all(r.text_ == (r.text or "") and len(r.ids) == 4 * r.n_tokens_ for r in rows)
    assert encode_documents(odd.limit(0)).count() == decode_documents(encoded.limit(0)).count() == 0
    cut = encoded.where("doc_id = 11").select(F.expr("substring(ids, 1, 4 * (n_tokens_ - 1))").alias("ids"), F.lit(None).cast("binary").alias("none"))
    assert decode_documents(cut).first().decoded.endswith("�") and decode_documents(cut, "none").first().decoded is None


# --- alignment

def dense(matrix):
    out = np.zeros((len(matrix.starts) - 1, matrix.width), int)
    for row in range(len(out)):
        for column in matrix.columns[matrix.starts[row]:matrix.starts[row + 1]]:
            out[row, column] += 1
    return out


def test_row_products_equal_dense_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, 60), 12, replace=False)), [60]])) for _ in range(2))
        x, y = SparseRows.of_lengths(a), SparseRows.of_lengths(b).transposed()
        product = np.zeros((len(a), len(b)), int)
        row, column, value = x.times(y)
        product[row, column] = value
        assert np.array_equal(product, dense(x) @ dense(y))
        assert np.array_equal(dense(x.transposed()), dense(x).T)
    assert all(len(part) == 0 for part in SparseRows.of_lengths(np.empty(0, int)).times(SparseRows.of_lengths(np.empty(0, int)).transposed()))


def token_spans(library, pieces, text):
    """(id, first byte, end) of both tokenizers' tokens, none where the bytes differ."""
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    library.encode_special_tokens = True
    both = []
    ids = library.encode(" " + text, add_special_tokens=False).ids
    both.append([(i, bytes(of_letter[c] for c in library.id_to_token(i))) for i in ids])
    both.append([(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
                 for i in pieces.encode(text)])
    if not text or any(b"".join(b for _, b in side) != (" " + text).encode() for side in both):
        return [], []
    spans = []
    for side in both:
        at, out = 0, []
        for i, b in side:
            out.append((i, at, at + len(b)))
            at += len(b)
        spans.append(out)
    return spans


def brute_alignment(library, pieces, rows):
    documents, counts = [], Counter()
    for doc_id, text in rows:
        a, b = token_spans(library, pieces, text or "")
        links, first = [], 0
        for x, start, end in a:
            while first < len(b) and b[first][2] <= start:
                first += 1
            at = first
            while at < len(b) and b[at][1] < end:
                links.append((x, b[at][0]))
                at += 1
        counts.update(links)
        cuts = sorted({end for _, _, end in a} & {end for _, _, end in b})
        groups = [[[], []] for _ in cuts]
        for side, spans in enumerate((a, b)):
            for number, (_, part) in enumerate(groupby(spans, lambda s: next_cut(cuts, s[2]))):
                groups[number][side] = [i for i, _, _ in part]
        documents.append((doc_id, len(a), len(b), groups, links))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    for doc_id, n_a, n_b, groups, links in documents:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(counts[link] == highest[link[1]] for link in links),
               sum(counts[link] for link in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
               sum(len(g[0]) * len(g[1]) for g in groups))


def next_cut(cuts, end):
    from bisect import bisect_left

    return bisect_left(cuts, end)


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 300])
def test_alignment_against_brute_force(spark, docs, odd, library, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    frame = docs.select("doc_id", "text").where("doc_id < 60").unionAll(odd.select("doc_id", "text")) if most < 1000 else docs
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert Counter(tuple(r) for r in align_documents(frame).collect()) == Counter(brute_alignment(library, pieces, rows))


def test_alignment_of_odd_columns_and_empty_table(odd):
    assert align_documents(odd).count() == len(ODD)
    assert align_documents(odd.limit(0)).count() == 0
    zeros = {r.doc_id: tuple(r)[1:] for r in align_documents(odd.where("doc_id in (1, 2, 8)")).collect()}
    assert zeros == dict.fromkeys((1, 2, 8), (0, 0, 0, 0, 0, 0, "", 0))


def test_links_as_rows(odd):
    tokens = tokenize_both(odd.where("doc_id in (5, 11, 1)"))
    aligned = {r.doc_id: r for r in align_documents(odd.where("doc_id in (5, 11, 1)")).collect()}
    links = token_links(tokens).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("shared")).collect()
    found = {(r.doc_id, r.kind): (r.n, r.shared) for r in links}
    assert found[11, "overlap"] == (aligned[11].n_links, len((" " + ODD[10][1]).encode()))
    assert found[11, "group"] == (aligned[11].n_group_links,) * 2
    assert found[5, "overlap"][0] == 2 * aligned[5].n_links and (1, "overlap") not in found


def test_documents_never_share_a_group():
    a = b = np.array([3, 4, 5], np.int64)
    found = Alignment.of(a, b, np.array([2, 1, 3]), np.array([1, 2, 3]))
    assert found.a_starts.tolist() == [0, 2, 3] and found.b_starts.tolist() == [0, 2, 3]
    assert [x.tolist() for x in found.links] == [[0, 0, 1, 2], [0, 1, 1, 2], [1, 1, 1, 3]]
