"""Alignment, packing and vector codes against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import alignment, packing, registry, vector_codes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- alignment


def byte_letters():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in visible]
    return table | {chr(256 + k): b for k, b in enumerate(hidden)}


def brute_alignment(texts):
    import sentencepiece

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()

    def ranges(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def piece_bytes(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    docs, holding = [], Counter()
    for text in texts:
        own = None
        if text:
            raw = (" " + text).encode()
            e = tokenizer.encode(" " + text, add_special_tokens=False)
            a = ranges([(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)])
            b = ranges([(i, piece_bytes(i)) for i in model.encode(text)])
            joined = b"".join(bytes(letters[c] for c in t) for t in e.tokens), b"".join(piece_bytes(i) for i, *_ in b)
            if joined == (raw, raw):
                own = a, b, [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
                holding.update(set(own[2]))
        docs.append(own)
    highest = defaultdict(int)
    for (a, _), n in holding.items():
        highest[a] = max(highest[a], n)
    out = []
    for own in docs:
        if own is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links = own
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, first = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if first <= s and e <= end) for side in (a, b)))
            first = end
        best = sum(holding[x] == highest[x[0]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(holding[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [
    "a ", " ", "  ", " \n ", "x  y\t\n  z", "<|endoftext|> and </s> <s> it's", "▁ under ▁", "tabs\t\tand \x1c odd \x85 spaces​ here", "日本語 テキスト 🙂 café naïve",
    "a\x00b", "ﬁ ligature ½", "=" * 700, "- " * 300, "don't    stop\r\n\r\n", "﻿ bom", "é e ́", "𝔘𝔫𝔦 code", "Ünïcödé wörds, with: punctuation!? (and) [more]",
]


@pytest.fixture(scope="module")
def odd(prose):
    return [*prose, *ODD]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_alignment(spark, odd, frequent):
    rows = [(i % 50, t, "kept", "clash") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_links string, _number string").repartition(3)
    got = alignment.align(docs, A, B, frequent)
    assert got.columns == ["doc_id", "_number", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = Counter(tuple(r[c] for c in ("doc_id", *alignment.OWN)) for r in got.collect())
    assert found == Counter((i, *x) for (i, *_), x in zip(rows, brute_alignment(odd), strict=True))


def test_alignment_of_hard_texts():
    rng = random.Random(3)
    own = alignment.Aligner(A, B)
    alphabet = list(" \t\n  ab.'-é▁😀́") + ["<|endoftext|>", "</s>", "  ", "　", "\xa0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    want = [(x[0], x[1], x[2], x[6]) for x in brute_alignment(texts)]
    for _ in range(2):  # the second time with what is kept
        columns = [c.to_pylist() for c in own.align(texts)]
        assert list(zip(*columns[:4], strict=True)) == want
        assert [sum(x) for x in columns[5]] == columns[2] and all(len(set(x)) == len(x) for x in columns[4])


def test_alignment_of_nothing(spark, empty):
    assert alignment.align(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in alignment.align(none, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: x for d, x in zip(docs, brute_alignment([d["text"] for d in docs]), strict=True)}
    got = registry.op11_alignment(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in alignment.OWN) for r in got} == want and len(got) == len(docs)


# ---------------------------------------------------------------- packing


def brute_ids(texts):
    tokenizer = Tokenizer.from_file(A)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_pieces(rows, ids, capacity, tasks, padded=False):
    """rows: pieces with crc; ids: of documents by doc_id (a list each, for repeated ids)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    short = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        short += at < capacity
        assert padded or at == capacity or at & (at - 1) == 0
    assert short <= tasks * capacity.bit_length()
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        texts = ids[doc_id]
        assert sum(r["length"] for r in pieces) == sum(map(len, texts))
        want = Counter()
        for r in pieces:
            fits = [x for x in texts if r["doc_tokens"] == len(x) and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["crc"]]
            assert fits
            want[len(fits)] += 1
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]


@pytest.mark.parametrize("capacity, chunk", [(2048, 1 << 22), (64, 500), (10, 100), (1, 50)])
def test_packing(spark, docs, prose, capacity, chunk):
    rows = packing.pack(docs, A, capacity, chunk=chunk).withColumn("crc", F.crc32("ids")).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ids = defaultdict(list)
    for (doc_id, _), x in zip(texts, brute_ids([t for _, t in texts]), strict=True):
        ids[doc_id].append(x)
    check_pieces(rows, ids, capacity, docs.rdd.getNumPartitions())


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = defaultdict(list)
    for d, x in zip(docs, brute_ids([d["text"] for d in docs]), strict=True):
        ids[d["doc_id"]].append(x)
    got = registry.op12_packing(spark, SF)
    rows = got.withColumnRenamed("ids_crc32", "crc").collect()
    check_pieces(rows, ids, 2048, got.rdd.getNumPartitions())
    assert rows == got.withColumnRenamed("ids_crc32", "crc").collect()  # reruns agree


def test_sequences(spark, docs):
    pieces = packing.pack(docs, A, 256).cache()
    for padded in (False, True):
        pieces = packing.pack(docs, A, 256, pad_last=padded)
        for r in packing.sequences(pieces, 256, 7).collect():
            n = len(r["ids"]) // 4
            assert n == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 256)
            assert set(np.frombuffer(r["ids"], "<u4")[r["n_tokens"] :].tolist()) <= {7}
            own = pieces.where(F.col("sequence_id") == r["sequence_id"]).orderBy("offset").collect() if r["n_tokens"] < 256 else []
            assert not own or (b"".join(p["ids"] for p in own) == bytes(r["ids"])[: 4 * r["n_tokens"]] and [p["offset"] for p in own] == r["starts"])


def test_fill_is_the_minimum_slack():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        stock = sorted(((n, rng.randint(1, 4)) for n in rng.sample(range(1, 40), rng.randint(1, 6))), reverse=True)
        taken = packing.fill(capacity, stock)
        assert all(n <= dict(stock)[length] for length, n in taken.items())
        sums = {0}
        for length, n in stock:
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
        assert sum(length * n for length, n in taken.items()) == max(sums)


def test_packing_nothing(spark, empty):
    assert packing.pack(empty, A).collect() == []
    none = spark.createDataFrame([(None, None), (3, "")], "doc_id bigint, text string").coalesce(1)
    got = packing.pack(none, A).collect()
    assert sorted((r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in got) == [(0, 1, 1, 0), (0, 1, 1, 1)]


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label) of kept vectors; python integers throughout."""
    import math

    whole = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in whole]
    books = [[list(cut[k][p]) for k in order[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        given = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, g in zip(cut, given, strict=True) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    given = assign()
    errors = [sum(g[0] for g in x) for x in given]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    said = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    top = 2**63 - 1
    return Counter((i, "".join(f"{g[1]:02x}" for g in x), min(e, top), min(by_label[label], top), said) for (i, _, label), x, e in zip(rows, given, errors, strict=True))


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("parts, entries, rounds, spread", [(4, 5, 2, 1.0), (2, 64, 1, 0.05), (8, 3, 0, 3.0), (4, 7, 3, 5e3), (4, 4, 2, 3e7)])
def test_vector_codes(spark, parts, entries, rounds, spread):
    rng = random.Random(entries)
    rows = [(rng.randint(0, 90), [rng.gauss(0, spread) for _ in range(8)], rng.choice([None, 0, 1, 2])) for _ in range(150)]
    rows += [(k, list(rows[k][1]), 0) for k in range(20)] + [(None, rows[3][1], None), (rows[4][0], [0.0] * 8, 1)]
    bad = [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [float("nan")] * 8, 0), (4, [float("inf")] + [0.0] * 7, 0), (None, None, None)]
    schema = "vec_id bigint, embedding array<double>, label int, error string, _whole string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + bad], schema).repartition(3)
    got = vector_codes.compress(df, parts, entries, rounds)
    assert got.columns == ["vec_id", "label", "_whole", *vector_codes.OWN]
    found = Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())
    assert found == brute_codes(rows, parts, entries, rounds, 256)


def test_vector_codes_with_rare_labels_joined(spark, monkeypatch):
    rows = [(i, [float(i * j % 7) for j in range(4)], None if i % 3 == 0 else i % 11) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = brute_codes(rows, 2, 6, 2, 256)
    monkeypatch.setattr(vector_codes, "LABELS", 3)
    assert Counter(tuple(r[c] for c in ("vec_id", *vector_codes.OWN[:1], "error", "label_error", "codebooks_sha256")) for r in vector_codes.compress(df, 2, 6).collect()) == want


def test_vectors_of_other_lengths_and_none(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, [], 0), (4, [3.0, 4.0], 0)]
    assert sorted(r["vec_id"] for r in vector_codes.compress(spark.createDataFrame(rows, schema), 2).collect()) == [1, 4]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame(rows[:1], schema), 3)


def test_search_is_exact():
    rng = np.random.default_rng(0)
    for spread in (3, 50, 10**6, 10**12):
        points, book = rng.integers(-spread, spread, (400, 3)), rng.integers(-spread, spread, (30, 3))
        book[7] = book[3]
        at, far = vector_codes.nearest(points, book, rng.integers(0, 30, 400))
        full = ((points.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(-1)
        assert [int(x) for x in far] == [min(r) for r in full.tolist()] and at.tolist() == [r.index(min(r)) for r in full.tolist()]


def test_vector_codes_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = registry.op13_vector_codes(spark, SF).collect()
    assert Counter(tuple(r) for r in got) == brute_codes([r for r in rows if finite(r[1])], 16, 64, 2, 256)
