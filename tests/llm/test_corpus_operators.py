"""Operators across documents, and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import components, decontaminate, mixing, near_dup, quality_rules, rans, registry, suffix_dedup, token_output
from ledgerline.llm.suffix_sort import suffix_array

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_classes(rows, n, percent):
    """(class, number of linked rows) by position; equal ids are one document."""
    sets = [shingles(t, n) for _, t in rows]
    parent = {i: i for i, _ in rows}
    links = Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return [(len(s), root(i), links[i]) for s, (i, _) in zip(sets, rows, strict=True)]


@pytest.mark.parametrize("n, percent, chunk", [(3, 90, 4096), (5, 80, 4096), (1, 50, 4), (2, 70, 3)])
def test_near_duplicates(spark, prose, n, percent, chunk):
    rng = random.Random(n)
    texts = list(prose)
    for _ in range(60):  # chains of small changes
        w = rng.choice(texts[:40]).split(" ")
        for _ in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
        texts.append(" ".join(w))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    found = near_dup.join(spark.createDataFrame(rows, "doc_id bigint, text string"), n, percent, chunk).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in found}
    want = {i: x for (i, _), x in zip(rows, near_classes(rows, n, percent), strict=True)}
    assert got == want


def test_near_duplicates_of_odd_rows(docs, empty):
    found = near_dup.join(docs.withColumn("component_id", F.lit(1)).withColumn("a", F.lit(1))).collect()
    assert len(found) == docs.count()
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in found if r["doc_id"] == 10} == {10}
    kept = near_dup.distinct(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 10 in ids and None in ids and 40 not in ids
    assert near_dup.join(empty).count() == near_dup.distinct(empty).count() == 0


def test_near_duplicates_of_long_texts_copies_and_built_words(spark):
    rng = random.Random(4)
    bits = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    one, other = "".join(bits), "".join("b" if x == "a" else "a" for x in bits)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(450_000))  # 2.7 MB, over a slice
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = [" ".join([*base[:60], f"x{k}", *base[61:]]) for k in range(40)]
    rows = [(1, one), (2, other), (3, long), (4, long + " end"), (5, "short " + long[:1000])]
    rows += [(100 + i, near[i % 40]) for i in range(400)] + [(9, near[0]), (9, "quite another text of six words"), (8, "Quite another text OF six words")]
    rng.shuffle(rows)
    small = [r for r in rows if r[0] not in (3, 4, 5)]
    classes = {i: c for (i, _), (_, c, _) in zip(small, near_classes(small, 3, 90), strict=True)}
    for chunk in (4096, 7):
        found = near_dup.join(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=chunk).collect()
        assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] not in (3, 4, 5)} == classes
        assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
        assert {r["n_links"] for r in found if 100 <= r["doc_id"]} == {400}
    assert near_dup.distinct(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 6


def test_bitmaps_are_halved_when_they_are_large(monkeypatch):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 4000, 300).astype(np.uint64)) for _ in range(12)]
    sets = base + [np.unique(np.append(s[rng.random(len(s)) > 0.03], rng.integers(0, 4000, 4).astype(np.uint64))) for s in base]

    def told(limit, side):
        monkeypatch.setattr(near_dup, "BITMAPS", limit)
        links, edges = Counter(), set()
        for part in near_dup.join_block(sets, list(range(len(sets))), [1] * len(sets), side, 90):
            for i, r, n in zip(part["id"].tolist(), part["root"].tolist(), part["links"].tolist(), strict=True):
                links[i] += n
                edges.add((i, r))
        groups = {i: i for i in range(len(sets))}
        for i, r in sorted(edges):
            a, b = groups[i], groups[r]
            groups = {k: min(a, b) if v in (a, b) else v for k, v in groups.items()}
        return {k: v for k, v in links.items() if v}, groups

    for side in (np.zeros(len(sets), np.uint8), (np.arange(len(sets)) % 2).astype(np.uint8)):
        assert told(1 << 30, side) == told(600, side)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 10), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 30)] + [(100, k) for k in range(101, 160)] + [(1000, k) for k in range(1001, 9000)]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys((1, 2, 3, 9), 1) | dict.fromkeys((10, 20), 10) | dict.fromkeys(range(30, 35), 30) | dict.fromkeys(range(100, 160), 100) | dict.fromkeys(range(1000, 9000), 1000)
    assert got == want


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for trial in range(150):
        k, depth = rng.choice([1, 2, 3, 20]), rng.choice([1, 3, 10, 200])
        texts = [bytes(rng.choice(range(97, 97 + k)) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        texts += texts[:2] * (trial % 3 == 0)
        order, common, _ = suffix_array(texts, depth, rng.choice([None, 50]))
        joined = b"".join(x + b"\0" for x in texts)
        assert sorted(order.tolist()) == list(range(len(joined)))
        for i in range(1, len(order)):
            a, b = joined[order[i - 1] :], joined[order[i] :]
            assert a[:depth] <= b[:depth]
            m = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if b"\0" not in a[: min(m, depth)]:
                assert common[i] == min(m, depth)


def removed(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        yield len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("window", [200, 40])
def test_suffix_dedup(spark, docs, empty, prose, window):
    rows = docs.select("doc_id", "text").collect()
    extra = ["ab" * 300, "aaaa" * 100, "x" + "ab" * 150, "é" * 260, "\0" * 250, prose[7] * 2]
    df = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"), allowMissingColumns=True)
    texts = [(r[0], (r[1] or "").encode()) for r in rows] + [(1000 + i, t.encode()) for i, t in enumerate(extra)]
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in map(tuple, suffix_dedup.digests(df, window).collect()))
    want = sorted((-1 if i is None else i, *w) for (i, _), w in zip(texts, removed([t for _, t in texts], window), strict=True))
    assert got == want
    odd = df.withColumns({"row": F.lit(5), "kept": F.lit("k")})
    cut = {r["doc_id"]: r for r in suffix_dedup.cut(odd, window).collect()}
    assert cut[1001]["text"] == "" and (cut[1001]["row"], cut[1001]["kept"]) == (5, "k") and suffix_dedup.cut(df, window).columns == df.columns
    assert suffix_dedup.digests(empty, window).count() == 0


def test_rans_round_trip_checkpoints_and_damage():
    rng = np.random.default_rng(2)
    for n, high in ((0, 5), (1, 1), (63, 2), (70_000, 3), (300_001, 50_000), (5000, 70_000)):
        ids = np.minimum(rng.geometric(0.01, n), high).astype(np.uint32)
        if n > 1000:
            ids[::7] = rng.integers(0, high, len(ids[::7]))
        counts = np.bincount(ids, minlength=1)
        symbols = np.flatnonzero(counts) if n else np.zeros(1, np.int64)
        table = rans.Table.of(symbols, np.maximum(counts[symbols], 1))
        assert table.scaled.sum() == 1 << table.bits and table.scaled.min() >= 1
        block = rans.encode(ids, table)
        again, used = rans.Table.from_bytes(table.to_bytes() + b"rest")
        assert used == len(table.to_bytes()) and (rans.decode(block, again) == ids).all()
    marks = int(np.frombuffer(rans.encode(ids, table), "<u4", 5)[4])
    ids = np.minimum(rng.geometric(0.01, 900_000), 900).astype(np.uint32)
    counts = np.bincount(ids)
    table = rans.Table.of(np.flatnonzero(counts), counts[np.flatnonzero(counts)])
    block = rans.encode(ids, table)
    marks = int(np.frombuffer(block, "<u4", 5)[4])
    assert marks > 2
    parts = [rans.decode(block, table, k, 1) for k in range(marks)]
    assert (np.concatenate(parts) == ids).all()
    assert len(block) < 1.1 * -(counts[counts > 0] * np.log2(counts[counts > 0] / counts.sum())).sum() / 8
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(block[:-5] + bytes([block[-5] ^ 1]) + block[-4:], table)


@pytest.mark.parametrize("segment", [1 << 22, 300])
def test_token_output(spark, docs, empty, segment):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path())
    path = token_output.write(docs, registry.tokenizer_path(), segment=segment)
    rows = token_output.read(spark, path).orderBy("start").collect()
    texts = {}
    for i, t in docs.select("doc_id", "text").collect():
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        want = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[r["doc_id"]]]
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want
        at += r["n_tokens"]
    assert sorted(map(tuple, (r["ids"] for r in token_output.read_ids(spark, path).collect()))) == sorted(tuple(x) for v in texts.values() for x in v)
    assert token_output.read(spark, token_output.write(empty, registry.tokenizer_path())).count() == 0


def filled(sizes, weights, share, most):
    total, names = share * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = total / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
            total -= most * sizes[s] if over else 0
        open_ = open_ - set(over) if over else set()
    return target


@pytest.mark.parametrize("chunk, fan", [(2000, 64), (5, 4)])
def test_mixing(spark, docs, empty, chunk, fan):
    rng = random.Random(8)
    more = [(2000 + i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["s0", "s0", "s1", "tiny", None])) for i in range(400)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"), allowMissingColumns=True)
    rows = mixing.mix(df, chunk=chunk, fan=fan).collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    want = filled(size, (3, 1, 2), 1.5, 2.0)
    taken, largest = Counter(), Counter()
    assert len(rows) == df.count()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:  # half of the smallest document that has words, but for sources of a few documents
        own = sorted(r["size"] for r in rows if r["source"] == s and r["size"])
        assert abs(taken[s] - want[s]) <= (own[0] / 2 + 1 if len(own) > 20 else largest[s] / 2) + 1e-6
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(rows) == key(mixing.mix(df.repartition(7), chunk=chunk, fan=fan).collect())
    odd = df.withColumns({"p": F.lit(5), "_number": F.lit("k"), "target": F.lit(1), "copies": F.lit(9), "_path": F.lit("x")})
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).where("p = 5 and _number = 'k' and copies = 9").count() == sum(r["copies"] for r in mixing.mix(df).collect())
    assert mixing.mixed(df).columns == df.columns
    again = Counter(tuple(r)[:2] for r in mixing.mixed(df).collect())
    assert sum(again.values()) == sum(r["copies"] for r in mixing.mix(df).collect()) and again == Counter(tuple(r)[:2] for r in mixing.mixed(df.repartition(5)).collect())
    assert mixing.mixed(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    df = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(3000)], "doc_id bigint, text string, source string")
    share = mixing.mix(df).groupBy("source").agg((F.sum("taken") / F.first("target")).alias("r"))
    assert all(abs(r["r"] - 1) < 0.002 for r in share.collect())


def test_mixing_reaches_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_source = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(by_source) > 10 and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in by_source)


def test_settling_keeps_expectations_and_sums():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 60) for _ in range(50)), reverse=True)
    p = [rng.random() for _ in sizes]
    took = np.zeros(len(sizes))
    for run in range(3000):
        x = mixing.settled([{"doc_id": (run, k), "size": s, "_p": q} for k, (s, q) in enumerate(zip(sizes, p, strict=True))])
        took += x
        assert abs(sum(a * s for a, s in zip(x, sizes, strict=True)) - sum(q * s for q, s in zip(p, sizes, strict=True))) <= sizes[-1] / 2 + max(0, sizes[-2] - sizes[-1])
    assert all(abs(t / 3000 - q) < 0.06 for t, q in zip(took[:40], p[:40], strict=True))


def test_pipeline(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    passed = [docs]
    for k, f in enumerate(stages):
        out = f(spark, passed[-1], source)
        out.write.parquet(str(tmp_path / str(k)))
        passed.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(stages) - 1:
            assert out.columns == docs.columns
    kept = {r["doc_id"]: r["cleaned"] for r in quality_rules.measure(docs).where("kept").collect()}
    assert {r["doc_id"]: r["text"] for r in passed[1].collect()} == kept
    rows = sorted(kept.items())
    first = {i for (i, _), (_, c, _) in zip(rows, near_classes(rows, 5, 80), strict=True) if i == c}
    assert {r["doc_id"] for r in passed[2].collect()} == first
    bad = {r["doc_id"] for r in decontaminate.contamination(passed[2], spark.read.parquet(f"{source}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in passed[3].collect()} == first - bad
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(passed[3]).collect()}
    assert Counter(r["doc_id"] for r in passed[4].collect()) == Counter({k: v for k, v in copies.items() if v})
    ran = corpus_pipeline.run(spark, source)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, passed[5].collect()))
    assert ran.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_packed_keys_are_small_and_whole():
    """Fourteen bytes a key before compression (a row of three longs before: 24 and a null), and every edge is found from them."""
    import numpy as np
    import pyarrow as pa

    from ledgerline.llm import near_dup

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    owner = rng.integers(0, 1 << 60, 5000)
    rows = list(near_dup.packed(key, owner))
    assert sum(len(k) + len(o) for _, k, o in rows) == 14 * 5000
    back = [near_dup.unpacked(k, o) for _, k, o in rows]
    assert (np.concatenate([o for _, o in back]) == owner).all()
    assert (np.concatenate([k for k, _ in back]) == (key >> np.uint64(4)) & np.uint64((1 << 48) - 1)).all()
    other = list(near_dup.packed(key[::2], owner[::2] + 1))
    both = sorted([(*r, None, None) for r in [*rows, *other]] + [(7, None, None, 1, 2)], key=lambda r: r[0])
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*both), kinds, strict=True)], names=["bucket", "keys", "owners", "a", "b"])
    found = {p for e in near_dup._edges(iter([batch.slice(0, 900), batch.slice(900)])) for p in zip(*[c.to_pylist() for c in e.columns])}
    assert found == {(int(o), int(o) + 1) for o in owner[::2]} | {(1, 2)}
