"""N-gram Jaccard join with signature trees.

Exact: documents whose sets of word n-grams (64-bit hashes) have a Jaccard
similarity of at least `percent` / 100 are linked, and none of these links is lost.

1. Blocks.  Of two such sets with sizes in one class (the smaller between l and a fixed
   multiple of l) at most d members differ, so if each set is dealt by hash to more than
   d parts, one part is equal in both.  The sums of the parts' members are the keys under
   which a document is known (a document is in the class of its own size and in those of
   the smaller partners it may have; keys_of() says how empty parts and members that are
   common in the corpus are kept out of the keys).  A key that several documents of one batch share
   leaves the task once, packed with others of its bucket; edges to the least document of
   each key follow where a bucket's keys meet, and their components are clusters outside of which no link exists.
2. Signature trees.  A cluster's members that two sets share get one bit each.  Sets
   are leaves; nodes of 16 hold the OR of their bitmaps and the range of sizes.  Two
   trees (or one with itself) are walked together from the roots: a pair of nodes goes
   on only if the bits that both hold, and the larger sizes, can reach the overlap
   that the smaller sizes need.  At the leaves the bits are the members themselves and
   the overlap is exact.  A cluster of more than 512 different sets is cut into chunks (up
   to eight of 512 to 4096 sets, then as many of 4096 as it takes), and every pair of
   chunks is a task of its own, so that no cluster is one task's load.  A text is dealt
   once for each chunk of its cluster; what that takes beyond the corpus's own bytes is
   dealt in further rounds, whose shuffles are deleted before the next one.
   Of sets that are equal (by 128-bit digests) one stands for all: a cluster's copies
   are collapsed, map-side first, before its texts are dealt to tasks.
3. Each task reports a spanning forest and numbers of links, not pairs; components of
   all forests are the classes, and documents follow the set that stands for theirs.

Edge cases: null and empty texts have empty sets and no links; texts with fewer than n
words are one gram; rows without an id have no links; rows that repeat an id are one
document whose sets are all compared; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, most_frequent, numbered
from .common import stored_alone as stored
from .components import components
from .textscan import LOWER, SPACED, grams, mix, raw, slices, word_hashes, word_spans

FAN, DEALS = 16, 12
#: Members counted at once; documents of these that hold a frequent one; frequent ones kept (8 bytes each).
MEMBERS, OFTEN, COMMON = 1 << 20, 4, 100_000
#: Documents and characters of a chunk, about; chunks that a smaller cluster is spread over, of at least CHUNK / SPREAD.
CHUNK, CHARS, SPREAD = 4096, 16 << 20, 8
#: Bytes of text that a round deals at least.
ROUND = 1 << 30
#: Keys of a batch; buckets that keys are dealt to.
KEYS, BUCKETS = 1 << 18, 1 << 12
#: Bytes of text that are hashed at once: some 70 bytes of memory for each.
PIECE = 1 << 18
U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-grams)."""
    for i, j, data, offsets in slices(column, PIECE):
        data = LOWER[data]
        starts, ends, row = word_spans(data, offsets, SPACED)
        hashes = word_hashes(data, starts, ends)
        whole = grams(hashes, n)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= n:
                yield i + r, np.unique(whole[a : b - n + 1])
            elif b > a:
                yield i + r, grams(hashes[a:b], b - a)
            else:
                yield i + r, whole[:0]


def digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two signed numbers."""
    said = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
    return int.from_bytes(said[:8], "little", signed=True), int.from_bytes(said[8:], "little", signed=True)


def _digests(n: int):
    """Rows (doc_id, n_shingles, low, high, bytes) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lows, highs = [], [], []
            for _, members in shingle_sets(batch.column(1), n):
                low, high = digest(members)
                sizes.append(len(members))
                lows.append(low)
                highs.append(high)
            columns = [pa.array(x, pa.int64()) for x in (sizes, lows, highs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(np.diff(raw(batch.column(1))[1]))], names=["doc_id", "n_shingles", "low", "high", "bytes"]
            )

    return run


def _class(size: int, ratio: float) -> int:
    return int(np.floor(np.log(size) / np.log(ratio) + 1e-9))


def ratio_of(percent: int) -> float:
    return 1.5 if percent >= 90 else 1.25


def size_classes(size: int, percent: int) -> range:
    """Numbers of the classes that a set of this size is known in: its own and its smaller partners'."""
    ratio = ratio_of(percent)
    return range(_class(-(-size * percent // 100), ratio), _class(size, ratio) + 1)


@cache
def parts_of(klass: int, percent: int) -> tuple[int, int]:
    """(parts, empty parts that are provided for), for pairs whose smaller set is in the class.

    With J >= p/100 the symmetric difference is at most d = (1 - J) / (1 + J) * (a + b),
    and b <= a * 100 / p.  Of d + 1 + e parts, e + 1 are equal in both sets."""
    ratio, j = ratio_of(percent), percent / 100
    least, largest = ratio**klass, np.ceil(ratio ** (klass + 1)) + 1
    d = int(largest * (1 + 1 / j) * (1 - j) / (1 + j) + 1e-9)
    e = 0
    while e < (d + 2 if d else 0):  # up to what a small set of the class usually has
        p = d + 1 + e
        mean = p * np.exp(-least / p)
        if e >= mean + 1.5 * np.sqrt(mean):
            break
        e += 1
    return d + 1 + e, e


def keys_of(members: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The sums of the members of every part that has any, for all classes of a set.

    A part that is empty in both sets says nothing, so such parts give no key.  If one of
    two linked sets has at most e empty parts, one of the e + 1 equal parts isn't empty.  A
    set with more is dealt again by another hash, and so on until it has not: whichever of
    two sets is done first, both have keys in that dealing.  The first dealing leaves out
    the members that are common in the corpus (any fixed choice keeps the bound), lest
    passages that many documents share join them all."""
    todo = list(size_classes(len(members), percent))
    out = []
    for deal in range(DEALS):
        base = members
        if deal == 0 and len(common):
            at = np.minimum(np.searchsorted(common, members), len(common) - 1)
            base = members[common[at] != members]
        scattered = np.sort(mix(base ^ U(0xA5A5A5A5A5A5A5A5 + deal)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(scattered))])
        for klass in list(todo):
            parts, spare = parts_of(klass, percent)
            edges = np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)
            bounds = np.concatenate([[0], np.searchsorted(scattered, edges.astype(np.uint64)), [len(scattered)]])
            own = sums[bounds[1:]] - sums[bounds[:-1]]
            key = mix(own + U(1000 * deal + klass + 1) * U(0x9E3779B9) + mix(np.arange(parts, dtype=np.uint64)))
            full = bounds[1:] > bounds[:-1]
            done = parts - int(full.sum()) <= spare
            out.append(key if deal == DEALS - 1 and not done else key[full])
            if done:
                todo.remove(klass)
        if not todo:
            break
    return np.concatenate(out)


def _frequent(n: int):
    """Rows (member, n) of the members that several documents of a batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def tell() -> pa.RecordBatch:
            members, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(members[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["member", "n"])

        for batch in batches:
            size = 0
            for _, members in shingle_sets(batch.column(0), n):
                held.append(members)
                size += len(members)
                if size >= MEMBERS:
                    yield tell()
                    size = 0
            if held:
                yield tell()

    return run


def common_members(rows: DataFrame, n: int) -> np.ndarray:
    """The (at most COMMON) members that most documents hold, sorted; a hint that no result depends on."""
    found = rows.select("text").mapInArrow(_frequent(n), "member long, n long").groupBy("member").agg(F.sum("n").alias("n"))
    top = most_frequent(stored(found.where(F.col("n") >= 4 * OFTEN), "near-frequent"), "n", COMMON)
    return np.sort(np.array([r["member"] for r in top.select("member").collect()], np.int64).view(np.uint64))


def packed(key: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, owners) of sorted keys: 12 bits of a key are its bucket's number, 48 more are told, byte by byte of all (so that
    bytes that agree compress).  Fewer bits than keys have can only make a cluster larger: links are verified on the sets."""
    buckets = (key >> U(52)).astype(np.int64)
    rest = ((key >> U(4)) & U((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
    owners = owner.view(np.uint8).reshape(-1, 8)
    cut = np.flatnonzero(np.diff(buckets, prepend=-1))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
        yield int(buckets[i]), rest[i:j].T.tobytes(), owners[i:j].T.tobytes()


def unpacked(keys: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(owners) // 8
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(keys, np.uint8).reshape(6, n).T
    owner = np.ascontiguousarray(np.frombuffer(owners, np.uint8).reshape(8, n).T)
    return key.view(np.uint64).ravel(), owner.view(np.int64).ravel()


def _led(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their owners, which are a key's first, and the least owner of every row's key."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return key, owner, first, owner[np.flatnonzero(first)[np.cumsum(first) - 1]]


def _pairs(leader: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([leader, owner])[:, leader != owner], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, owners, a, b) arrive sorted by bucket: edges (a, b) from the least owner of each key to its others, and
    those that the batches found."""
    now, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            _, owner, first, leader = _led(*map(np.concatenate, zip(*held, strict=True)))
            yield _pairs(leader[~first], owner[~first])
        held.clear()

    for batch in batches:
        inside = batch.filter(pa.compute.is_valid(batch.column(3)))
        yield pa.RecordBatch.from_arrays([inside.column(3), inside.column(4)], names=["a", "b"])
        # Row by row: a list of all would hold the batch's bytes a second time.
        for bucket, keys, owners in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if bucket != now:
                yield from close()
                now = bucket
            if keys.is_valid:
                held.append(unpacked(keys.as_py(), owners.as_py()))
    yield from close()


def _keys(n: int, percent: int, common):
    """Rows (bucket, keys, owners, a, b): the different keys of a batch by bucket, and edges between documents that share one in it."""

    def told(keys: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys)
        keys.clear()
        owners.clear()
        key, owner, first, leader = _led(key, owner)
        inside = _pairs(leader[~first], owner[~first])
        rows = list(packed(key[first], owner[first]))
        none = lambda size, kind: pa.nulls(size, kind)
        there = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        m, e = len(rows), inside.num_rows
        spread = pa.array((inside.column(1).to_numpy() % BUCKETS).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([there[0], spread]), pa.concat_arrays([there[1], none(e, pa.binary())]), pa.concat_arrays([there[2], none(e, pa.binary())]),
                pa.concat_arrays([none(m, pa.int64()), inside.column(0)]), pa.concat_arrays([none(m, pa.int64()), inside.column(1)]),
            ],
            names=["bucket", "keys", "owners", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, members in shingle_sets(batch.column(1), n):
                if len(members) and ids[row] is not None:
                    keys.append(keys_of(members, percent, common.value))
                    owners.append(ids[row])
                    held += len(keys[-1])
                    if held >= KEYS:
                        yield told(keys, owners)
                        held = 0
        if keys:
            yield told(keys, owners)

    return run


#: Words of bitmaps that are compared at once.
TOGETHER = 1 << 19


class Tree:
    """Leaves are sets as bitmaps over shared members; levels[0] are the leaves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.levels = [(bits, sizes, sizes)]
        while len(self.levels[-1][0]) > FAN:
            bits, low, high = self.levels[-1]
            cut = np.arange(0, len(bits), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut))
            )


def linked(x: Tree, y: Tree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of x and y (of x twice: with the first before the second) that are linked."""
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    a, b = np.meshgrid(np.arange(len(level(x, top)[0])), np.arange(len(level(y, top)[0])), indexing="ij")
    todo = [(top, a.ravel(), b.ravel())]
    while todo:
        k, a, b = todo.pop()
        if len(a) > 1 << 15:
            todo += [(k, a[: len(a) // 2], b[: len(b) // 2]), (k, a[len(a) // 2 :], b[len(b) // 2 :])]
            continue
        if same:
            ok = a < b if k == 0 else a <= b
            a, b = a[ok], b[ok]
        (xb, xl, xh), (yb, yl, yh) = level(x, k), level(y, k)
        ok = (100 * xh[a] >= percent * yl[b]) & (100 * yh[b] >= percent * xl[a])
        a, b = a[ok], b[ok]
        step = max(1, TOGETHER // max(1, xb.shape[1]))
        most = np.concatenate(
            [np.bitwise_count(xb[a[i : i + step]] & yb[b[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)]
            or [np.zeros(0, np.int64)]
        )
        # overlap o reaches the similarity if (100 + percent) * o >= percent * (sizes)
        most = np.minimum(most, np.minimum(xh[a], yh[b]))
        ok = (100 + percent) * most >= percent * (xl[a] + yl[b])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if k == 0:
            yield a, b
            continue
        below = lambda t, nodes: (
            [np.arange(n * FAN, min((n + 1) * FAN, len(level(t, k - 1)[0]))) for n in nodes.tolist()]
            if k < len(t.levels)
            else [np.array([n]) for n in nodes.tolist()]
        )
        pairs = [np.meshgrid(p, q, indexing="ij") for p, q in zip(below(x, a), below(y, b), strict=True)]
        todo.append((k - 1, np.concatenate([p.ravel() for p, _ in pairs]), np.concatenate([q.ravel() for _, q in pairs])))


def _forest(n_leaves: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of every leaf, number of documents linked to it), from a stream of links."""
    parent = list(range(n_leaves))
    links = np.zeros(n_leaves, np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(n_leaves)], np.int64), links


#: Bytes of bitmaps, and members, that a task holds at once.
BITMAPS, HELD = 32 << 20, 1 << 20


def join_block(sets: list[np.ndarray], owners: list[int], copies: list[int], side: np.ndarray, percent: int) -> Iterator[dict[str, np.ndarray]]:
    """Links among sets (side 0 alone), or between sets of sides 0 and 1: id, root (least id of its
    tree in the forest) and links (to all copies of other sets); sets of a block all differ."""
    # neighbours in the tree: by least member (near copies often share it), then by size
    order = sorted(range(len(sets)), key=lambda k: (side[k], int(sets[k][0]), len(sets[k])))
    sets, owners, copies, side = [sets[k] for k in order], [owners[k] for k in order], [copies[k] for k in order], side[order]
    split = int((side == 0).sum())
    two = split < len(sets)
    if sum(len(x) for x in sets) > HELD and len(sets) > 2:
        yield from _halves(sets, owners, copies, two, split, percent)
        return
    # one bit for every member that two sets hold
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    inverse, shared = inverse.ravel(), count > 1
    width = max(8, -(-int(shared.sum()) // 64) * 8)
    if width * len(sets) > BITMAPS and len(sets) > 2:
        yield from _halves(sets, owners, copies, two, split, percent)
        return
    bits = np.zeros((len(sets), width), np.uint8)
    ok = shared[inverse]
    at = (np.cumsum(shared) - 1)[inverse[ok]]
    np.bitwise_or.at(bits, (owner[ok], at >> 3), (1 << (at & 7)).astype(np.uint8))
    words, sizes = bits.view(np.uint64), np.array([len(x) for x in sets], np.int64)
    if two:
        x, y = Tree(words[:split], sizes[:split]), Tree(words[split:], sizes[split:])
        pairs = ((a, b + split) for a, b in linked(x, y, percent, False))
    else:
        tree = Tree(words, sizes)
        pairs = linked(tree, tree, percent, True)
    roots, links = _forest(len(sets), pairs, np.array(copies, np.int64))
    ids = np.array(owners, np.int64)
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    told = np.flatnonzero(links)
    yield {"id": ids[told], "root": least[roots[told]], "links": links[told]}


def _halves(sets, owners, copies, two, split, percent) -> Iterator[dict[str, np.ndarray]]:
    """The same block in smaller ones, whose members are fewer and bitmaps shorter."""

    def part(first: range, second: range) -> Iterator[dict[str, np.ndarray]]:
        both = [*first, *second]
        if first and (second or len(first) > 1):
            yield from join_block([sets[k] for k in both], [owners[k] for k in both], [copies[k] for k in both], np.array([0] * len(first) + [1] * len(second), np.uint8), percent)

    if two:
        cut, at = -(-split // 2), split + -(-(len(sets) - split) // 2)
        for x in (range(cut), range(cut, split)):
            for y in (range(split, at), range(at, len(sets))):
                if x and y:
                    yield from part(x, y)
    else:
        cut = len(sets) // 2
        yield from part(range(cut), range(0))
        yield from part(range(cut, len(sets)), range(0))
        yield from part(range(cut), range(cut, len(sets)))


def _blocks(n: int, percent: int):
    """Rows (component, i, j, doc_id, side, text, low, high, copies) arrive sorted by task; each task is
    one block or a pair of chunks.  Rows that share their id with a set that stands for others, but are another
    text or the same again, pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, owners, copies, sides, seen = None, [], [], [], [], set()

        def close() -> Iterator[pa.RecordBatch]:
            # A pair of chunks of which one is empty is no block: its rows meet in their own chunk.
            if len(sets) > 1 and (now[1] == now[2] or 0 < sum(sides) < len(sides)):
                for found in join_block(sets, owners, copies, np.array(sides, np.uint8), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k]) for k in ("id", "root", "links")], names=["id", "root", "links"])
            for held in (sets, owners, copies, sides, seen):
                held.clear()

        for batch in batches:
            tasks = list(zip(*[batch.column(k).to_pylist() for k in (0, 1, 2)], strict=True))
            ids, side, low, high, times = (batch.column(k).to_pylist() for k in (3, 4, 6, 7, 8))
            for row, members in shingle_sets(batch.column(5), n):
                if tasks[row] != now:
                    yield from close()
                    now = tasks[row]
                if (own := (low[row], high[row])) in seen or digest(members) != own:
                    continue
                seen.add(own)
                sets.append(members)
                owners.append(ids[row])
                copies.append(times[row])
                sides.append(side[row])
        yield from close()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def measured(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, low and high (the set's digest) and bytes (of the text) of every row."""
    return stored(_rows(docs).mapInArrow(_digests(n), "doc_id long, n_shingles long, low long, high long, bytes long"), "near-sets")


def _rounds(reps: DataFrame, sized: DataFrame, sets: DataFrame) -> int:
    """How many times the corpus's bytes (or ROUND) are dealt: a text goes to as many tasks as its cluster has chunks."""
    dealt = reps.join(sized, "cluster").agg(F.sum(F.col("bytes") * F.col("chunks"))).first()[0] or 0
    return max(1, -(-dealt // max(ROUND, sets.agg(F.sum("bytes")).first()[0] or 0)))


def classes(docs: DataFrame, sets: DataFrame, n: int = 3, percent: int = 90, chunk: int = CHUNK) -> DataFrame:
    """doc_id, component_id and n_links of the documents that are linked with another; sets are those of measured()."""
    spark = docs.sparkSession
    rows = _rows(docs).where("doc_id is not null")
    common = spark.sparkContext.broadcast(common_members(rows, n))
    keyed = rows.mapInArrow(_keys(n, percent, common), "bucket int, keys binary, owners binary, a long, b long")
    # A bucket is a 4096th of all keys: its task sorts these.
    edges = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_edges, "a long, b long").distinct()
    clusters = components(edges, "near-clusters").withColumnRenamed("component", "cluster")
    # Of equal sets the one with the least id stands for all.
    members = stored(clusters.join(sets, F.col("vertex") == F.col("doc_id")).select("cluster", "low", "high", "doc_id", "bytes"), "near-members")
    group = ["cluster", "low", "high"]
    reps = members.groupBy(*group).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"))
    reps = stored(reps, "near-heads")
    # Chunks of large clusters: every pair of chunks (i <= j) is a task.
    sized = reps.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    spread = F.least(F.lit(SPREAD), F.ceil(SPREAD * F.col("n") / chunk))
    chunks = F.greatest(F.ceil(F.col("n") / chunk), spread, F.ceil(F.col("bytes") / CHARS)).cast("int")
    sized = stored(sized.select("cluster", chunks.alias("chunks")), "near-sizes")
    placed = reps.join(sized, "cluster").withColumn("own", F.pmod(F.xxhash64("low"), F.col("chunks")).cast("int")).drop("bytes")
    text = rows.join(placed, rows["doc_id"] == placed["rep"]).select("doc_id", "text", *group, "copies", "chunks", "own")
    tasks = F.expr(
        "transform(sequence(0, chunks - 1), k -> struct(least(own, k) as i, greatest(own, k) as j, cast(own > k as int) as side))"
    )
    rounds = _rounds(reps, sized, sets)
    if rounds > 1:
        text = stored(text, "near-texts")
    found = None
    for k in range(rounds):
        dealt = text.select("doc_id", "text", *group, "copies", F.explode(tasks).alias("t")).select(
            "cluster", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "doc_id", F.col("t.side").alias("side"), "text", "low", "high", "copies"
        )
        if rounds > 1:
            dealt = dealt.where(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(rounds)) == k)
        dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "doc_id")
        links = stored(dealt.mapInArrow(_blocks(n, percent), "id long, root long, links long"), "near-links")
        found = links if found is None else found.union(links)
    # An id with several sets ties the ids that stand for these together.
    own = F.struct(*group)
    several = members.groupBy("doc_id").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first <> last").select("doc_id")
    held = members.join(several, "doc_id").join(reps, group).select("doc_id", "rep").distinct()
    tied = held.groupBy("doc_id").agg(F.min("rep").alias("a")).join(held, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    joined = components(found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).union(tied), "near-classes")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    heads = reps.join(joined, F.col("rep") == F.col("vertex"), "left").join(counts, F.col("rep") == F.col("id"), "left").select(
        *group, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    heads = stored(heads.where("n_links > 0"), "near-verdicts")
    # Documents follow the set that stands for theirs.
    return members.join(heads, group).groupBy("doc_id").agg(F.min("component").alias("component_id"), F.max("n_links").alias("n_links"))


def join(docs: DataFrame, n: int = 3, percent: int = 90, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and n_links of every row
    (of an id with several texts: the most that one has)."""
    sets = measured(docs, n)
    found = classes(docs, sets, n, percent, chunk).withColumnRenamed("doc_id", "_id")
    return sets.join(found, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def distinct(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs with one row of each class (the least doc_id, a missing one first), in the columns of docs.

    Rows are told apart by numbers, so rows that share an id or have none are documents of their own."""
    own = docs.columns
    number, member, group = (free(c, own) for c in ("_number", "_member", "_class"))
    rows = numbered(docs, number, "near-rows")
    texts = rows.select(F.col(number).alias("doc_id"), "text")
    found = classes(texts, measured(texts, n), n, percent).select(F.col("doc_id").alias(member), F.col("component_id").alias(group))
    found = stored(found, "near-found")
    linked = rows.select("doc_id", number).join(found, F.col(number) == F.col(member))
    first = linked.groupBy(group).agg(F.min(F.struct("doc_id", number)).alias("first"))
    kept = first.select(F.col(f"first.{number}").alias("_kept"))
    gone = found.join(kept, F.col(member) == F.col("_kept"), "left_anti").select(member)
    return rows.join(gone, F.col(number) == F.col(member), "left_anti").select(*[F.col(f"`{c}`") for c in own])
