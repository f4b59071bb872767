"""Steps of the n-gram join hold pieces and batches, whatever the size of what arrives."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import near_dup, textscan


class Common:
    value = np.zeros(0, np.uint64)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch_of(texts):
    rng = np.random.default_rng(2)
    words = np.array([f"word{k}" for k in range(20_000)])
    said = [" ".join(words[rng.integers(0, len(words), 250)]) for _ in range(texts)]
    return pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), pa.array(said)], names=["doc_id", "text"])


@pytest.mark.parametrize("step, most", [("sets", 20), ("keys", 40)])
def test_texts_are_hashed_and_keyed_in_small_memory(monkeypatch, step, most):
    """2500 texts: 78 MB for sets and 79 MB for keys when slices had 2 MB and batches a million keys, 10 MB and 25 MB now."""
    monkeypatch.setattr(textscan, "_powers", [])
    batch = batch_of(2500)

    def run():
        if step == "sets":
            assert sum(1 for _ in near_dup.shingle_sets(batch.column(1), 5)) == 2500
        else:
            assert sum(b.num_rows for b in near_dup._keys(5, 80, Common)(iter([batch])))

    run()
    monkeypatch.setattr(textscan, "_powers", [])
    assert peak_mb(run) < most


def test_large_blocks_are_compared_in_small_memory():
    """A hundred near copies of a set of 30,000 members: 196 MB when they were one block, 51 MB now."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 30_000).astype(np.uint64))
    sets = [np.unique(np.append(base, np.uint64(k))) for k in range(100)]
    links = np.zeros(100, np.int64)

    def run():
        for part in near_dup.join_block(sets, list(range(100)), [1] * 100, np.zeros(100, np.uint8), 90):
            links[part["id"]] += part["links"]

    assert peak_mb(run) < 80
    assert (links == 99).all()
