"""Range asymmetric numeral system with static tables, vectorised over lanes.

A block of ids is dealt to up to 1024 lanes (id i to lane i mod lanes); every lane
has a 64-bit state and all lanes share one stream of 32-bit words.  Words stand in
the order in which decoding reads them.  Every 256 rounds a checkpoint holds the
place in the stream and all states, so decoding can begin there.  Checksums cover
the stream and the ids.
"""

from __future__ import annotations

import zlib

import numpy as np

U = np.uint64
LOW, WORD = U(1 << 31), U(32)
LANES, EVERY = 1024, 256
MAGIC = 0x314E4152  # "RAN1"


class Table:
    """Frequencies of the ids that occur, scaled to a power of two."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray, bits: int):
        self.symbols, self.scaled, self.bits = symbols, scaled, bits
        self.begins = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.int64)
        self.slot = None

    @classmethod
    def of(cls, counts_symbols: np.ndarray, counts: np.ndarray) -> Table:
        bits = max(14, int(np.ceil(np.log2(max(2, len(counts))))) + 2)
        total = 1 << bits
        scaled = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
        order = np.argsort(-scaled, kind="stable")
        rest = total - int(scaled.sum())
        if rest > 0:
            scaled[order[0]] += rest
        while rest < 0:
            for k in order:
                take = min(int(scaled[k]) - 1, max(1, int(scaled[k]) >> 4), -rest)
                scaled[k] -= take
                rest += take
                if rest == 0 or take == 0:
                    break
        return cls(counts_symbols, scaled, bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, len(self.symbols)], "<u4").tobytes()
        packed = np.diff(self.symbols, prepend=0).astype("<u4").tobytes() + self.scaled.astype("<u4").tobytes()
        body = zlib.compress(packed, 6)
        return head + np.array([len(body)], "<u4").tobytes() + body

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Table, int]:
        bits, n, size = np.frombuffer(data, "<u4", 3).tolist()
        both = np.frombuffer(zlib.decompress(data[12 : 12 + size]), "<u4")
        return cls(np.cumsum(both[:n].astype(np.int64)), both[n:].astype(np.int64), bits), 12 + size

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.scaled), dtype=np.int32), self.scaled)
        return self.slot


def encode(ids: np.ndarray, table: Table) -> bytes:
    """ids: uint32, all of them in the table."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    rounds = -(-n // lanes)
    by_id = np.zeros((2, int(table.symbols[-1]) + 1 if len(table.symbols) else 1), np.uint64)
    by_id[:, table.symbols] = table.scaled, table.begins
    freq, begin = by_id[0][ids], by_id[1][ids]
    bits, limit = U(table.bits), U(63 - table.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    emitted = 0
    for t in range(rounds - 1, -1, -1):
        f, b = freq[t * lanes : (t + 1) * lanes], begin[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << limit)
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            emitted += len(out)
            x = np.where(full, x >> WORD, x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + b
        if t % EVERY == 0:
            marks.append((emitted, state.copy()))
    stream = np.concatenate([*reversed(words), np.zeros(0, np.uint32)]).astype("<u4").tobytes()
    head = np.array([MAGIC, n, lanes, EVERY, len(marks), emitted, zlib.crc32(stream), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    places = np.array([emitted - e for e, _ in reversed(marks)], "<u4")
    states = np.concatenate([s for _, s in reversed(marks)]).astype("<u8") if marks else np.zeros(0, "<u8")
    return head.tobytes() + places.tobytes() + states.tobytes() + stream


def decode(block: bytes, table: Table, first_mark: int = 0, n_marks: int | None = None) -> np.ndarray:
    """The ids from one checkpoint on, over n_marks checkpoints (all: checked by both sums)."""
    magic, n, lanes, every, marks, emitted, stream_sum, ids_sum = np.frombuffer(block, "<u4", 8).tolist()
    if magic != MAGIC:
        raise ValueError("not a block")
    places = np.frombuffer(block, "<u4", marks, 32)
    states = np.frombuffer(block, "<u8", marks * lanes, 32 + 4 * marks).reshape(marks, lanes)
    at = 32 + 4 * marks + 8 * lanes * marks
    if zlib.crc32(block[at : at + 4 * emitted]) != stream_sum:
        raise ValueError("a block's stream is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(block, "<u4", emitted, at).astype(np.uint64)
    slots, symbols = table.slots(), table.symbols.astype(np.uint32)
    scaled, begins = table.scaled.astype(np.uint64), table.begins.astype(np.uint64)
    bits, mask = U(table.bits), U((1 << table.bits) - 1)
    rounds = -(-n // lanes)
    last = rounds if n_marks is None else min(rounds, (first_mark + n_marks) * every)
    first = first_mark * every
    out = np.empty(min(n, last * lanes) - first * lanes, np.int32)
    x_all, w = states[first_mark].astype(np.uint64), int(places[first_mark])
    for t in range(first, last):
        m = min(lanes, n - t * lanes)
        x = x_all[:m]
        low = x & mask
        k = slots[low.astype(np.int64)]
        x = scaled[k] * (x >> bits) + low - begins[k]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << WORD) | words[w : w + len(need)]
            w += len(need)
        x_all[:m] = x
        o = (t - first) * lanes
        out[o : o + m] = k
    ids = symbols[out]
    if first_mark == 0 and last == rounds and zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("a block's ids are damaged")
    return ids
