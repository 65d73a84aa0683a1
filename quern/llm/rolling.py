"""Vectorised hashing of words and windows over byte buffers.

Every window hash is a difference of prefix sums of a polynomial modulo
2**64, so its cost does not depend on the window's length.  Such a polynomial
over plain bytes has known strings that collide for every odd base, so where a
hash decides, its letters are first mixed: words are hashed eight bytes at a
time through a bijection, and windows of bytes are polynomials over the mixed
eight bytes that begin at each place.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers of the independent polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least, modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = []
        for step in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, step, dtype=U64)
            run[0] = 1
            steps.append(np.cumprod(run, dtype=U64))
        have = _tables[base] = (steps[0], steps[1])
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums, one longer than the input, of values times powers of base."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values) + 1, base)[0][: len(values)], dtype=U64, out=out[1:])
    return out


def windows(values: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """The mixed hash of each window of ``length`` values; empty if there is none."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    sums = prefix(values, base)
    return mix((sums[length:] - sums[:count]) * powers(count, base)[1][:count])


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words of a buffer start and end."""
    edge = np.empty(len(buffer) + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[buffer]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Words of more bytes than this are hashed by XXH64 one by one.
LONG_WORD = 64


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer as one value, zeros beyond its end."""
    padded = np.zeros(len(buffer) + 8, dtype=np.uint8)
    padded[: len(buffer)] = buffer
    return np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length; words of up to eight bytes and
    one length never collide."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    load, lengths = eights(buffer), ends - starts
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
    out = mix((load[starts] & masks[np.minimum(lengths, 8)]) ^ lengths.astype(U64) * U64(seed))
    more = np.flatnonzero(lengths > 8)
    done = 8
    while len(more) and done < LONG_WORD:
        piece = load[starts[more] + done] & masks[np.minimum(lengths[more] - done, 8)]
        out[more] = mix(out[more] * U64(BASES[1]) ^ piece)
        done += 8
        more = more[lengths[more] > done]
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(buffer[starts[k] : ends[k]].tobytes(), seed)
    return out


def byte_windows(buffer: np.ndarray, length: int, lane: int) -> np.ndarray:
    """The hash of each window of ``length`` bytes, eight at least, from mixed letters."""
    letters = mix(eights(buffer)[: max(0, len(buffer) - 7)] ^ U64(BASES[lane + 1]))
    return windows(letters, length - 7, BASES[lane])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a line feed after each, and where each text starts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts[:-1]), dtype=np.int64, count=max(0, len(texts) - 1)), out=starts[1:])
    return data, starts


def chunks(texts: list[bytes], most: int = 2 << 20):
    """Runs (first, last) of texts of at most ``most`` bytes, or of one longer text."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, at
            first, size = at, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)
