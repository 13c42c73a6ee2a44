"""Vectorised 64-bit hashes of words and word windows, for use inside tasks."""

import ctypes
import functools

import numpy as np
import pyarrow as pa
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BATCH_BYTES = 4 << 20
REMEMBERED = 1 << 16  # words that a task remembers; a forgotten one is hashed again


def released(run):
    """run for mapInArrow, giving back at the end of a task what Arrow and the allocator keep for later use: an
    idle worker stays beside the executor's JVM through the stages that follow."""
    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, TypeError, AttributeError):  # another C library
            pass

    return task


class WordHashes(dict):
    """Hash of each word, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than space and \\x09 to \\x0D; null has none."""
    if not text:
        return []
    return (text.translate(_FOLD) if lower else text).split()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp polynomial modulo 2**64 of every run of `width` values, by doubling."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        done, total, power = 0, None, BASE  # total: polynomial of the first `done` values
        block, size = hashes, 1
        while True:
            if width & size:
                part = block
                if total is None:
                    total, done = part[: len(hashes) - size + 1], size
                else:
                    n = len(hashes) - done - size + 1
                    total = total[:n] * power + part[done : done + n]
                    done += size
            if done == width:
                return mixed(total)
            n = len(block) - size
            block = block[:n] * power + block[size : size + n]
            power, size = power * power, size * 2


def slices(texts: list, most: int = BATCH_BYTES):
    """Ranges of consecutive texts of at most `most` bytes together (at least one text)."""
    begin = size = 0
    for i, text in enumerate(texts):
        length = len(text) if text else 0
        if i > begin and size + length > most:
            yield begin, i
            begin, size = i, 0
        size += length
    if begin < len(texts):
        yield begin, len(texts)
