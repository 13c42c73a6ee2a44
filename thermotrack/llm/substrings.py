"""Repeated passages: Rabin-Karp hashes of all word windows, counted by ranges of the hash."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.chunks import CHUNK_BYTES, id_chunks
from thermotrack.llm.hashing import WordHashes, window_hashes, words_of

WINDOW = 20
RANGE_WORDS = 1 << 20


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   range_words: int = RANGE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (what is kept, words joined by one space), n_words, n_removed, removed.

    Every word is removed that lies in a window of `window` words whose words also start earlier:
    in a document of smaller id, or earlier in the same one. All windows are judged on the input.
    `removed` are the maximal intervals of removed words, as (begin, end), end excluded.

    Documents are dealt into chunks of consecutive ids. A chunk sends the distinct window hashes it
    holds, sorted, to the ranges of the hash; a range counts in which chunks each hash occurs and
    sends back one bit per hash: whether an earlier chunk has it. So a window that any number of
    documents share is sent once per chunk, no task gets more than a chunk or a range, and what moves
    is the texts once, 8 bytes for each distinct window of a chunk, and the bits. Chunks and ranges
    are block sizes only: results don't depend on them; on 100 TB take blocks of some 100 MB.

    A null text has no words. Rows of one id count as one after the other, in order of text; repeated
    rows are removed but the first. Null ids come last. An empty table gives an empty one. Other
    columns are ignored. Windows are known by 64 bit hashes.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    rows, total, _ = id_chunks(rows, chunk_bytes)
    n_ranges = int(total // (6 * range_words)) + 1

    def sent(table: pa.Table) -> pa.Table:
        distinct = _windows(_ordered(table), window)[1]
        ends = _range_ends(distinct, n_ranges)
        filled = [i for i in range(n_ranges) if ends[i] < ends[i + 1]]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({
            "chunk": pa.array([chunk] * len(filled), pa.int32()),
            "part": pa.array(filled, pa.int32()),
            "hashes": pa.array([distinct[ends[i] : ends[i + 1]].tobytes() for i in filled], pa.binary())})

    def answered(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("chunk", "ascending")]))
        parts = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")  # equal hashes stay in the order of their chunks
        ordered = every[order]
        seen = np.zeros(len(every), bool)
        seen[order[1:]] = ordered[1:] == ordered[:-1]
        bits = np.split(seen, np.cumsum([len(p) for p in parts])[:-1])
        packed = [np.packbits(b).tobytes() if b.any() else None for b in bits]
        told = table.select(["chunk", "part"]).append_column("bits", pa.array(packed, pa.binary()))
        return told.filter(pc.is_valid(told.column("bits")))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        table = _ordered(table)
        at, distinct, first, which, words, starts = _windows(table, window)
        early = np.zeros(len(distinct), bool)
        ends = _range_ends(distinct, n_ranges)
        for part, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True):
            n = ends[part + 1] - ends[part]
            early[ends[part] : ends[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        again = np.ones(len(at), bool)
        again[first] = False
        again |= early[which]
        n_words = len(words)
        change = np.bincount(at[again], minlength=n_words + window) - np.concatenate(
            [np.zeros(window, np.int64), np.bincount(at[again], minlength=n_words)])[: n_words + window]
        covered = np.cumsum(change)[:n_words] > 0
        texts, counts, removed, spans = [], [], [], []
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            own, gone = words[begin:end], covered[begin:end]
            lost = int(gone.sum())
            if lost:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"begin": int(b), "end": int(e)} for b, e in edges.reshape(-1, 2)])
                own = [own[i] for i in np.flatnonzero(~gone)]
            else:
                spans.append([])
            texts.append(b" ".join(own))
            counts.append(int(end - begin))
            removed.append(lost)
        return pa.table({
            "doc_id": table.column("id"), "text": pa.array(texts, pa.binary()).cast(pa.string()),
            "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})

    hashes = rows.groupBy("chunk").applyInArrow(sent, "chunk int, part int, hashes binary")
    told = hashes.groupBy("part").applyInArrow(answered, "chunk int, part int, bits binary")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        cut, "doc_id bigint, text string, n_words bigint, n_removed bigint, "
             "removed array<struct<begin:int,end:int>>")


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))


def _range_ends(distinct: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n even ranges of the hash begins and ends among the sorted hashes."""
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])


def _windows(table: pa.Table, width: int):
    """Window starts, distinct hashes, their first window, each window's hash; words, document starts."""
    cache = WordHashes()
    words, starts = [], [0]
    for text in table.column("text").to_pylist():
        words += words_of(text)
        starts.append(len(words))
    starts = np.array(starts)
    hashes = window_hashes(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), width)
    own_end = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(len(hashes)) + width <= own_end[: len(hashes)])
    distinct, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
    return at, distinct, first, which, words, starts
