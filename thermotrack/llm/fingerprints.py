"""Document fingerprints from closed syncmers, and their likeness by positional matching."""

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.chunks import CHUNK_BYTES, id_chunks
from thermotrack.llm.common import null_safe, packed, saved, sized, unpacked
from thermotrack.llm.hashing import BASE, mixed, slices, window_hashes

K = 24  # characters of an anchor
S = 10  # characters of its inner substrings
_DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[_DIGITS] = np.arange(64)
WIDTH = 5  # characters of an anchor in a fingerprint: four of hash, one of distance


def fingerprints_of(texts: list[str]) -> list[str]:
    """A fingerprint for each text, all texts in one pass of vector operations.

    A k-mer is an anchor when the smallest hash of its s-mers is that of its first or last one, so
    whether it is chosen depends on its own characters alone. A fingerprint has for each anchor four
    characters of hash and one for the distance from the anchor before it (63 and more: one value).
    A text shorter than a k-mer is one anchor. One with no such k-mer, of K to 2 * K - S - 2 characters,
    has the k-mer of the smallest code. Only an empty text has no anchor.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at, code = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(points) >= K:
        inner = window_hashes(mixed(points + BASE), S)
        n = len(points) - K + 1
        last = K - S
        least, size = inner, 1
        while 2 * size <= last + 1:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[last + 1 - size :][:n])
        chosen = (inner[:n] == least) | (inner[last : last + n] == least)
        chosen &= np.arange(n) + K <= np.repeat(starts[1:], lengths)[:n]
        at = np.flatnonzero(chosen)
        code = _codes(inner, at)
    bounds = np.searchsorted(at, starts)
    gaps = np.diff(at, prepend=0)
    owners = bounds[:-1][bounds[:-1] < bounds[1:]]
    gaps[owners] = at[owners] - starts[:-1][bounds[:-1] < bounds[1:]]
    rows = _rows(code, np.minimum(gaps, 63)).tobytes().decode("ascii")
    out = [rows[WIDTH * b : WIDTH * e] for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in np.flatnonzero((lengths >= K) & (bounds[:-1] == bounds[1:])):
        codes = _codes(inner, np.arange(starts[i], starts[i + 1] - K + 1))
        least = codes.argmin()
        out[i] = _rows(codes[least : least + 1], np.minimum([least], 63)).tobytes().decode("ascii")
    for i in np.flatnonzero((lengths > 0) & (lengths < K)):
        own = points[starts[i] : starts[i + 1]]
        code = window_hashes(own + BASE, len(own)) ^ np.uint64(len(own))
        out[i] = _rows(mixed(code), np.zeros(1, np.int64)).tobytes().decode("ascii")
    return out


def _codes(inner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes of the k-mers that begin at some places, from the hashes of their s-mers."""
    last = K - S
    with np.errstate(over="ignore"):
        return mixed((inner[at] * BASE + inner[at + last // 2]) * BASE + inner[at + last])


def _rows(code: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    digits = [(code >> np.uint64(40 + 6 * i)).astype(np.int64) & 63 for i in range(4)]
    return _DIGITS[np.stack([*digits, gaps], axis=1)] if len(code) else np.empty((0, WIDTH), np.uint8)


def likeness_of(one: str, other: str) -> float:
    """Anchors matched in one order, twice, over all anchors of both: 1 for equal fingerprints."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = (np.frombuffer(f.encode("ascii"), np.uint8).reshape(-1, WIDTH) for f in (one, other))
    ca, cb = (np.ascontiguousarray(x[:, :4]).view(np.uint32).ravel() for x in (a, b))
    ka, kb = _numbered(ca), _numbered(cb)
    _, at, bt = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    tail: list[int] = []  # longest chain that rises in both
    for place in bt[np.argsort(at)].tolist():
        i = bisect_left(tail, place)
        tail[i : i + 1] = [place]
    return 2.0 * len(tail) / (len(a) + len(b))


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Each code with its number among equal ones, so that repeats match one to one."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
    number = np.empty(len(codes), np.uint64)
    number[order] = (np.arange(len(codes)) - begin).astype(np.uint64)
    return codes.astype(np.uint64) << np.uint64(32) | number


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of docs, and n_chars (code points) and fingerprint. A null text is an empty one."""
    whole = packed(docs, text=F.coalesce(F.col(text), F.lit("")))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts):
                own = texts[begin:end]
                yield pa.record_batch(
                    [batch.column("row").slice(begin, end - begin),
                     pa.array([len(t) for t in own], pa.int64()), pa.array(fingerprints_of(own))],
                    names=["row", "n_chars", "fingerprint"])

    kind = whole.schema["row"].dataType.simpleString()
    found = whole.mapInArrow(run, f"row {kind}, n_chars bigint, fingerprint string")
    return unpacked(found, n_chars=F.col("n_chars"), fingerprint=F.col("fingerprint"))


def edited_likeness(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """How fingerprints follow an edit: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next for each document.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all)
    of the next document in descending order of id; the first document follows the last one. Chunks
    of consecutive ids get the first document of the next chunk as well, so texts move once.

    A null text is an empty one. Rows of one id are in order of text, null ids come last. A single
    document is its own next one. An empty table gives an empty one. Two empty texts have likeness 1.
    Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, _, last = id_chunks(rows, chunk_bytes)
    rows = rows.withColumn("chunk", F.when(F.col("chunk") == last, last).otherwise(last - 1 - F.col("chunk")))
    tops = saved(rows.groupBy("chunk").agg(F.max("id").alias("id")))
    numbers = sorted(r[0] for r in tops.select("chunk").collect())  # one per chunk
    before = dict(zip(numbers[1:] + numbers[:1], numbers, strict=True))
    heads = null_safe(rows, sized(tops), ["chunk", "id"], "left_semi").groupBy("chunk", "id").agg(
        F.min("text").alias("text"))
    target = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map()
    heads = heads.withColumn("chunk", F.element_at(target, F.col("chunk")) if before else F.col("chunk"))
    every = rows.withColumn("head", F.lit(0)).unionByName(heads.withColumn("head", F.lit(1)))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [
            ("head", "ascending"), ("id", "descending"), ("text", "ascending")]))
        texts = table.column("text").to_pylist()
        marks = []
        for begin, end in slices(texts):
            marks += fingerprints_of(texts[begin:end])
        n = len(texts) - 1
        edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in enumerate(texts[:n])]
        changed = []
        for begin, end in slices(edited):
            changed += fingerprints_of(edited[begin:end])
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        return pa.table({
            "doc_id": table.column("id").slice(0, n), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array(digests, pa.string()), "fingerprint": pa.array(marks[:n], pa.string()),
            "edited_fingerprint": pa.array(changed, pa.string()),
            "near_edited": pa.array([likeness_of(a, b) for a, b in zip(marks, changed, strict=False)], pa.float64()),
            "near_next": pa.array([likeness_of(a, b) for a, b in zip(marks, marks[1:], strict=False)], pa.float64())})

    return every.groupBy("chunk").applyInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
