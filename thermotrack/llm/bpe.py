"""Byte-level BPE by tree concatenation: ids as the tokenizers library gives them, and back."""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import packed, saved, unpacked
from thermotrack.llm.hashing import released

PART_CHARS = 1 << 15  # longer texts are cut, encoded in parallel and joined again
WINDOW_CHARS = 1 << 6  # on either side of a join at first
RUN_CHARS = 1 << 10  # longer runs without a safe cut are split and joined again
LEAF_BYTES = 1 << 8
SLICE_BYTES = 1 << 20
DECODED_ROWS = 256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """The tokens of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        kinds = (content["normalizer"], content["pre_tokenizer"]["type"], content["model"]["type"])
        if kinds != (None, "ByteLevel", "BPE") or content["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = self.special_id = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte_of = _byte_alphabet()
        ranks = self.ranks = {bytes(byte_of[c] for c in token): i
                              for token, i in content["model"]["vocab"].items() if token not in special}
        size = max([*ranks.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.tokens = pa.array(self.bytes_of, pa.binary())

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts of lists of ids: the bytes of all tokens lie one after the other in one buffer."""
        flat = self.tokens.take(ids.flatten())
        if not len(flat):
            return [""] * len(ids)
        data = flat.buffers()[2].to_pybytes() if flat.buffers()[2] else b""
        begins = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = begins[np.cumsum(np.concatenate([[0], lengths]))]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


class ByteBpe(Vocabulary):
    """Encoding by the vocabulary, whose ids are in the order of its merges."""

    def __init__(self, path: str):
        super().__init__(path)
        special = self.special_id
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.pattern = regex.compile(PATTERN)
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_chars = max(map(len, special), default=0)
        self.long_run = re.compile(rf"\s*\S{{{RUN_CHARS},}}|\s{{{RUN_CHARS},}}\S*")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Long runs are taken out, as a cut before white space is exact."""
        out = []
        for part, is_run in self.parts(text):
            if is_run:
                for piece in self.pieces(part):
                    out.append(np.array(piece if isinstance(piece, list) else self.tree(piece), np.uint32))
            else:
                out.append(self.encoding.encode_to_numpy(part, allowed_special="all"))
        return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint32), *out])

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of the pieces that a text is split into, special tokens among them."""
        out, at = [], 0
        for match in (*self.special.finditer(text), None) if self.special else (None,):
            end = match.start() if match else len(text)
            out += [(at + m.start(), at + m.end()) for m in self.pattern.finditer(text[at:end])]
            if match:
                out.append(match.span())
                at = match.end()
        return out

    def settled(self, begin: int, end: int, text: str, goes_on: bool = False) -> list[int]:
        """Starts of the pieces of text[begin:end] that text after the end can't change: all but the last
        one before anything that could be the beginning of a special token. begin is one of them. At the
        end of a text that doesn't go on its end counts as well."""
        starts = [begin + a for a, _ in self.spans(text[begin:end])]
        if end == len(text) and not goes_on:
            return [*starts, end]
        known = end - self.special_chars
        return starts[: max(0, sum(a <= known for a in starts) - 1)]

    def concatenated(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of each, which may have been cut anywhere.

        A window around the cut is split into pieces anew and grows on the left until it begins where
        left's own split has a piece that right can't change, and on the right until a piece of it
        begins where one of right's own split does: from there on both splits are the same. Only the
        pieces in between are encoded; one that spans the cut alone joins the ids of its halves.
        """
        if not left or not right:
            return left_ids if left else right_ids
        both, cut, size = left + right, len(left), WINDOW_CHARS
        while True:
            first = self._anchor(left, max(0, cut - size - self.special_chars))
            own = self.settled(first, cut, left, goes_on=True)
            if own or first == 0:
                break
            size *= 2
        begin = own[-1] if own else 0
        while True:
            until = min(len(right), size)
            ours = self.settled(begin, cut + until, both)
            theirs = {cut + a for a in self.settled(0, until, right)}
            meet = next((a for a in ours if a >= cut and a in theirs), None)
            if meet is not None:
                break
            size *= 2
        head = left_ids[: _ids_before(self.length_of, left_ids, len(left[:begin].encode("utf-8", "replace")))]
        tail = right_ids[_ids_before(self.length_of, right_ids, len(right[: meet - cut].encode("utf-8", "replace"))) :]
        middle = []
        for a, b in self.spans(both[begin:meet]):
            piece = both[begin + a : begin + b]
            if piece in self.special_id:
                middle.append([self.special_id[piece]])
            elif begin + a < cut < begin + b and len(piece) > RUN_CHARS and self.is_one(both[begin:cut], both[cut:meet]):
                middle.append(self.join(left_ids[len(head) :].tolist(), right_ids[: len(right_ids) - len(tail)].tolist()))
            else:
                middle.append(self.tree(piece.encode("utf-8", "replace")))
        return np.concatenate([head, *[np.array(m, np.uint32) for m in middle], tail])

    def is_one(self, *stretches: str) -> bool:
        """Whether each stretch is a single piece."""
        return all(len(self.spans(s)) == 1 for s in stretches)

    def _anchor(self, text: str, wanted: int) -> int:
        """The last place up to wanted where any split of text begins a piece: before white space that
        follows other characters, outside of special tokens; or its beginning."""
        while wanted > 0:
            low = max(0, wanted - WINDOW_CHARS)
            places = [m.start() for m in _CUT.finditer(text, low, wanted)]
            for at in reversed(places):
                around = text[max(0, at - self.special_chars) : at + self.special_chars]
                if not (self.special and self.special.search(around)):
                    return at
            wanted = low
        return 0

    def parts(self, text: str):
        """(part, whether it is a long run): cuts lie between a character and white space after it."""
        at = 0
        for match in self.long_run.finditer(text) if len(text) >= RUN_CHARS else ():
            begin, end = match.span()
            if begin > at:
                yield text[at:begin], False
            yield text[begin:end], True
            at = end
        if at < len(text):
            yield text[at:], False

    def pieces(self, run: str):
        """Ids of special tokens, and the bytes of the pieces between which nothing is ever merged."""
        at = 0
        for match in self.special.finditer(run) if self.special else ():
            yield from (p.encode("utf-8", "replace") for p in self.pattern.findall(run[at : match.start()]))
            yield [self.special_id[match.group()]]
            at = match.end()
        yield from (p.encode("utf-8", "replace") for p in self.pattern.findall(run[at:]))

    def tree(self, piece: bytes) -> list[int]:
        """Ids of one piece: its halves are encoded and joined, down to short leaves."""
        if len(piece) <= LEAF_BYTES:
            return self.encoding._encode_single_piece(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring stretches of one piece from the ids of each.

        A sequence is the encoding of its bytes when each two neighbours encode to themselves. The
        window around the join is encoded anew and grows until its outermost ids are those that
        either side had there; then all neighbours are right, inside and outside of it.
        """
        if not left or not right:
            return left or right
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            window = self.encoding._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, a + b)))
            whole_left, whole_right = size >= len(left), size >= len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: max(0, len(left) - size)] + window + right[size:]
            size *= 2


def _ids_before(length_of: np.ndarray, ids: np.ndarray, size: int) -> int:
    """Number of ids whose tokens are the first `size` bytes."""
    return int(np.searchsorted(np.cumsum(length_of[ids]), size, side="right")) if size else 0


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_CUT = re.compile(r"(?<=\S)(?=\s)")


def byte_slices(rows: pa.StructArray, at: int, most: int = SLICE_BYTES):
    """Slices of rows of at most some `most` bytes in the text at that place (at least a row), to hold little at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(rows.field(at)), 0).to_numpy(zero_copy_only=False))
    begin = done = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield rows.slice(begin, end - begin)
        begin, done = end, int(sizes[end - 1])


def encode(docs: DataFrame, path: str, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Columns of docs, and ids array<int>: each whole text in the ids of the vocabulary file.

    Texts up to part_chars characters are encoded where they are. Longer ones are cut every part_chars
    characters, whatever is there; the parts are encoded in parallel and joined in pairs, level by
    level, by `ByteBpe.concatenated`. Strings of special tokens become those tokens, as in the library.
    A null text is an empty one and has no ids; repeated rows stay; an empty table gives an empty one.
    The file is read on the executors, so path must be there on each of them.
    """
    is_long = F.coalesce(F.length(F.col(text)) > part_chars, F.lit(False))
    short_rows, long_rows = packed(docs.filter(~is_long)), packed(docs.filter(is_long), text=F.col(text))
    kind = short_rows.schema["row"].dataType.simpleString()
    at = [c.lower() for c in docs.columns].index(text.lower())  # most texts travel once, within their rows

    @released
    def short(batches):
        bpe = ByteBpe(path)
        for batch in batches:
            for rows in byte_slices(batch.column("row"), at):
                ids = [bpe.encode(t.as_py() or "") for t in rows.field(at)]
                yield pa.record_batch([rows, _lists(ids)], names=["row", "ids"])

    @released
    def parts(batches):
        for batch in batches:
            for i, (key, t) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                found = [t[begin : begin + part_chars] for begin in range(0, len(t), part_chars)]
                rows = batch.column("row").slice(i, 1).take(pa.array([0] + [None] * (len(found) - 1), pa.int32()))
                yield pa.record_batch([rows, pa.array([key] * len(found), pa.int64()),
                                       pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())],
                                      names=["row", "key", "number", "part"])

    @released
    def part_ids(batches):
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            ids = [bpe.encode(part) for part in batch.column("part").to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in ("row", "key", "number", "part")], _lists(ids)],
                                  names=["row", "key", "number", "part", "ids"])

    vocabularies = []  # of a task

    def joined(table: pa.Table) -> pa.Table:
        if not vocabularies:
            vocabularies.append(ByteBpe(path))
        bpe = vocabularies[0]
        table = table.take(pc.sort_indices(table, [("number", "ascending")]))
        ids = [i.values.to_numpy(zero_copy_only=False).astype(np.uint32) for i in table.column("ids")]
        level = list(zip(table.column("part").to_pylist(), ids, strict=True))
        while len(level) > 1:
            level = [(a[0] + b[0], bpe.concatenated(*a, *b)) if b else a
                     for a, b in zip(level[::2], [*level[1::2], None], strict=False)]
        return pa.table({"row": table.column("row").slice(0, 1).combine_chunks(), "ids": _lists([level[0][1]])})

    encoded = short_rows.mapInArrow(short, f"row {kind}, ids array<int>")
    long = saved(
        long_rows.withColumn("key", F.monotonically_increasing_id())
        .mapInArrow(parts, f"row {kind}, key bigint, number int, part string"))
    rejoined = (
        long.repartition("key", "number")
        .mapInArrow(part_ids, f"row {kind}, key bigint, number int, part string, ids array<int>")
        .groupBy("key").applyInArrow(joined, f"row {kind}, ids array<int>"))
    return unpacked(encoded.unionByName(rejoined), ids=F.col("ids"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint32), *rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(encoded: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Columns of encoded, and the text of its ids; special tokens give their strings, null gives ''."""
    def run(batches):
        bpe = Vocabulary(path)
        for batch in batches:
            rows = batch.column("ids")
            for begin in range(0, len(rows), DECODED_ROWS):
                part = rows.slice(begin, DECODED_ROWS)
                texts = bpe.decode(part)
                yield pa.record_batch([batch.column("row").slice(begin, DECODED_ROWS), pa.array(texts, pa.string())],
                                      names=["row", output])

    whole = packed(encoded, ids=F.col(ids))
    kind = whole.schema["row"].dataType.simpleString()
    found = whole.mapInArrow(run, f"row {kind}, {output} string")
    return unpacked(found, **{output: F.col(output)})
