"""Benchmark passages in documents, found by an Aho-Corasick automaton over normalised words."""

import re
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import packed, saved

WIDTH = 10  # words of a window
BLOCK_BYTES = 16 << 20  # of benchmark windows in one automaton
PIECE_BYTES = 1 << 20  # of text turned to words at once
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text: a-z, 0-9 and what isn't ASCII
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_ORIGINAL = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

RESULT = {"n_words": "bigint", "n_hit": "bigint", "item_ids": "array<string>",
          "spans": "array<struct<begin:int,end:int>>"}


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", texts=("text",)) -> DataFrame:
    """(window, items): the distinct windows of all text columns of the items, each a run of width
    words joined by spaces, or all words of a text that has fewer, with the sorted ids (as strings, a
    null id as "") of the items that have it. Texts without words have no window. One item's windows
    are made in one row, so an item is to fit in memory."""
    words = F.regexp_extract_all(F.translate(F.col("_text"), _UPPER, _LOWER), F.lit(_WORD), 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (width - 1)),
                       lambda i: F.array_join(F.slice("_w", i, width), " "))
    cut = (F.when(F.size("_w") >= width, runs).when(F.size("_w") > 0, F.array(F.array_join("_w", " ")))
           .otherwise(F.array().cast("array<string>")))
    item = F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_item")
    whole = None
    for column in texts:
        part = benchmark.select(item, F.col(column).alias("_text")).filter(F.col("_text").isNotNull())
        whole = part if whole is None else whole.unionAll(part)
    found = whole.select("_item", words.alias("_w")).select("_item", F.explode(cut).alias("window"))
    return found.groupBy("window").agg(F.sort_array(F.collect_set("_item")).alias("items"))


class Scanner:
    """One automaton over the windows of a block; its letters are the numbers of their words."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.numbers = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" "))
            self.automaton.add_word(key, (len(key), items))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, the runs [first, last] of hit words in rising order, items that occur.

        The text is read once, piece by piece; the automaton goes on from its state at each piece.
        """
        done, runs, found = 0, [], set()
        search = self.automaton.iter(()) if self.numbers else None
        for piece in pieces(text or b""):
            words = piece.translate(_NORMAL).split()
            if search is not None and words:
                search.set(tuple(map(self.numbers.get, words, repeat(0))), False)
                for last, (length, items) in search:
                    found.update(items)
                    first = last - length + 1
                    while runs and runs[-1][1] >= first - 1:  # a longer window may end after shorter ones
                        before = runs.pop()
                        first, last = min(first, before[0]), max(last, before[1])
                    runs.append([first, last])
            done += len(words)
        return done, runs, found


def pieces(text: bytes, most: int = PIECE_BYTES):
    """text in pieces of some `most` bytes, cut between words."""
    begin = 0
    while begin < len(text):
        cut = _BREAK.search(text, begin + most)
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


def merged(runs) -> list[tuple[int, int]]:
    """Runs [first, last] joined where they touch, in rising order."""
    out = []
    for first, last in sorted(tuple(r) for r in runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def original_spans(text: bytes, runs) -> list[dict]:
    """Begin and end, in code points of the original text, of runs of word numbers."""
    spans, waiting = [], iter(runs)
    run = next(waiting, None)
    for n, match in enumerate(_ORIGINAL.finditer(text.decode("utf-8", "surrogatepass"))):
        if run is None:
            break
        if n == run[0]:
            begin = match.start()
        if n == run[1]:
            spans.append({"begin": begin, "end": match.end()})
            run = next(waiting, None)
    return spans


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
                  keep_text: bool = True, text: str = "text", item_id: str = "item_id", texts=("text",)) -> DataFrame:
    """Columns of docs (text only if keep_text), and what of the benchmark occurs in each text:
    n_words, n_hit (words inside any occurrence of a window, see `benchmark_windows`), item_ids (sorted
    strings, a null id as ""), spans (begin and end of each run of hit words, in code points of the
    text as it is), contaminated (n_hit > 0). These replace columns of the same names.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Every whole text is
    read once, by an automaton over all windows. Windows go to the tasks by value, so their bytes are
    counted first: beyond block_bytes they are dealt by hash to several automata of at most some
    block_bytes, and a text is read once by each, with the table saved in between. Null and empty
    texts have no words; an empty benchmark hits nothing; repeated rows are each answered; an item id
    that occurs twice is one item.
    """
    windows = saved(benchmark_windows(benchmark, width, item_id, texts))
    items_bytes = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + F.octet_length(i) + 8)
    size = windows.agg(F.sum(F.octet_length("window") + items_bytes)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    others = docs.select(*[c for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_none")])
    row = F.struct(*[F.col(f"`{c}`") for c in others.columns]) if others.columns != ["_none"] else F.struct(
        F.lit(None).cast("int").alias("_none"))
    table = docs.select(row.alias("row"), F.col(text).cast("binary").alias("text"),
                        F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<array<bigint>>").alias("runs"),
                        F.array().cast("array<string>").alias("item_ids"))
    row_kind = table.schema["row"].dataType.simpleString()
    for block in range(blocks):
        dealt = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        own = sorted((r["window"], list(r["items"])) for r in dealt.collect())  # at most some block_bytes
        last = block == blocks - 1
        if last:
            schema = f"row {row_kind}, text binary, " + ", ".join(f"{n} {kind}" for n, kind in RESULT.items())
            if not keep_text:
                schema = schema.replace("text binary, ", "")
        else:
            schema = f"row {row_kind}, text binary, n_words bigint, runs array<array<bigint>>, item_ids array<string>"
        table = table.mapInArrow(_scanner(own, last, keep_text), schema)
        table = table if last else saved(table)
    added = [F.col(c) for c in RESULT] + [(F.col("n_hit") > 0).alias("contaminated")]
    new = {c.lower() for c in (*RESULT, "contaminated")}
    old = [F.col("text").cast("string").alias(text) if c == text else F.col("row").getField(c).alias(c)
           for c in docs.columns if c.lower() not in new and (keep_text or c != text)]
    return table.select(*old, *added)


def _scanner(windows, last: bool, keep_text: bool):
    """Function of batches for one block of windows; the last one gives the result's columns."""
    def run(batches):
        scanner = Scanner(windows)
        for batch in batches:
            counts, hits, items, spans = [], [], [], []
            before = zip(batch.column("text"), batch.column("runs"), batch.column("item_ids"), strict=True)
            for text, runs, known in before:
                text = text.as_py()
                n, found_runs, found = scanner.scan(text)
                if len(runs) or found_runs:
                    found_runs = merged([*runs.as_py(), *found_runs])
                    found = sorted(found.union(known.as_py()))
                else:
                    found = []
                counts.append(n)
                items.append(found)
                hits.append(found_runs)
                if last:
                    spans.append(original_spans(text, found_runs) if found_runs else [])
            columns = {"row": batch.column("row"), "text": batch.column("text"), "n_words": pa.array(counts, pa.int64())}
            if last:
                columns["n_hit"] = pa.array([sum(b - a + 1 for a, b in r) for r in hits], pa.int64())
            else:
                columns["runs"] = pa.array([[list(r) for r in one] for one in hits], pa.list_(pa.list_(pa.int64())))
            columns["item_ids"] = pa.array(items, pa.list_(pa.string()))
            if last:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                columns["spans"] = pa.array(spans, kind)
                if not keep_text:
                    del columns["text"]
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run
