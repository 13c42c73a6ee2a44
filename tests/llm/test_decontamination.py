"""Benchmark passages against a plain search of all windows, and the edge cases."""

import re

import pytest

from thermotrack.llm import decontamination
from thermotrack.llm.decontamination import Scanner, contamination

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
ITEM = "What is the capital of the large country that lies north of the sea?"
ITEMS = [(1, ITEM), (2, "Short answer"), (3, None), (4, " -- "), (None, "without any id"), (10, "short, ANSWER!"), (1, "élan Élan")]
LONG = "pad " * 400_000 + ITEM.upper().replace(" ", " -- ") + " pad" * 10
DOCS = [
    (1, "x: " + ITEM + " y", "r"), (1, "x: " + ITEM + " y", "r"), (2, LONG, "r"), (3, None, "r"), (4, "", None), (5, " .,\n", "r"),
    (None, "a SHORT answer", "r"), (6, "A short; answer? Short answer", "r"), (7, "élan élan, élan Élan", "r"), (8, "éLAN É", "r"),
    (9, "the capital of the large country that lies north of", "r"), (10, "is the capital of the large country that lies north", "r"),
    (11, "shortanswer without any idea", "r"), (12, "without any id short answer", "r"), (13, "y" * 3_000_000, "r"),
]
KIND = "doc_id bigint, text string, `row` string"


def plain(docs, items, width=10):
    windows = {}
    for i, text in items:
        words = fold(text)
        for n in range(len(words) - min(width, len(words)) + 1 if words else 0):
            windows.setdefault(tuple(words[n : n + width]), set()).add("" if i is None else str(i))
    out = []
    for i, text, _ in docs:
        words, hit, found = fold(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(words[p : p + n])]
        out.append((i, len(words), len(hit), sorted(found)))
    return out


def fold(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def key(row):
    return row[0] is None, row[0] or 0, row[1:]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, block_bytes):
    docs, items = spark.createDataFrame(DOCS, KIND), spark.createDataFrame(ITEMS, "item_id int, text string")
    found = contamination(docs, items, block_bytes=block_bytes)
    assert found.columns[:3] == ["doc_id", "text", "row"]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=key) == sorted(plain(DOCS, ITEMS), key=key)
    for r in got:
        assert r.contaminated == (r.n_hit > 0) == bool(r.spans)
        assert sum(len(fold(r.text[s.begin : s.end])) for s in r.spans) == r.n_hit
        assert all(WORD.match(r.text[s.begin]) and WORD.match(r.text[s.end - 1]) for s in r.spans)
    assert {r.row for r in got if r.doc_id != 4} == {"r"}
    assert [s for r in got if r.doc_id == 9 for s in r.spans] == [(0, 51)]


def test_pieces_keep_the_state(monkeypatch):
    monkeypatch.setattr(decontamination, "pieces", lambda text: [text[i : i + 7] for i in range(0, len(text), 7)])
    scanner = Scanner([("aa bb cc", ["1"]), ("bb cc", ["2"]), ("dd", ["3"])])
    assert scanner.scan(b"zz aa; bb   cc dd zz") == (6, [[1, 4]], {"1", "2", "3"})


def test_little(spark):
    docs, items = spark.createDataFrame(DOCS[:3], KIND), spark.createDataFrame(ITEMS, "item_id int, text string")
    assert contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in contamination(docs, items.limit(0)).collect()} == {0}
    assert contamination(docs, items, keep_text=False).columns == [
        "doc_id", "row", "n_words", "n_hit", "item_ids", "spans", "contaminated"]
    named = spark.createDataFrame([(1, "n", ITEM)], "doc_id int, spans string, text string")
    assert [len(r.spans) for r in contamination(named, items).collect()] == [1]
    pairs = spark.createDataFrame([("q1", "one two three", "four five")], "id string, question string, answer string")
    text = spark.createDataFrame([(1, "one two three x four five")], "doc_id int, text string")
    (row,) = contamination(text, pairs, item_id="id", texts=("question", "answer")).collect()
    assert (row.n_hit, row.item_ids, [(s.begin, s.end) for s in row.spans]) == (5, ["q1"], [(0, 13), (16, 25)])
