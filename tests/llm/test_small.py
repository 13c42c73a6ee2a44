"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from thermotrack.llm import bpe, chat, chunks, fingerprints, lines, minhash, mixing, neighbours, quality, registry, substrings, toxicity
from thermotrack.llm.common import components

DOCS = "doc_id bigint, text string, source string, row string, id string, chunk string, size string"
PASSAGE = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, PASSAGE + " end", "a", "x", "y", "z", "s"),
    (1, PASSAGE + " end", "a", "x", "y", "z", "s"),
    (2, PASSAGE + " stop", "a", None, None, None, None),
    (3, None, None, "x", "y", "z", "s"),
    (4, "", "", "x", "y", "z", "s"),
    (5, " \n\t", "b", "x", "y", "z", "s"),
    (None, PASSAGE, "b", "x", "y", "z", "s"),
    (6, "one", "b", "x", "y", "z", "s"),
    (7, "alone with <|endoftext|> inside, é\n" + "long " * 9000, "c", "x", "y", "z", "s"),
    (8, "x" * 50_000 + " " + "é" * 40_000, "c", "x", "y", "z", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    hard = ["<|turn|>", "\\", "\\l|", "<", "|>", "<|text|>\\s", "", None, "é\n<|end|>", "<<|more|>"]
    turns = [(1, n, ("user", "assistant", "assistant")[n % 3], t) for n, t in enumerate(hard)]
    turns += [(2, 0, "<|end|>", "a"), (None, None, None, "b"), (None, None, None, "b")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumn(
        "back", chat.parsed_turns(F.col("formatted"))).withColumn("loss", chat.learned_text(F.col("segments"))).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(t[2], t[3] or "") for t in turns[:10]]
    assert got[1].loss == "".join(t[3] or "" for t in turns[:10] if t[2] == "assistant")
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert (got[1].n_turns, got[1].n_blocks) == (10, 7)
    assert [(t.role, t.text) for t in got[2].back] == [("<|end|>", "a")]
    assert got[None].n_turns == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_banded_distance(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a = [r.choice("abé 😀") for _ in range(r.randrange(30))]
        b = list(a)
        for _ in range(r.randrange(5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "a", "c"])
        pairs.append(tuple(sorted(("".join(a), "".join(b)), key=len, reverse=True)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (1, 2, 4):
        found = df.select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect()
        for row in found:
            true = brute.distance(row.a, row.b)
            assert row.d == true if true <= threshold else row.d > threshold


def test_lines(spark, docs, empty):
    base = "the quick brown fox jumps over the lazy dog again and again"
    texts = [(1, base + "\nshort\n\nown line of the first document, unlike"), (2, base.replace("quick", "quack") + "\nshort"),
             (3, base.replace("lazy", "lzay").replace("fox", "foxe")), (4, "short"), (5, "shirt"), (6, None), (7, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("LINE", F.lit(1))
    got = {(r.doc_id, r.line_no): r for r in lines.line_classes(df).collect()}
    assert got[2, 0].root_doc_id == 1 and got[2, 0].n_links == 1 and not got[2, 0].kept
    assert got[3, 0].kept and got[3, 0].n_links == 0
    assert not got[4, 0].kept and got[5, 0].kept
    kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert kept == {1: texts[0][1], 3: texts[2][1], 5: "shirt", 6: None, 7: ""}
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs).filter("doc_id in (7, 8)").count() == 2
    assert lines.line_classes(empty).count() == lines.dedup_lines(empty).count() == 0


def test_lines_of_repeated_ids(spark):
    for i in (None, 5):
        df = spark.createDataFrame([(i, "L of both\nfoo foo foo"), (i, "L of both\nbar bar bar"), (i, "L of both\nbar bar bar")],
                                   "doc_id bigint, text string")
        kept = [r for r in lines.line_classes(df).collect() if r.kept and r.line_no == 0]
        assert len({r.text_hash for r in kept}) == 1
        texts = sorted(r.text for r in lines.dedup_lines(df).collect())
        assert "".join(set(texts)).count("L of both") == 1 and len(texts) == 3


def test_chain_of_lines(spark):
    """Each line is two edits from the one before; a line goes only if one beside it stays."""
    texts = ["".join("x" if k < 2 * n else "a" for k in range(26)) for n in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in lines.line_classes(df).collect() if r.kept}
    assert 0 in kept and all(n in kept or {n - 1, n + 1} & kept for n in range(12))
    assert not any({n, n + 1} <= kept for n in range(12))
    assert {r.doc_id for r in lines.dedup_lines(df).collect()} == kept


def test_one_segment_in_many_lines(spark):
    """Lines that share a segment are dealt to several tasks and all compared."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = [f"Posted by the user number {n * 7919 % 10**6:06d} today" for n in range(3000)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {x.doc_id: x.n_links for x in lines.line_classes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = [sum(brute.distance(texts[n], t) <= 2 for t in texts) - 1 for n in range(0, 3000, 600)]
    assert [got[n] for n in range(0, 3000, 600)] == wanted and max(wanted) > 0


def test_short_lines(spark):
    """Lines of every length against all pairs: an edit for each six characters, two at most."""
    r = random.Random(4)
    texts = {"The anhely eran.", "The, anhely eran.", "Are, is anwh reenen.", "Are is anwh reenen.", "short", "shirt"}
    for _ in range(150):
        line = "".join(r.choice("abcdé😀 ") for _ in range(r.randrange(1, 34)))
        texts.add(line)
        for _ in range(2):
            chars = list(line)
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(chars) + 1)
                chars[at : at + r.randrange(2)] = r.choice(["", "a", "é"])
            texts.add("".join(chars))
    texts = sorted((t for t in texts if brute.WORD.search(t)), key=lambda t: (len(t), t))
    want = dict.fromkeys(range(len(texts)), 0)
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if len(texts[j]) - len(a) <= 2 and brute.distance(a, texts[j]) <= min(2, len(a) // 6):
                want[i] += 1
                want[j] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.n_links for x in lines.line_classes(df).collect()}
    assert got == want
    assert want[texts.index("The anhely eran.")] == want[texts.index("Are is anwh reenen.")] == 1
    assert want[texts.index("short")] == 0 and sum(n > 0 for i, n in want.items() if len(texts[i]) < 12) > 10


def test_minhash(spark, docs, empty):
    got = minhash.near_duplicate_groups(docs).collect()
    by_id = {r.id: r for r in got}
    assert len(got) == len(ROWS)
    assert (by_id[2].component_id, by_id[None].component_id, by_id[2].kept) == (1, 1, False)
    assert (by_id[3].n_shingles, by_id[4].n_shingles, by_id[5].n_shingles, by_id[6].n_shingles) == (0, 0, 0, 1)
    assert all(by_id[i].kept for i in (1, 3, 4, 5, 6, 7, 8))
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == [1, 1, 3, 4, 5, 6, 7, 8]
    assert minhash.near_duplicate_groups(empty).count() == minhash.drop_near_duplicates(empty).count() == 0


def test_minhash_chain(spark):
    """Links between members that a table's smallest class doesn't reach are found as well."""
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(words[2 * n :] + [f"v{n}x{i}" for i in range(2 * n)])) for n in range(8)]
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicate_groups(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.near_groups(rows)


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and "row" in got[0].asDict()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert {r.target for r in got if r.source is None} == {0.0}
    assert mixing.mix_sources(empty).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 5)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"b": 30.0, "c": 300.0, None: 15.0, "a": 770.0}


def test_bpe(docs, empty):
    library = Tokenizer.from_file(registry.vocabulary())
    got = bpe.decode(bpe.encode(docs, registry.vocabulary(), part_chars=1000), registry.vocabulary()).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(empty, registry.vocabulary()).count() == 0


def test_bpe_sends_short_texts_once(docs):
    """Tasks get a text within its row only, not beside it as well; the name of the column may differ in case."""
    ids = bpe.encode(docs, registry.vocabulary(), text="TEXT")
    assert re.search(r"MapInArrow short\(row#\d+\)", ids._jdf.queryExecution().analyzed().toString())
    library = Tokenizer.from_file(registry.vocabulary())
    for r in ids.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids


def test_bpe_joins():
    own, library = bpe.ByteBpe(registry.vocabulary()), Tokenizer.from_file(registry.vocabulary())
    r = random.Random(7)
    for _ in range(60):
        text = "".join(r.choice(["a", "b", "the", "ing", "é", "日"]) for _ in range(r.randrange(3000)))
        piece = text.encode()
        cut = r.randrange(len(piece) + 1)
        assert own.tree(piece) == library.encode(text).ids
        assert own.join(own.tree(piece[:cut]), own.tree(piece[cut:])) == library.encode(text).ids


def test_bpe_of_texts_cut_anywhere():
    """Halves of any text join to its ids: words, runs without a cut, white space, special tokens at the cut."""
    own, library = bpe.ByteBpe(registry.vocabulary()), Tokenizer.from_file(registry.vocabulary())
    special = next(iter(own.special_id))
    r = random.Random(8)
    parts = ["the ", "ing", "'s", "'", "ll", " ", "  ", "\n", "\t", "é", "日本", "123", "7", "...", "<|", "|>", special, special[:5],
             special[5:], "x" * 90, " " * 40, "a b\n\n", "😀", "!?"]
    cut = 0
    for n in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 60)))
        if n % 20 == 0:
            text += r.choice(["ab", " ", "é", "1"]) * 3000 + text
        want = library.encode(text, add_special_tokens=False).ids
        at = r.randrange(len(text) + 1)
        left, right = text[:at], text[at:]
        got = own.concatenated(left, own.encode(left), right, own.encode(right))
        assert got.tolist() == want
        cut += left != "" and right != "" and own.encode(left).tolist() + own.encode(right).tolist() != want
    assert cut > 100  # joins that had something to mend


def test_long_texts_are_joined(spark, monkeypatch):
    """Every text over the length of a part goes through the tree, and gives the library's ids."""
    library = Tokenizer.from_file(registry.vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = bpe.decode(bpe.encode(docs, registry.vocabulary(), part_chars=300), registry.vocabulary()).collect()
    assert sum(len(r.text or "") > 300 for r in got) > 50
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    own, joins = bpe.ByteBpe(registry.vocabulary()), []
    whole = own.concatenated
    monkeypatch.setattr(own, "concatenated", lambda *a: joins.append(a) or whole(*a))
    text = max((r.text or "" for r in got), key=len)
    level = [(text[i : i + 500], own.encode(text[i : i + 500])) for i in range(0, len(text), 500)]
    while len(level) > 1:
        level = [(a[0] + b[0], own.concatenated(*a, *b)) if b else a
                 for a, b in zip(level[::2], [*level[1::2], None], strict=False)]
    assert level[0][1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(joins) == -(-len(text) // 500) - 1 > 10


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1))
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.filter("vec_id = 0"), k=4).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 1.0), (0, 4, 3, 0.0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0


def test_neighbours_in_cells(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) + (3 if j == i % 5 else 0) for j in range(16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = df.filter("vec_id % 50 = 0")
    one = {(x.query_id, x.vec_id) for x in neighbours.nearest(df, queries, cell_rows=10_000, confidence=0.999999).collect()}
    many = {(x.query_id, x.vec_id) for x in neighbours.nearest(df, queries, cell_rows=50).collect()}
    assert len(one) == len(many) == 60 and len(one & many) >= 54


def test_substrings(spark, docs, empty):
    got = [r for r in substrings.remove_repeats(docs).collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=str) == sorted(
        [(1, 41, 0), (1, 41, 41), (2, 41, 40), (3, 0, 0), (4, 0, 0), (5, 0, 0), (None, 40, 40), (6, 1, 0),
         (7, 9005, 8999), (8, 2, 0)], key=str)
    assert next(r for r in got if r.doc_id == 2).removed[0].asDict() == {"begin": 0, "end": 40}
    small = substrings.remove_repeats(docs, chunk_bytes=100, range_words=50).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert substrings.remove_repeats(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    got = fingerprints.edited_likeness(docs).collect()
    small = fingerprints.edited_likeness(docs, chunk_bytes=100).collect()
    assert sorted(map(str, small)) == sorted(map(str, got)) and len(got) == len(ROWS)
    marks = fingerprints.with_fingerprint(docs).collect()
    by_text = {(r.text or ""): r.fingerprint for r in marks}
    assert all(r.fingerprint == by_text[r.text or ""] for r in marks) and by_text[""] == ""
    assert fingerprints.edited_likeness(empty).count() == fingerprints.with_fingerprint(empty).count() == 0
    assert fingerprints.edited_likeness(docs.filter("doc_id = 6")).first().near_next == 1.0


def test_every_text_has_an_anchor():
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghijkl mnopqrst") for _ in range(n)) for n in range(1, 45) for _ in range(40)]
    marks = fingerprints.fingerprints_of(["", *texts])
    assert marks[0] == "" and all(marks[1:])
    assert fingerprints.fingerprints_of(texts[:1000:7]) == marks[1:1001:7]  # whatever is beside it
    unrelated = [(a, b) for a, b in zip(marks[1:], marks[41:], strict=False)][23 * 40 : 37 * 40]
    assert all(a != b and fingerprints.likeness_of(a, b) == 0.0 for a, b in unrelated)
    assert all(fingerprints.likeness_of("", m) == 0.0 for m in marks[1:])
    halves = [t[: len(t) - len(t) // 2] + "#" * (len(t) // 2) for t in texts[23 * 40 : 37 * 40]]
    edited = fingerprints.fingerprints_of(halves)
    assert all(fingerprints.likeness_of(a, b) < 1.0 for a, b in zip(marks[1 + 23 * 40 :], edited, strict=False))


def test_anchors_are_context_free():
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(2000))
    inside, whole = fingerprints.fingerprints_of([text[500:1500], text])
    codes = {whole[i : i + 4] for i in range(0, len(whole), 5)}
    assert all(inside[i : i + 4] in codes for i in range(0, len(inside), 5))
    assert fingerprints.likeness_of(inside, whole) > 0.6


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    plain = [[r.choice(["sun", "rain", "wind", "snow", "cloud"]) for _ in range(6)] for _ in range(400)]
    rows = [(i, ". ".join([" ".join(w), "nasty words here" if i % 3 == 0 else "kind words here"])) for i, w in enumerate(plain)]
    labelled = [(i, int(i % 3 == 0)) for i in range(400)] + [(1, None), (None, 1), (2, 7)]
    labels = spark.createDataFrame(labelled, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    ask = spark.createDataFrame([(1, "rain. Nasty snow! wind"), (2, "rain snow"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in toxicity.score_toxicity(ask, model).collect()}
    assert [(s.begin, s.end) for s in got[1].toxic_spans] == [(6, 16)]
    assert got[1].is_toxic and not got[2].is_toxic and got[3].toxicity == got[4].toxicity == 0.0
    assert toxicity.score_toxicity(docs, model).count() == len(ROWS)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(docs, labels.limit(0)).weights == {}


def test_toxicity_passes_over_long_texts(spark):
    order = [x.id for x in spark.range(400).orderBy(F.xxhash64("id")).collect()]
    early = set(order[:40])
    rows = [(i, ("nasty words here" if i % 3 == 0 else "kind words here") + (" sun rain" * 3000 if i in early else ""))
            for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(texts, labels, sample_bytes=20_000)
    got = {x.doc_id: x.is_toxic for x in toxicity.score_toxicity(texts, model).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(400))
    with pytest.raises(ValueError, match="no toxicity model"):
        toxicity.fit_toxicity(texts, labels, sample_bytes=10)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.quality for r in quality.quality_of(docs, labels).collect()} == {0.5}
    assert quality.quality_of(empty, labels).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 300)] + [(5, 5), (301, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 300)} == {100}
    assert got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chunks_keep_ids_together(spark):
    rows = spark.createDataFrame([(i % 50, "x" * 100) for i in range(500)] + [(None, "y")], "id bigint, text string")
    found, total, last = chunks.id_chunks(rows, 1000)
    assert total == 50_001 and found.groupBy("id").agg(F.countDistinct("chunk").alias("n")).filter("n > 1").count() == 0
    assert found.filter("id is null").first().chunk == last
