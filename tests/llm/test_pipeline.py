"""Every stage of the pipeline against plain versions on its own input, and odd rows."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_models import plain_toxicity
from thermotrack.llm import registry, toxicity

SF = "/root/testdata/sf0.001"
MINE = {"size": "size of mine", "repeats": "2", "taken": None, "toxicity": "no", "row": "r", "id": "i", "TEXT_HASH": "h", "lost": "l"}


@pytest.fixture(scope="module")
def stages(spark):
    """{stage: (rows in, rows out)} with columns of the user's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({c: F.lit(v).cast("string") for c, v in MINE.items()})
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF).cache()
        found[name] = docs.collect(), result.collect()
        if name != "bpe":
            assert result.columns == docs.columns
        docs = result
    return found


def test_columns_of_the_user_stay(stages):
    for _, out in stages.values():
        assert out and all(r[c] == v for r in out for c, v in MINE.items())


def test_toxicity_stage(spark, stages):
    rows, out = stages["toxicity"]
    model = toxicity.fit_toxicity(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")])
    want = {r.doc_id for r in rows if plain_toxicity(r.text, model) < 0.3}
    assert {r.doc_id for r in out} == want and len(out) == len(want) < len(rows)


def test_line_stage(stages):
    rows, out = stages["line_dedup"]
    places = {}
    for i, text in sorted((r.doc_id, r.text) for r in rows):
        for n, line in enumerate((text or "").split("\n")):
            if brute.WORD.search(line):
                places.setdefault(line, []).append((i, n))
    links = brute.line_links(places)
    after = {r.doc_id: r.text for r in out}
    left = collections.Counter(line for t in after.values() for line in (t or "").split("\n") if brute.WORD.search(line))
    assert set(left) <= set(places) and set(left.values()) == {1}
    for line in places:
        assert bool(links[line] & set(left)) != (line in left)
    for r in rows:
        lines = (r.text or "").split("\n")
        own = [x for n, x in enumerate(lines) if not brute.WORD.search(x) or (x in left and places[x][0] == (r.doc_id, n))]
        if any(map(brute.WORD.search, lines)) and not any(map(brute.WORD.search, own)):
            assert r.doc_id not in after
        else:
            assert after[r.doc_id] == (None if r.text is None else "\n".join(own))
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None) and len(out) < len(rows)


def test_near_stage(stages):
    rows, out = stages["near_dedup"]
    groups = brute.near_groups([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in out) == sorted(i for i, (_, _, kept) in groups.items() if kept)


def test_mixing_stage(spark, stages):
    rows, out = stages["mixing"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    times = collections.Counter(r.doc_id for r in out)
    for doc_id, size, taken in con.execute(f"select doc_id, size, taken from ({registry.OP4})").fetchall():
        assert size == 0 or times[doc_id] * size == taken
    assert len(set(times.values())) > 1


def test_bpe_stage(stages):
    library = Tokenizer.from_file(registry.vocabulary())
    rows, out = stages["bpe"]
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in out)
    for r in out:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_odd_rows_and_empty_tables(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = "some words that go on " * 20
    odd = [(1, None, None, None, None), (2, "", "a", "s", 0), (None, long + "end", "a", None, 5), (None, long + "end", "a", None, 5),
           (3, " \n ", "a", "s", 3), (4, long, "a", "s", 9), (4, long, "a", "s", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF).cache()
            found = result.collect()
            assert len(found) >= (1 if rows else 0) and (name == "bpe" or result.columns == docs.columns)
            if rows and name != "mixing":
                assert {1, 2} <= {r.doc_id for r in found} or name == "bpe"
            docs = result
        assert rows or not found
