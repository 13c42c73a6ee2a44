"""Registered queries on the smallest tables against their definitions in plain Python or DuckDB."""

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import compare, connect
from tests.llm import brute
from thermotrack.llm import registry
from thermotrack.llm.minhash import near_duplicate_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def rows(spark, name, key):
    return {r[key]: r for r in registry.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    assert compare(spark, connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_lines(spark, sf):
    docs = duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {(r.doc_id, r.line_no): r for r in registry.op2_line_dedup(spark, sf).collect()}
    places = {}
    for i, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            if brute.WORD.search(line):
                places.setdefault(line, []).append((i, n))
    links = brute.line_links(places)
    roots = brute.roots_of([(places[a][0], places[b][0]) for a in links for b in links[a]], [p[0] for p in places.values()])
    assert len(got) == sum(map(len, places.values()))
    stays = {line for line, at in places.items() if got[at[0]].kept}
    for line, at in places.items():
        for place in at:
            r = got[place]
            assert (r.class_doc_id, r.class_line_no) == at[0]
            assert (r.root_doc_id, r.root_line_no) == roots[at[0]]
            assert (r.n_links, r.kept) == (len(links[line]), place == at[0] and line in stays)
        if line in stays:
            assert not links[line] & stays
        else:
            assert links[line] & stays and roots[at[0]] != at[0]


def test_bpe(spark, docs):
    library = Tokenizer.from_file(registry.vocabulary())
    got = rows(spark, "op5_bpe", "doc_id")
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[i]) == (i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(back))


def test_neighbours(spark):
    found = duckdb.connect().execute(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    ids, v = np.array([r[0] for r in found]), np.array([r[1] for r in found], float)
    norms = np.sqrt((v * v).sum(axis=1))
    got = {(r.query_id, r["rank"]): r for r in registry.op6_neighbours(spark, SF).collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (v @ v[i]) / (norms * norms[i])
        score[i] = -2
        best = np.lexsort((ids, -score))[:5]
        own = [got[ids[i], n] for n in range(1, 6)]
        hits += len({r.vec_id for r in own} & set(ids[best].tolist()))
        total += 5
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in own)
    assert hits >= 0.9 * total


def test_near_groups(spark, docs):
    want = brute.near_groups(docs)
    got = rows(spark, "op7_minhash_groups", "doc_id")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want
    assert any(not kept for _, _, kept in want.values())


def test_substrings(spark, docs):
    got = rows(spark, "op8_substring_dedup", "doc_id")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.without_repeats(docs)


def test_fingerprints(spark, docs):
    got = rows(spark, "op9_fingerprints", "doc_id")
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute.edited(docs)
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.05 > np.mean([r.near_next for r in long])


@pytest.mark.parametrize(("name", "label"), [("op3_toxicity", "toxic"), ("op10_quality", "quality")])
def test_classifiers(spark, name, label):
    labels = dict(duckdb.connect().execute(f"select doc_id, {label} from '{SF}/labels.parquet'").fetchall())
    got = rows(spark, name, "doc_id")
    assert all(r.held_out == brute.held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    pairs = [(r.score, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    ones, zeros = [[s for s, y in pairs if y == want] for want in (1, 0)]
    if ones and zeros:
        above = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
        assert above >= (0.95 if label == "quality" else 0.6) * len(ones) * len(zeros)


def test_pipeline(spark, docs):
    library = Tokenizer.from_file(registry.vocabulary())
    got = corpus_pipeline.run(spark, SF).collect()
    texts = dict(docs)
    assert 0 < len(got) < 3 * len(docs)
    for r in got:
        assert set((r.text or "").split("\n")) <= set((texts[r.doc_id] or "").split("\n"))
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    kept = spark.createDataFrame([(r.doc_id, r.text) for r in {r.doc_id: r for r in got}.values()], "doc_id bigint, text string")
    assert near_duplicate_groups(kept).filter("not kept").count() == 0
