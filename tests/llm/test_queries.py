"""Registered queries on the smallest tables: the columns and digests that their contracts name."""

import hashlib
import math
from collections import defaultdict

import pytest

from maskmill.llm import pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_spans_of_personal_data(spark, tables):
    got = {r["doc_id"]: r for r in queries.op7_personal_data(spark, SF).collect()}
    assert len(got) == len(tables("documents"))
    for doc in tables("documents"):
        found = pii.base_spans(doc["text"] or "")
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))
        r = got[doc["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in found) for i in range(4)]


def test_main_texts_have_their_length(spark, tables):
    rows = queries.op10_dom_model(spark, SF).collect()
    assert {r["page_id"] for r in rows} == {r["page_id"] for r in tables("pages")}
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in rows) and sum(r["n_chars"] > 0 for r in rows) > len(rows) / 2


def test_neighbours_have_their_distance(spark, tables):
    vectors = {r["vec_id"]: r["embedding"] for r in tables("embeddings")}
    by = defaultdict(list)
    for r in queries.op6_pruned_graph(spark, SF).collect():
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(by) == {v for v in vectors if v % 100 == 0}
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, min(10, len(vectors) - 1) + 1)) and rows == sorted(rows, key=lambda r: (r[1], r[2]))
        assert all(math.isclose(s, math.dist(vectors[q], vectors[v]), rel_tol=1e-9) for _, s, v in rows)


def test_mix_places_every_document_once(spark, tables):
    rows = queries.op1_pfair_mix(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in tables("documents"))
    assert len({r["mix_position"] for r in rows}) == len(rows)


@pytest.mark.parametrize(("name", "least"), [("op3_quality", 0.3), ("op8_toxicity", 0.5)])
def test_scores_and_predictions_agree(spark, tables, name, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(tables("documents")) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
