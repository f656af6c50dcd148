"""The registered queries on the smallest tables, against SQL or brute force."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomstone.llm import license_scan as L
from loomstone.llm import queries as Q
from loomstone.llm import token_counts as C
from tests.llm.test_near_duplicates import near, plain_components, plain_fingerprint
from tests.llm.test_tokens import RANKS, plain_sections, ranks  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{DATA}/documents.parquet")
    return dict(sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)))


def run(spark, name):
    return {r.doc_id: r for r in Q.queries()[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found, want = Q.queries()[name](spark, DATA).toArrow(), con.sql(Q.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(found.column_names) == names
    rows = lambda t: sorted(zip(*[t[n].to_pylist() for n in names], strict=True))
    assert rows(found) == rows(want)


def test_token_files_and_codes(spark, docs):
    tokenizer = Tokenizer.from_file(Q.word_vocabulary())
    files, codes, start = run(spark, "op1_bitplanes"), run(spark, "op3_bpe"), 0
    assert set(files) == set(codes) == set(docs)
    for i, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        whole = np.array([*ids, 2], "<u4")
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (codes[i].n_tokens, codes[i].ids_sha256, codes[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_token_counts(spark, docs, ranks):  # noqa: F811
    found = {}
    for r in Q.op2_token_counts(spark, DATA).collect():
        found.setdefault(r.doc_id, []).append((r.section, r.n_tokens))
    for i, text in docs.items():
        lines = [x + "\n" for x in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        bounds = np.cumsum([0, *[len(x.encode()) for x in lines]]).tolist()
        if len(text) < 3000:
            assert [n for _, n in sorted(found[i])] == plain_sections(ranks, text, bounds, "largest")
        assert sum(n for _, n in found[i]) == len(ranks.encode_ordinary(text))
    assert C.RULES and RANKS


def test_simhash(spark, docs):
    found = run(spark, "op5_simhash")
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    values = sorted(set(fps.values()))
    root, least = plain_components(values, near(values)), {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert {i: r.component_id for i, r in found.items()} == {i: least[root[f]] for i, f in fps.items()}


def test_licenses(spark, docs):
    found, known = run(spark, "op8_license_scan"), L.Templates(L.TEMPLATES)
    want = {i: [] for i in docs}
    order = list(docs)
    for t, owner, share, _ in L.find_templates(pa.array(list(docs.values())), known, banded=False):
        want[order[t]].append((known.names[owner], share))
    assert {i: [(x.name, x.containment) for x in r.licenses] for i, r in found.items()} == want
    assert all(r.n_licenses == len(want[i]) and r.names == ",".join(n for n, _ in want[i]) for i, r in found.items())


def test_toxicity_is_right_on_most_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("the larger tables are not there")
    labels = pq.read_table(f"{data}/labels.parquet")
    truth = dict(zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist(), strict=True))
    rows = [r for r in Q.op4_toxicity(spark, data).collect() if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.95
    toxic = [r for r in rows if truth[r.doc_id] == 1]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    clean = [r for r in rows if truth[r.doc_id] == 0]
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
