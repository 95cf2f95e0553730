"""The contract queries on the driver's smallest tables: against their SQL, or for what they have to hold."""

import datetime
import math
import os
import zlib

import pytest

from cohortlake.llm import queries

FOLDER = os.environ.get("COHORT_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = sql.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_toxicity_query(spark, sql):
    got = queries.op4_toxicity(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(x for (x,) in sql.sql("SELECT doc_id FROM documents").fetchall())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_model_query(spark, sql):
    texts = dict(sql.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    words = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in t.encode().translate(None).decode().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] + ["\n"]
    counts = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in queries.op5_langmodel(spark, FOLDER).collect():
        own = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
