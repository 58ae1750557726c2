"""Every registered query of the scan against its SQL, on the same tables."""

import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgate.operators import detectors
from siltgate.operators import similarity
from siltgate.operators.similarity import Best, nearest
from siltgate.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    got = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    want = rows_of(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == want
    # No document of the smallest tables has a token candidate.
    assert want or name == "entropy_tokens"


def test_flagship_has_a_row_for_every_message(spark, small):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    messages = sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("conversations", "documents"))
    assert got.count() == messages and set(got.columns) >= {"req_id", "verdict", "top_layer", "n_hits"}


def test_session_windows_hold_all_earlier_turns(spark, tmp_path):
    from siltgate.plans.queries import requests

    spark.createDataFrame([(1, t, "user", f"text {t}") for t in range(50)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.req_id: r.session_window for r in requests(spark, str(tmp_path)).collect()}
    assert got == {f"c-1-{t}": [f"text {i}" for i in range(t)] for t in range(50)}


def test_a_card_before_an_address_is_not_drawn_into_it(spark, tmp_path):
    whole = ["4451718024887799 27.65.93.188 x", "pay 4111111111111111 53", "1 4111111111111111 27 end", "4111-1111-1111-1111 or 4111 1111 1111 1111"]
    parts = ["12345 4111111111111111", "4111111111111111\n27 28", "4111111111111 4111111111111", "12345678901234567890 12", "1.4111111111111111 27", "411111111111 1111 27", "", None]
    rows = list(enumerate([*whole, *parts]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(ORACLE_SQL["card_luhn"])
    columns = [d[0] for d in got.description]
    df = QUERIES["card_luhn"](spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == rows_of(columns, got.fetchall())
    hits = spark.createDataFrame([(whole[0],)], "text string").select(detectors.recognise(F.col("text")).alias("r")).first().r
    assert ("CREDIT_CARD", 0, 16) in {(h.entity_type, h.start, h.end) for h in hits}


def test_similarity_hits_equal_their_sql_on_copies_and_half_hundredths(spark, tmp_path):
    """Scores such as 0.565 and 0.625, which decimal rounding prints otherwise, and copies that tie over many tasks."""
    rng = np.random.default_rng(5)
    wanted = [0.565, 0.625, 0.875, 0.995, 0.785, 0.545]
    rows = [(50 * (i + 1), [1.0 if j == 2 * i else 0.0 for j in range(16)]) for i in range(6)]
    rows += [(50 * (i + 1) + 1, [s if j == 2 * i else (1 - s * s) ** 0.5 if j == 2 * i + 1 else 0.0 for j in range(16)]) for i, s in enumerate(wanted)]
    copies = rng.normal(size=(3, 16))
    rows += [(1000 + i, [float(x) for x in copies[i % 3]]) for i in range(240)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, label long")
    df.repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("similarity_hits", "similarity_topk"):
        got = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in got.description]
        want = rows_of(columns, got.fetchall())
        found = QUERIES[name](spark, str(tmp_path))
        assert rows_of(found.columns, found.collect()) == want


def test_scores_of_copies_do_not_depend_on_their_tile():
    rng = np.random.default_rng(0)
    asked, base = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(5, 64)), rng.normal(size=(203, 64))))
    whole = {(q, r): s for q, r, s in zip(*nearest(asked, base, 203), strict=True)}
    for a in range(0, 203, 7):
        for q in range(5):
            _, r, s = nearest(asked[q : q + 1], base[a : a + 7], 7)
            assert [whole[q, a + i] for i in r] == s.tolist()


def test_similarity_hits_are_for_every_row(spark, tmp_path, monkeypatch):
    """Rows whose id is not divisible by 50 have hits too, in whatever blocks and tiles; rows without a vector are rows."""
    monkeypatch.setattr(similarity, "LEAST_ROWS", 40)
    monkeypatch.setattr(similarity, "TILE", (16, 24))
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(60)] + [(210, None), (250, None)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, label long")
    for name, some in (("all", df), ("one", df.where("vec_id = 7")), ("none", df.where("vec_id < 0")), ("two", df.where("vec_id in (7, 210)"))):
        some.repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        con = duckdb.connect()
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label BIGINT)")
        for r in some.collect():
            con.execute("INSERT INTO embeddings VALUES (?, ?, ?)", tuple(r))
        got = con.execute(ORACLE_SQL["similarity_hits"])
        columns = [d[0] for d in got.description]
        found = QUERIES["similarity_hits"](spark, f"{tmp_path}/{name}")
        result = found.collect()
        assert len(result) == {"all": 212, "one": 0, "none": 0, "two": 2}[name]
        assert rows_of(found.columns, result) == rows_of(columns, got.fetchall())


def test_the_best_of_streamed_rows_are_the_nearest():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1_003, 32))
    base[rng.integers(0, 1_003, 400)] = base[5]
    base[700:720] = base[5] * 3 + rng.normal(size=(20, 32)) * 1e-7
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    best = Best(base[::3], 7)
    for a in (*range(0, 5), *range(5, 1_003, 97)):
        b = a + 1 if a < 5 else min(a + 97, 1_003)
        best.add(base[a:b], np.arange(a, b))
    for got, want in zip(best.of(0, len(base)), nearest(base[::3], base, 7), strict=True):
        assert got.tolist() == want.tolist()
