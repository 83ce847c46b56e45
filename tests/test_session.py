"""Statements end to end on snapshot tables: hand-made fixtures with known answers."""

import json
import random
import socket

import pytest

from tessera.functions.errors import SqlError
from tessera.plans import server, tpcc
from tessera.plans.session import Session
from tessera.sources import catalog
from tessera.sources.catalog import Catalog


@pytest.fixture(params=["standard", "compat"])
def db(spark, tmp_path, request):
    return Session(spark, f"file://{tmp_path}/db", request.param)


def rows(db, sql, params=None):
    return db.execute(sql, params).rows()


@pytest.fixture
def base(db):
    db.execute("CREATE TABLE base (id int, value varchar(20), PRIMARY KEY (id))")
    db.execute_batch("INSERT INTO base VALUES (?, ?)", [[i, f"row_{i}"] for i in (101, 103, 104, 107)])
    return db


def test_sums_and_counts(base):
    assert rows(base, "SELECT SUM(id) FROM base") == [[415]]
    assert rows(base, "SELECT SUM(id) FROM base WHERE id >= 104") == [[211]]
    assert rows(base, "SELECT COUNT(*) AS n FROM base") == [[4]]
    assert base.execute("SELECT COUNT(*), SUM(id) FROM base").columns() == ["count(*)", "sum(id)"]
    assert rows(base, "SELECT SUM(id), COUNT(*) FROM base WHERE id > 1000") == [[None, 0]]


def test_nulls(db):
    db.execute("CREATE TABLE n (id int, note varchar(9), x decimal(5,2))")
    db.execute("INSERT INTO n (id, note) VALUES (1, 'alpha'), (2, 'alpha'), (3, 'beta'), (4, NULL)")
    assert rows(db, "SELECT COUNT(note), COUNT(DISTINCT note), COUNT(*) FROM n") == [[3, 2, 4]]
    kept = [r[0] for r in rows(db, "SELECT id FROM n WHERE note < 'b' ORDER BY id")]
    assert kept == ([1, 2, 4] if db.mode == "compat" else [1, 2])
    assert [r[0] for r in rows(db, "SELECT id FROM n ORDER BY note, id")] == [4, 1, 2, 3]
    assert [r[0] for r in rows(db, "SELECT id FROM n ORDER BY note DESC, id")] == [3, 1, 2, 4]


def test_join(base):
    base.execute("CREATE TABLE j (code int, label varchar(9), PRIMARY KEY (code))")
    base.execute("INSERT INTO j VALUES (101, 'alpha'), (999, 'beta')")
    assert rows(base, "SELECT value, label FROM base, j WHERE id = code") == [["row_101", "alpha"]]
    assert len(rows(base, "SELECT * FROM base, j")) == 8
    with pytest.raises(SqlError):
        base.execute("SELECT a.id FROM base WHERE a.id = 1")


def test_bulk_join(db):
    for t in ("a", "b"):
        db.execute(f"CREATE TABLE {t} ({t}_id int, PRIMARY KEY ({t}_id))")
        db.execute_batch(f"INSERT INTO {t} VALUES (?)", [[i] for i in (101, 103, 104, 107, *range(1000, 1996))])
    assert [r[0] for r in rows(db, "SELECT a_id FROM a, b WHERE a_id = b_id ORDER BY a_id DESC LIMIT 5")] == [1995, 1994, 1993, 1992, 1991]


def test_unique_key(base):
    with pytest.raises(SqlError, match="duplicate"):
        base.execute("INSERT INTO base VALUES (101, 'again')")
    with pytest.raises(SqlError, match="duplicate"):
        base.execute("INSERT INTO base VALUES (1, 'a'), (1, 'b')")
    with pytest.raises(SqlError, match="duplicate"):
        base.execute("UPDATE base SET id = 101")
    assert rows(base, "SELECT COUNT(*) FROM base") == [[4]]  # nothing is half done


def test_update(base):
    assert base.execute("UPDATE base SET id = id + 1, value = 'x' WHERE id = 101").update_count == 1
    assert rows(base, "SELECT value FROM base WHERE id = 102") == [["x"]]
    if base.mode == "compat":
        with pytest.raises(SqlError, match="no rows"):
            base.execute("UPDATE base SET value = 'y' WHERE id = 5")
    base.execute("CREATE TABLE m (id int, amount decimal(6,2), PRIMARY KEY (id))")
    base.execute("INSERT INTO m VALUES (1, 10.5)")
    base.execute("UPDATE m SET amount = amount + 2.5 WHERE id = 1")
    assert rows(base, "SELECT amount FROM m") == [[13.0]]
    base.execute("UPDATE m SET id = id + 1.9")
    assert rows(base, "SELECT id FROM m") == [[2]]


def test_delete(base):
    counts = [base.execute(f"DELETE FROM base{w}").update_count for w in (" WHERE id > 103", " WHERE id > 103", "")]
    assert counts == ([1, 1, 1] if base.mode == "compat" else [2, 0, 2])  # compat counts a statement as one
    assert rows(base, "SELECT * FROM base") == []


def test_literals(db):
    db.execute("CREATE TABLE t (i int, d double precision, s varchar(3))")
    db.execute("INSERT INTO t VALUES (3.7, '2.5', 12.50), (-3.7, 0, 'long text')")
    assert sorted(rows(db, "SELECT * FROM t")) == [[-3, 0.0, "long text"], [3, 2.5, "12.50"]]
    if db.mode == "compat":
        assert rows(db, "SELECT i FROM t WHERE i = 3.7") == [[3]]
    for bad in ("'x', 1, 'a'", "true, 1, 'a'", "3000000000, 1, 'a'"):
        with pytest.raises(SqlError):
            db.execute(f"INSERT INTO t VALUES ({bad})")


@pytest.mark.parametrize("sql", ["SELECT a FROM t WHERE a = 1 OR b = 2", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT AVG(a) FROM t", "SELECT a, COUNT(*) FROM t", "SELECT SUM(DISTINCT a) FROM t", "SELECT a FROM t WHERE a IN (1, 2)", "SELECT a FROM t LIMIT -1", "ALTER TABLE t ADD b int", "CREATE TABLE u (a bigint)", "SELECT a FROM t JOIN u ON a = b", "SELECT COUNT(*) FROM t ORDER BY a", "UPDATE t SET a = b + 1", "SELECT 1"])
def test_rejected(db, sql):
    db.execute("CREATE TABLE t (a int, b int)")
    with pytest.raises(SqlError) as e:
        db.execute(sql)
    assert e.value.sqlstate == "0A000"


def test_distinct_groups_and_offset(db):
    """Compat mode does not have them; standard mode does."""
    db.execute("CREATE TABLE t (a int, b int, v varchar(9))")
    db.execute("INSERT INTO t VALUES (1, 10, 'x'), (1, 20, 'y'), (2, 30, 'x'), (NULL, 40, 'x'), (2, 30, 'x')")
    known = {
        "SELECT DISTINCT a FROM t ORDER BY a": [[None], [1], [2]],
        "SELECT DISTINCT a, b AS c FROM t ORDER BY b DESC LIMIT 2 OFFSET 1": [[2, 30], [1, 20]],
        "SELECT a, COUNT(*) AS n, SUM(b) FROM t GROUP BY a ORDER BY a DESC": [[2, 2, 60], [1, 2, 30], [None, 1, 40]],
        "SELECT SUM(b) AS total, v FROM t WHERE b > 10 GROUP BY v, a ORDER BY a, v": [[40, "x"], [20, "y"], [60, "x"]],
        "SELECT a FROM t GROUP BY a ORDER BY a LIMIT 1 OFFSET 1": [[1]],
        "SELECT b FROM t ORDER BY b OFFSET 3": [[30], [40]],
    }
    for sql, want in known.items():
        if db.mode == "compat":
            with pytest.raises(SqlError) as e:
                db.execute(sql)
            assert e.value.sqlstate == "0A000"
        else:
            assert rows(db, sql) == want
    for sql in ("SELECT a, b FROM t GROUP BY a", "SELECT * FROM t GROUP BY a", "SELECT DISTINCT a FROM t ORDER BY b", "SELECT a FROM t GROUP BY a ORDER BY b", "SELECT DISTINCT COUNT(*) FROM t", "SELECT a FROM t GROUP BY a HAVING a > 1"):
        with pytest.raises(SqlError):
            db.execute(sql)


def test_ddl(db):
    db.execute("DROP TABLE IF EXISTS nothing CASCADE")
    db.execute("CREATE TABLE t (a int, b varchar(2))")
    with pytest.raises(SqlError, match="exists"):
        db.execute("CREATE TABLE t (a int)")
    db.execute("INSERT INTO t VALUES (1, 'x'), (1, 'y')")
    with pytest.raises(SqlError, match="duplicate"):
        db.execute("CREATE INDEX i ON t (a)")
    db.execute("CREATE INDEX i ON t (a, b)")
    db.execute("CREATE INDEX j ON t (a)")  # a table has one key
    assert db.catalog.get("t").key == ["a", "b"] and db.catalog.names() == ["t"]
    db.execute("DROP TABLE t")
    assert not db.catalog.exists("t")


def test_random_against_a_dict(spark, tmp_path):
    db, rnd, want = Session(spark, f"file://{tmp_path}/r"), random.Random(0xC0FFEE), {}
    db.execute("CREATE TABLE t (k int, v int, PRIMARY KEY (k))")
    for _ in range(6):
        new = {rnd.randrange(60): rnd.randrange(9) for _ in range(8)}
        new = {k: v for k, v in new.items() if k not in want}
        if new:
            db.execute_batch("INSERT INTO t VALUES (?, ?)", [[k, v] for k, v in new.items()])
            want |= new
        lo = rnd.randrange(60)
        db.execute("UPDATE t SET v = v - 3 WHERE k >= ? AND k < ?", [lo, lo + 10])
        want = {k: v - 3 * (lo <= k < lo + 10) for k, v in want.items()}
        cut = rnd.randrange(9)
        db.execute("DELETE FROM t WHERE v > ? AND 30 < k", [cut])
        want = {k: v for k, v in want.items() if not (v > cut and k > 30)}
    assert sorted(map(tuple, rows(db, "SELECT k, v FROM t"))) == sorted(want.items())


def test_order_processing(spark, tmp_path):
    db = Session(spark, f"file://{tmp_path}/o", "compat")
    tpcc.create(db)
    tpcc.sample(db)
    answers = [db.execute(sql, params) for sql, params in tpcc.TRANSACTIONS]
    assert len(answers) == 22 and all(r.df is not None or r.update_count == 1 for r in answers)
    # each query's answer as of its turn: later statements never change a snapshot that was read
    assert [r.rows() for r in answers if r.df is not None] == [
        [["w", 0.1]], [["Ann", 1]], [[1]], [[1, None, "2026-01-02 00:00:00"]], [[1, 47.5]], [[2, 0.05]],
        [[9.5, "thing", "data"]], [[20, "data", "dist1", "dist10"]], [[1]], [[47.5]],
    ]
    known = {
        "SELECT w_ytd FROM warehouse": [[300010.5]],
        "SELECT d_ytd, d_next_o_id FROM district": [[30010.5, 3]],
        "SELECT c_balance, c_ytd_payment, c_payment_cnt, c_delivery_cnt, c_middle FROM customer": [[27.0, 20.5, 2, 1, "OE"]],
        "SELECT h_amount, h_data FROM history": [[10.5, "it's"]],
        "SELECT o_id, o_carrier_id FROM oorder ORDER BY o_id": [[1, 3], [2, None]],
        "SELECT no_o_id FROM new_order": [[2]],
        "SELECT s_quantity, s_ytd, s_order_cnt, s_remote_cnt FROM stock": [[15, 5.0, 1, 0]],
        "SELECT ol_delivery_d, ol_dist_info FROM order_line": [["2026-01-05 00:00:00", "dist1"]],
    }
    assert {sql: rows(db, sql) for sql in known} == known and len(db.catalog.get("customer").columns) == 21
    assert rows(db, tpcc.STOCK_LEVEL, [1, 1, 1, 21, 1, 100]) == [[1]]
    assert db.timings()


def test_server(spark, tmp_path):
    srv = server.serve(Session(spark, f"file://{tmp_path}/s"))
    with socket.create_connection(srv.server_address) as s:
        stream = s.makefile("rwb")

        def ask(**request):
            stream.write(server.frame(request))
            stream.flush()
            return server.read_frame(stream)

        assert ask(operation="execute", sql="CREATE TABLE t (id int, value varchar(5), PRIMARY KEY (id))") == {"ok": True, "updateCount": 0}
        assert ask(operation="batchUpdate", sql="INSERT INTO t VALUES (?, ?)", parameterSets=[[1, "a"], [2, "b"], [3, "c"]]) == {"ok": True, "updateCounts": [1, 1, 1]}
        assert ask(operation="execute", sql="SELECT value FROM t WHERE id = ?", parameters=[2]) == {"ok": True, "columns": ["value"], "rows": [["b"]]}
        assert ask(operation="batchUpdate", sql="DELETE FROM t", parameterSets=[[]])["sqlState"] == "22023"
        assert ask(operation="execute", sql="GRANT x")["sqlState"] == "0A000"
        assert ask(operation="execute", sql="SELECT version()")["ok"] and json.dumps(ask(operation="execute", sql="SHOW ALL"))
    srv.shutdown()


def test_explain_and_profile_change_nothing(base):
    for sql in ("DELETE FROM base WHERE id > 101", "UPDATE base SET value = 'x' WHERE id = 101", "INSERT INTO base VALUES (1, 'a')", "DROP TABLE base"):
        base.explain(sql)
        base.profile(sql)
    assert "id" in base.explain("DELETE FROM base WHERE id > 101")
    assert [r[0] for r in rows(base, "SELECT id FROM base ORDER BY id")] == [101, 103, 104, 107]
    counted = base.profile("SELECT value FROM base WHERE id > 103")
    assert any(n == 2 for _, _, n in counted) and counted[0][0] == 0


def test_two_writers(spark, tmp_path):
    """Both start from one version: the first commits, the other is told, and nothing of it stays."""
    one, two = (Catalog(spark, f"file://{tmp_path}/w") for _ in range(2))
    Session(spark, f"file://{tmp_path}/w").execute("CREATE TABLE t (k int, v int, PRIMARY KEY (k))")
    late = two.get("t")
    two.get = lambda name: late
    row = lambda k: spark.createDataFrame([(k, 0)], "k int, v int")
    assert one.append("t", row(1), 1) == 1
    with pytest.raises(SqlError, match="changed meanwhile"):
        two.append("t", row(1), 1)
    assert one.read("t").collect() == [(1, 0)] and len(list((tmp_path / "w/t/data").iterdir())) == 1


def test_reads_by_key_open_one_file_of_many(spark, tmp_path):
    db = Session(spark, f"file://{tmp_path}/k")
    db.execute("CREATE TABLE t (a int, b int, v varchar(9), PRIMARY KEY (a, b))")
    for i in range(6):
        db.execute_batch("INSERT INTO t VALUES (?, ?, ?)", [[10 * i + k, 1, f"v{k}"] for k in range(10)])
    every = len(db.catalog.files(db.catalog.get("t")))
    used = lambda sql, p=None: len(db.execute(sql, p).df.inputFiles())
    assert every == 6 and used("SELECT v FROM t") == 6
    assert used("SELECT v FROM t WHERE a = ?", [25]) == 1 and rows(db, "SELECT v FROM t WHERE a = 25 AND b = 1") == [["v5"]]
    assert used("SELECT v FROM t WHERE 40 <= a") == 2 and used("SELECT v FROM t WHERE t.a < 11 AND a > 3") == 2
    assert rows(db, "SELECT v FROM t WHERE a = 99") == []
    with pytest.raises(SqlError, match="duplicate"):
        db.execute("INSERT INTO t VALUES (25, 1, 'x')")
    db.execute("INSERT INTO t VALUES (25, 2, 'y')")
    before = {f.path for f in db.catalog.files(db.catalog.get("t"))}
    db.execute("UPDATE t SET v = 'new' WHERE a >= 50")
    after = {f.path for f in db.catalog.files(db.catalog.get("t"))}
    assert len(before - after) == 1 and rows(db, "SELECT COUNT(*) FROM t WHERE v = 'new'") == [[10]]
    db.catalog.compact("t")
    assert len(db.catalog.files(db.catalog.get("t"))) == 1 and rows(db, "SELECT COUNT(*), SUM(a) FROM t") == [[61, sum(range(60)) + 25]]
    assert db.catalog.vacuum("t") == 0 and db.catalog.vacuum("t", older_than=-60) > 8
    assert rows(db, "SELECT COUNT(*) FROM t") == [[61]] and db.catalog.vacuum("t", older_than=-60) == 0
    assert len(db.catalog.get("t").manifests) == 1


def test_many_statements_merge_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MANIFESTS", 3)
    db = Session(spark, f"file://{tmp_path}/m")
    db.execute("CREATE TABLE t (a int)")
    for i in range(8):
        db.execute("INSERT INTO t VALUES (?)", [i])
    assert len(db.catalog.get("t").manifests) <= 3 and rows(db, "SELECT SUM(a) FROM t") == [[28]]


def test_failed_statements_leave_no_files(base, tmp_path):
    count = lambda: len(list((tmp_path / "db/base/data").iterdir()))
    was = count()
    with pytest.raises(SqlError, match="duplicate"):
        base.execute("UPDATE base SET id = 103 WHERE id = 101")
    assert count() == was and sorted(r[0] for r in rows(base, "SELECT id FROM base")) == [101, 103, 104, 107]


def test_metadata(base):
    assert base.metadata("tables") == [{"table": "base", "type": "TABLE"}]
    assert [(r["column"], r["type"], r["position"]) for r in base.metadata("columns", "base")] == [("id", "int", 1), ("value", "string", 2)]
    assert [r["column"] for r in base.metadata("indexes", "base")] == ["id"] and base.metadata("importedkeys") == []
    assert server.answer(base, {"operation": "metadata", "of": "tables"})["rows"] == base.metadata("tables")


def test_arithmetic_on_null_and_wrapping_sums(db):
    db.execute("CREATE TABLE t (a int, x int)")
    db.execute("INSERT INTO t VALUES (1, NULL), (2, 2147483647), (3, 1)")
    if db.mode == "compat":
        with pytest.raises(Exception, match="null"):
            db.execute("UPDATE t SET x = x + 1 WHERE a = 1")
        assert rows(db, "SELECT SUM(x) FROM t") == [[-2147483648]]
    else:
        db.execute("UPDATE t SET x = x + 1 WHERE a = 1")
        assert rows(db, "SELECT x FROM t WHERE a = 1") == [[None]] and rows(db, "SELECT SUM(x) FROM t") == [[2147483648]]
    with pytest.raises(SqlError):
        db.execute("SELECT a FROM t WHERE x IS DISTINCT FROM 1")


def test_stream(spark, tmp_path):
    from tessera.streaming import events

    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").symlink_to(src)
    q = events.windowed_counts(events.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == spark.read.parquet(src).count()
