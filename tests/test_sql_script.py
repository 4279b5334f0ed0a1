import pytest

from cadenza.plans import registry
from cadenza.sources import sql_script

from conftest import SF001


def test_statements_and_marks():
    script = """
    -- a comment; with 'quotes
    /* and ; another %(x)s */ SELECT 'a;b', ';''%(q)s', "c;d", `e;f` FROM t WHERE x = %(q)s AND y = %s;;
    INSERT INTO p VALUES ($1, $2, '$3'); SELECT 10 %% 3, $$it's; raw$$, $x$ $$ ; $x$
    """
    got = sql_script.statements(script)
    assert got == ["SELECT 'a;b', ';''%(q)s', \"c;d\", `e;f` FROM t WHERE x = :q AND y = ?",
                   "INSERT INTO p VALUES (:p1, :p2, '$3')", "SELECT 10 % 3, 'it''s; raw', ' $$ ; '"]
    assert sql_script.statements(" ; -- nothing\n") == [] and sql_script.statements("") == []
    assert sql_script.statements("/* open ; comment") == []


def test_script_file(spark, tmp_path):
    path = tmp_path / "s.sql"
    path.write_text("CREATE EXTENSION IF NOT EXISTS pg_trgm;\nCREATE INDEX i ON t USING gin (name gin_trgm_ops);\n"
                    "CREATE OR REPLACE TEMPORARY VIEW sv AS SELECT 'red' AS name, 1 AS id;\n"
                    "SELECT id, similarity(name, %(q)s) AS s, %(q)s AS asked FROM sv -- end")
    script = sql_script.read_script(spark, str(path))
    assert len(script) == 4
    evil = "x'; DROP VIEW sv; --"
    assert sql_script.run_script(spark, script, {"q": "red"}).first()["s"] == 1.0
    assert sql_script.run_script(spark, script, {"q": evil}).first()["asked"] == evil
    assert sql_script.run_script(spark, sql_script.statements("SELECT $2 AS b, $1 AS a"), [1, 2]).first().asDict() == {"b": 2, "a": 1}
    assert sql_script.run_script(spark, sql_script.statements("SELECT %s AS a, '?' AS b"), [5]).first()["a"] == 5
    with pytest.raises(Exception):
        sql_script.run_script(spark, sql_script.statements("SELECT %(missing)s AS a"), {"q": 1}).collect()


def test_sets_and_scores_are_computed_once(spark):
    registry.load_all()
    df = registry.QUERIES["param_sql"](spark, SF001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 4 and plan.count("array_intersect") == 2
