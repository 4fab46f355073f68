"""Strict statements: what is a query over the allowed relations and what is not."""

import pytest

from txnlens.plans import governed

MANY = ", ".join(f"id + {i} AS c{i}" for i in range(40))

GOOD = [
    "SELECT 'CTE [secret_rows]' AS x, 'we reflect on java_method(this)' AS y FROM allowed_rows",
    "SELECT 'UnresolvedRelation [secret_rows]' AS x",
    f"SELECT {MANY} FROM allowed_rows",
    "WITH a AS (SELECT id FROM allowed_rows), b AS (SELECT id FROM a) SELECT * FROM b JOIN a USING (id)",
    # A common table hides a relation where it can be seen.
    "WITH secret_rows AS (SELECT 1 AS id) SELECT * FROM secret_rows",
    "WITH a AS (WITH secret_rows AS (SELECT 2 AS id) SELECT * FROM secret_rows) SELECT * FROM a",
    "WITH a AS (SELECT 1 AS id) SELECT (WITH a AS (SELECT 2 AS id) SELECT max(id) FROM a) AS x FROM a",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "SELECT id, SUM(id) OVER w AS s FROM allowed_rows WINDOW w AS (PARTITION BY abs(id) ORDER BY id)",
    "SELECT id, CASE WHEN id > 1 THEN upper('a') ELSE concat('a', 'b') END AS x, CAST(id AS string) || '!' AS y FROM ALLOWED_ROWS WHERE id BETWEEN 0 AND 9 AND NOT id IN (7) OR id IS NULL",
    "SELECT t.id, y FROM allowed_rows t LATERAL VIEW explode(array(1, 2)) v AS y",
    "SELECT * FROM allowed_rows a, LATERAL (SELECT max(b.id) AS m FROM allowed_rows b WHERE b.id <= a.id)",
    "SELECT * FROM (SELECT id, id % 2 AS k FROM allowed_rows) PIVOT (sum(id) FOR k IN (0, 1))",
    "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(n, s) ORDER BY 1 LIMIT 1 OFFSET 1",
    "SELECT COUNT(DISTINCT id) FILTER (WHERE id > 0) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY id) AS p FROM allowed_rows HAVING n > 0",
    "SELECT id FROM allowed_rows EXCEPT SELECT 1 UNION ALL (SELECT id FROM allowed_rows INTERSECT SELECT 2)",
    "SELECT k, GROUPING(k) AS g, COUNT(*) AS n FROM (SELECT id % 2 AS k FROM allowed_rows) GROUP BY ROLLUP (k)",
    "SELECT transform(array(id), x -> x + 1) AS x, named_struct('a', id).a AS y, current_date AS d FROM allowed_rows",
]

BAD = {
    "SELECT 'CTE [secret_rows]' AS x, id FROM secret_rows": "relation",
    f"SELECT {MANY}, reflect('java.lang.System', 'getProperty', 'user.home') AS r FROM allowed_rows": "function",
    # Names of common tables do not reach beyond their statement.
    "SELECT * FROM (WITH secret_rows AS (SELECT 1 AS id) SELECT * FROM secret_rows) JOIN secret_rows": "relation",
    "WITH secret_rows AS (SELECT * FROM secret_rows) SELECT * FROM secret_rows": "relation",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS id) SELECT * FROM a": "relation",
    "SELECT (WITH secret_rows AS (SELECT 1 AS id) SELECT max(id) FROM secret_rows) AS x FROM secret_rows": "relation",
    "SELECT * FROM allowed_rows WHERE EXISTS (SELECT 1 FROM secret_rows)": "relation",
    "SELECT * FROM allowed_rows WHERE (id, 1) IN (SELECT id, 1 FROM secret_rows)": "relation",
    "SELECT max(CASE WHEN id > (SELECT min(id) FROM secret_rows) THEN 1 END) AS x FROM allowed_rows": "relation",
    "SELECT * FROM allowed_rows ORDER BY (SELECT max(id) FROM secret_rows)": "relation",
    "SELECT * FROM allowed_rows a, LATERAL (SELECT * FROM secret_rows)": "relation",
    "SELECT * FROM default.allowed_rows": "relation",
    "SELECT * FROM `allowed_rows.secret_rows`": "relation",
    "TABLE secret_rows": "relation",
    "SELECT SUM(id) OVER w AS s FROM allowed_rows WINDOW w AS (PARTITION BY reflect('java.lang.System', 'nanoTime'))": "function",
    "SELECT filter(array(1), x -> try_reflect('java.lang.System', 'nanoTime') = x) AS f FROM allowed_rows": "function",
    "SELECT * FROM allowed_rows LATERAL VIEW java_method('java.lang.System', 'nanoTime') v AS y": "function",
    "SELECT count(*) FILTER (WHERE reflect('java.lang.System', 'nanoTime') = id) AS n FROM allowed_rows": "function",
    "SELECT * FROM VALUES (java_method('java.lang.System', 'nanoTime')) AS t(x)": "function",
    "SELECT input_file_name() AS f FROM allowed_rows": "function",
    "SELECT own_function(id) AS f FROM allowed_rows": "function",
    "SELECT system.builtin.reflect('java.lang.System', 'nanoTime') AS f FROM allowed_rows": "function",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'nanoTime') AS f FROM allowed_rows": "not allowed",
    "SELECT * FROM IDENTIFIER('secret' || '_rows')": "only queries",
    "SELECT '${system:user.home}' AS x": "variables",
    "SELECT * FROM '${env:HOME}'": "variables",
    "SELECT TRANSFORM (id) USING 'cat' FROM allowed_rows": "only queries",
    "SELECT * FROM allowed_rows VERSION AS OF 1": "only queries",
    "SELECT * FROM range(5)": "only queries",
    "FROM allowed_rows |> WHERE id > 1": "not allowed|only queries",
    "EXPLAIN SELECT * FROM allowed_rows": "only queries",
    "DESCRIBE allowed_rows": "only queries",
    "WITH x AS (SELECT 1 AS id) INSERT\nINTO allowed_rows SELECT * FROM x": "only queries",
}


@pytest.fixture(scope="module")
def views(spark):
    spark.range(3).createOrReplaceTempView("allowed_rows")
    spark.range(3).createOrReplaceTempView("secret_rows")
    spark.udf.register("own_function", lambda x: x)
    yield spark
    spark.catalog.dropTempView("secret_rows")


@pytest.mark.parametrize("sql", GOOD)
def test_queries_run(views, sql):
    governed.run_select(views, sql, strict=True, relations=["allowed_rows"]).count()


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(views, sql):
    with pytest.raises(ValueError, match=BAD[sql]):
        governed.run_select(views, sql, strict=True, relations=["allowed_rows"])


def test_replaced_functions_are_refused(views):
    views.udf.register("soundex", lambda x: "mine")
    try:
        with pytest.raises(ValueError, match="function"):
            governed.run_select(views, "SELECT soundex('a') AS x", strict=True, relations=[])
    finally:
        views._jsparkSession.sessionState().catalog().dropTempFunction("soundex", True)


def test_names_follow_the_session(views):
    views.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="relation"):
            governed.run_select(views, "SELECT * FROM Allowed_Rows", strict=True, relations=["allowed_rows"])
        with pytest.raises(ValueError, match="relation"):
            governed.run_select(views, "WITH Secret_Rows AS (SELECT 1 AS id) SELECT * FROM secret_rows", strict=True, relations=["allowed_rows"])
    finally:
        views.conf.set("spark.sql.caseSensitive", "false")
