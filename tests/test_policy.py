"""SQL text rules, globs, and decisions."""

from __future__ import annotations

import fnmatch
import random
import re

import pytest
from conftest import DATA, plan
from pyspark.sql import functions as F

from sparkward.functions.globs import glob_to_regex, matches_any
from sparkward.functions.sqltext import FORBIDDEN_WORDS, clean_sql, table_references
from sparkward.functions.text import quoted
from sparkward.operators import policy
from sparkward.operators.policy import Policy, PolicyDenied
from sparkward.plans.derived import query_log

POLICY = Policy(
    tables=["proj.sales.*"], buckets=["allowed-bucket"], dags=["ingest_*"],
    max_bytes=1_000_000, max_rows=100,
)


def log_of(spark, statements, tables=None, scanned=0):
    rows = [(i, "agent-1", s, tables, scanned) for i, s in enumerate(statements)]
    return spark.createDataFrame(
        rows,
        "request_id LONG, actor STRING, sql STRING, referenced_tables ARRAY<STRING>, "
        "estimated_bytes LONG",
    )


def classified(spark, statements, mode="strict"):
    out = policy.classify_sql(log_of(spark, statements), mode=mode)
    return {r["sql"]: (r["read_only"], r["sql_reason"]) for r in out.collect()}


READ_ONLY = [
    "SELECT region, sum(amount) FROM shop.gold.orders GROUP BY region",
    "with spans as (select 1 as lo), more as (select 2) select * from spans, more",
    "SELECT 2 + 3 AS five -- CREATE nothing\n",
    "/*\n * MERGE is only named here\n */\nSELECT now()",
    "SELECT 'GRANT me a string' , \"and ALTER another\" FROM notes",
    'SELECT "it\'\'s; DROP" AS note',
    "SELECT 1;",
    "SELECT 1;;;",
    "  \x1c SELECT 1 　",
    "SELECT inserted, updates, dropx FROM t",
    "SELECT 'a\\'; DROP TABLE t' FROM t",
    "SELECT * FROM `a--b`",
]


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_read_only_statements(spark, mode):
    assert set(classified(spark, READ_ONLY, mode).values()) == {(True, "Statement is read-only")}


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_writing_statements(spark, mode):
    statements = {f"{word.lower()} gold.orders now": word for word in FORBIDDEN_WORDS}
    statements |= {"explain select 1": "EXPLAIN", "(values (1)) show": "VALUES"}
    found = classified(spark, list(statements), mode)
    for sql, word in statements.items():
        assert found[sql] == (
            False, f"Statement must start with SELECT or WITH, found '{word}'"
        )


def test_forbidden_words_anywhere(spark):
    statements = {f"SELECT 1 FROM t WHERE {w.lower()} = 1": w for w in FORBIDDEN_WORDS}
    found = classified(spark, list(statements))
    for sql, word in statements.items():
        assert found[sql] == (False, f"Forbidden keyword(s) present: ['{word}']")
    several = "WITH x AS (SELECT 1) MERGE, drop, DELETE, drop"
    assert classified(spark, [several])[several][1] == (
        "Forbidden keyword(s) present: ['DELETE', 'DROP', 'MERGE']"
    )


def test_order_of_reasons(spark):
    found = classified(
        spark, ["", " \n\t", "-- only a remark", "123", "'text'", "(1); SELECT", "SELECT 1; SELECT 2",
                "SELECT 1; ;", "SELECT 1; DELETE FROM t"],
    )
    assert {sql: reason for sql, (_, reason) in found.items()} == {
        "": "Empty query",
        " \n\t": "Empty query",
        "-- only a remark": "Empty query",
        "123": "No SQL tokens found",
        "'text'": "No SQL tokens found",
        "(1); SELECT": "Multiple statements are not permitted",
        "SELECT 1; SELECT 2": "Multiple statements are not permitted",
        "SELECT 1; ;": "Multiple statements are not permitted",
        "SELECT 1; DELETE FROM t": "Forbidden keyword(s) present: ['DELETE']",
    }


def test_a_comment_mark_in_a_string_hides_nothing(spark):
    sql = "SELECT '--'; DROP TABLE t"
    assert classified(spark, [sql])[sql] == (False, "Forbidden keyword(s) present: ['DROP']")
    assert classified(spark, [sql], "compat")[sql][0] is True
    quoted_name = "SELECT * FROM `a--b`; DROP TABLE t"
    assert classified(spark, [quoted_name])[quoted_name][0] is False
    with pytest.raises(ValueError, match="Unknown mode"):
        clean_sql(F.col("sql"), "other")


def test_null_statement_is_empty(spark):
    row = policy.decide(log_of(spark, [None]), POLICY).first()
    assert (row["allowed"], row["reason"]) == (False, "Empty query")


def test_long_literals_need_no_deep_stack(spark):
    long = "x\\'" * 200_000
    sql = f"SELECT '{long}' AS a, \"{long}\" AS b, `{'n' * 100_000}` FROM t /*{'*' * 200_000}*/"
    for mode in ("strict", "compat"):
        assert list(classified(spark, [sql], mode).values()) == [(True, "Statement is read-only")]


def test_compat_rules_by_hand(spark):
    # What each step leaves: block comments first, then line comments, then strings.
    expected = {
        "WITH a AS (SELECT '/*' AS x) SELECT '*/; drop' FROM a": (True, "Statement is read-only"),
        "SELECT 'open /* drop' , 'shut */' FROM t": (True, "Statement is read-only"),
        "SELECT '--' ; UPDATE t": (True, "Statement is read-only"),
        "SELECT a --\n; SELECT b": (False, "Multiple statements are not permitted"),
        "/* SELECT */ 7": (False, "No SQL tokens found"),
        "/* open SELECT 1": (False, "Statement must start with SELECT or WITH, found 'OPEN'"),
        "SELECT \"drop\" , 'merge' FROM t": (True, "Statement is read-only"),
        "SELECT 'it''s' , drop_me FROM t": (True, "Statement is read-only"),
        "SELECT `grant` FROM t": (False, "Forbidden keyword(s) present: ['GRANT']"),
    }
    assert classified(spark, list(expected), "compat") == expected


@pytest.mark.parametrize(
    ("sql", "names"),
    [
        ("SELECT * FROM `p.d.t` JOIN p.d.u ON 1=1", ["p.d.t", "p.d.u"]),
        ("select 1 from\n\t a-b.c.d join a-b.c.d join x", ["a-b.c.d", "x"]),
        ("SELECT EXTRACT(YEAR FROM ts) FROM t", ["ts", "t"]),
        ("SELECT * FROM a, b", ["a"]),
        ("SELECT * FROM `p`.`d`.`t`", ["p"]),
        ("SELECT 'from x' -- join y", ["x", "y"]),
        ("SELECT 1", []),
        ("SELECT * FROM (SELECT 1)", []),
        ("SELECT a FROM t", ["t"]),
    ],
)
def test_table_references(spark, sql, names):
    assert log_of(spark, [sql]).select(table_references(F.col("sql"))).first()[0] == names


# --- globs ------------------------------------------------------------------


def matches(spark, values, patterns):
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    return [r[0] for r in df.select(matches_any(F.col("v"), patterns)).collect()]


def test_glob_cases(spark):
    values = ["proj.sales.orders", "proj.sales.a.b", "proj.hr.salaries", "PROJ.sales.orders", None]
    assert matches(spark, values, ["proj.sales.orders"]) == [True, False, False, False, False]
    assert matches(spark, values, ["proj.sales.*"]) == [True, True, False, False, False]
    assert matches(spark, values, ["x", "*.hr.*"]) == [False, False, True, False, False]
    assert matches(spark, values, ["abc?", "abc*", "proj*"]) == [True, True, True, False, False]
    assert matches(spark, values, []) == [False] * 5
    assert matches(spark, ["a\n", "a", "a\nb"], ["a", "a?b"]) == [False, True, True]


def test_globs_agree_with_fnmatch(spark):
    alphabet = "ab-.]![^*?\\&~|#$("
    draw = random.Random(11)

    def text(letters, longest):
        return "".join(draw.choices(letters, k=draw.randint(0, longest)))

    fixed = ["[]", "[!]", "[]a]", "[!]a]", "[a-", "[z-a]", "[!z-a]", "[--a]", "[a--b]", "[a-c-e]",
             "[^a]", "**a**", "*a*b*", "[a&&b]", "[a||b]", "[[a]", "", "*", "?", "[!a-b]*", "a[*]b"]
    patterns = sorted({*fixed, *(text(alphabet, 7) for _ in range(250))})
    values = sorted({text("ab-.]![^\\&~|*", 5) for _ in range(200)} | {"a\nb", "c", "d", "e"})
    df = spark.createDataFrame([(v,) for v in values], "v STRING").coalesce(1)
    for start in range(0, len(patterns), 60):
        some = patterns[start : start + 60]
        found = df.select("v", *[matches_any(F.col("v"), [p]) for p in some]).collect()
        wrong = [
            (p, row[0])
            for row in found
            for p, got in zip(some, list(row)[1:])
            if got != fnmatch.fnmatchcase(row[0], p)
        ]
        assert not wrong


def test_many_stars_stay_cheap(spark):
    pattern = "*a" * 30 + "b"
    assert matches(spark, ["a" * 5000], [pattern]) == [False]
    assert glob_to_regex("a*b").startswith("(?s)")


def test_allow_list_as_a_table(spark):
    names = spark.createDataFrame([("p.a",), ("p.b",), ("q.c",), ("r.d",)], "table_name STRING")
    patterns = spark.createDataFrame([("p.a",), ("q.*",), ("q.?",), ("p.a",)], "pattern STRING")
    report = policy.allow_list_report(names, patterns)
    assert {r[0]: r[1] for r in report.collect()} == {
        "p.a": True, "p.b": False, "q.c": True, "r.d": False,
    }
    none = policy.allow_list_report(names, patterns.where("false"))
    assert not any(r["allowed"] for r in none.collect())
    assert "NestedLoop" not in plan(report) and "Cartesian" not in plan(report)


def test_allow_lists_of_any_size(spark):
    names = spark.range(300).selectExpr("concat('p.t', id, '.x') AS table_name")
    odd = [("",), (None,), ("p.t7.x",), ("zz",), ("a]b",)]
    names = names.union(spark.createDataFrame(odd, "table_name STRING"))
    patterns = spark.range(3000).selectExpr(
        "CASE id % 3 WHEN 0 THEN concat('p.t', id, '.?') WHEN 1 THEN concat('*.t', id, '.x') "
        "ELSE concat('q', id, '*') END AS pattern"
    )
    more = spark.createDataFrame([("z[a-z]",), ("[b-c]*",), (None,), ("*]b",)], "pattern STRING")
    report = policy.allow_list_report(names, patterns.union(more))
    assert report.count() == 305
    allowed = sorted(r["table_name"] for r in report.where("allowed").collect())
    expected = [f"p.t{i}.x" for i in range(300) if i % 3 < 2] + ["p.t7.x", "zz", "a]b"]
    assert allowed == sorted(expected)
    assert "NestedLoop" not in plan(report) and "Cartesian" not in plan(report)


@pytest.mark.parametrize("few_pieces", [0, 100_000])
def test_allow_lists_equal_one_entry_at_a_time(spark, few_pieces):
    draw = random.Random(11)
    signs = "aab.-]!"
    texts = sorted({"".join(draw.choices(signs, k=draw.randrange(9))) for _ in range(150)})
    bits = [*signs, "*", "*", "?", "[ab]", "[!a]", "[a-b", "[]", "[]a]", "[!]b]", "ab.-ab"]
    entries = sorted({"".join(draw.choices(bits, k=draw.randrange(1, 6))) for _ in range(150)} - {"*", "?*"})
    names = spark.createDataFrame([(t,) for t in [*texts, "x\ny", "\U0001f600", None]], "table_name STRING")
    for part in (entries[::4], entries[1::4], ["??", "???*"], ["*"]):
        patterns = spark.createDataFrame([(p,) for p in part], "pattern STRING")
        got = policy.allow_list_report(names, patterns, few_entries=0, names_per_task=7, few_pieces=few_pieces)
        expected = names.select("table_name", matches_any(F.col("table_name"), part).alias("allowed"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


@pytest.mark.parametrize("piece", ["concat('*.c', id, '.*')", "concat('shop.c', id, '.o[0-3]')"])
def test_entries_of_a_long_list_are_not_broadcast(spark, piece):
    # Spark would, by the size of their few kB of files.
    names = spark.range(300).selectExpr("concat('shop.c', id, '.o', id % 7) AS table_name")
    patterns = spark.range(60).selectExpr(f"{piece} AS pattern")
    report = policy.allow_list_report(names, patterns, few_pieces=0)
    joins = re.findall(r"\) (\w+Join).*\nLeft keys \[\d\]: \[.*part#", plan(report))
    assert joins == ["SortMergeJoin"]
    assert report.where("allowed").count() == (60 if piece.startswith("concat('*") else 36)


@pytest.mark.parametrize("few_entries", [0, 100])
def test_the_names_on_the_list_are_not_broadcast(spark, few_entries):
    # Spark would once the job runs and the list is below its 10 MB.
    names = spark.range(300).selectExpr("concat('shop.c', id, '.o', id % 7) AS table_name")
    patterns = spark.range(90).selectExpr(
        "concat('shop.c', id, CASE id % 3 WHEN 0 THEN '.o[0-3]' ELSE '.o5' END) AS pattern"
    )
    report = policy.allow_list_report(names, patterns, few_entries=few_entries)
    allowed = [i for i in range(90) if (i % 7 <= 3 if i % 3 == 0 else i % 7 == 5)]
    rows = report.collect()
    assert len(rows) == 300
    assert sorted(r["table_name"] for r in rows if r["allowed"]) == sorted(f"shop.c{i}.o{i % 7}" for i in allowed)
    joins = re.findall(r"\) (\w+Join).*\nLeft keys \[1\]: \[table_name#", plan(report))
    assert set(joins) == {"SortMergeJoin"}


def test_inner_literals_are_looked_up(spark):
    # 2,000 names and 500 entries without a literal beginning or end: one name is tested per entry.
    names = spark.range(2000).selectExpr("concat('shop.c', id, '.o', id % 7) AS table_name")
    patterns = spark.range(500).selectExpr("concat('*.c', id * 5, '.*') AS pattern")
    report = policy.allow_list_report(names, patterns)
    assert report.where("allowed").count() == 400
    text = plan(report)
    assert "NestedLoop" not in text and "Cartesian" not in text


# --- decisions --------------------------------------------------------------


def authorized(spark, sql, tables, scanned=0, rules=POLICY):
    row = policy.authorize(log_of(spark, [sql], tables, scanned), rules).first()
    return row["allowed"], row["decision"], row["reason"]


def test_authorize_in_order(spark):
    sales, hr = "proj.sales.orders", "proj.hr.salaries"
    assert authorized(spark, "SELECT 1 FROM x", [sales], 1_000_000) == (
        True, "allowed", "Query passed all guardrails",
    )
    assert authorized(spark, "SELECT 1 FROM x", [sales], 1_000_001)[2] == (
        "Estimated 1000001 bytes exceeds ceiling of 1000000"
    )
    assert authorized(spark, "SELECT 1 FROM x", [sales, hr, "z"], 9_999_999)[2] == (
        "Table 'proj.hr.salaries' is not in the allow-list"
    )
    for tables in ([], None):
        assert authorized(spark, "SELECT 1", tables, 9_999_999)[2] == (
            "Query does not reference any resolvable table"
        )
    assert authorized(spark, "DROP TABLE t", [], 0)[2].startswith("Statement must start")
    assert authorized(spark, "SELECT 1", [sales], None)[:2] == (False, "denied")
    assert authorized(spark, "SELECT 1", [None], 0)[0] is False
    assert authorized(spark, "SELECT 1", ["it's"], 0)[2] == (
        "Table \"it's\" is not in the allow-list"
    )
    writing = Policy(tables=["*"], read_only=False)
    assert authorized(spark, "DROP TABLE t", ["t"], 0, writing)[0] is True


def preflighted(spark, sql, rules=POLICY):
    return policy.preflight(log_of(spark, [sql]), rules).first()["preflight_reason"]


def test_preflight_denies_or_defers(spark):
    assert preflighted(spark, "SELECT * FROM `proj.sales.orders`") is None
    assert preflighted(spark, "SELECT 1") is None
    assert preflighted(spark, "DELETE FROM proj.sales.orders").startswith("Statement must start")
    assert preflighted(spark, "SELECT 1 FROM proj.hr.a JOIN proj.sales.b JOIN c") == (
        "Table(s) ['proj.hr.a', 'c'] are not in the allow-list (preflight check)"
    )
    assert preflighted(spark, "SELECT * FROM t", Policy()) == (
        "Table(s) ['t'] are not in the allow-list (preflight check)"
    )


def test_two_phases_give_one_decision(spark):
    decided = policy.decide(
        log_of(spark, ["SELECT 1", "DROP TABLE t", "SELECT * FROM x"]), POLICY
    )
    rows = {r["sql"]: r for r in decided.collect()}
    assert len(rows) == 3
    assert rows["SELECT 1"]["phase"] == "authorize" and not rows["SELECT 1"]["allowed"]
    assert rows["DROP TABLE t"]["phase"] == "preflight"
    assert rows["DROP TABLE t"]["candidate_tables"] is None
    assert rows["SELECT * FROM x"]["candidate_tables"] == ["x"]


def test_decisions_need_no_shuffle_and_no_python(spark):
    text = plan(policy.decide(query_log(spark, DATA), POLICY))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_ceilings_must_be_positive():
    with pytest.raises(ValueError, match="max_bytes must be positive"):
        Policy(max_bytes=0)
    with pytest.raises(ValueError, match="max_rows must be positive"):
        Policy(max_rows=-1)
    assert (Policy().max_bytes, Policy().max_rows, Policy().read_only) == (
        10_000_000_000, 10_000, True,
    )


def test_bucket_and_dag_access(spark):
    buckets = spark.createDataFrame([("allowed-bucket",), ("other",), (None,)], "bucket STRING")
    assert [(r["allowed"], r["reason"]) for r in policy.decide_buckets(buckets, POLICY).collect()] == [
        (True, "Bucket is allow-listed"),
        (False, "Bucket 'other' is not in the allow-list"),
        (False, "Bucket '' is not in the allow-list"),
    ]
    dags = spark.createDataFrame([("ingest_daily",), ("drop_all",)], "dag_id STRING")
    assert [(r["decision"], r["reason"]) for r in policy.decide_dags(dags, POLICY).collect()] == [
        ("allowed", "DAG is allow-listed"),
        ("denied", "DAG 'drop_all' is not in the allow-list"),
    ]


def test_require_and_split(spark):
    decided = policy.decide_buckets(
        spark.createDataFrame([("allowed-bucket",), ("other",)], "bucket STRING"), POLICY
    )
    allowed, denied = policy.split_decisions(decided)
    assert (allowed.count(), denied.count()) == (1, 1)
    policy.require_allowed(allowed)
    with pytest.raises(PolicyDenied, match="'other' is not in the allow-list"):
        policy.require_allowed(denied)
    with pytest.raises(PolicyDenied):
        policy.require_allowed(denied.where("false"))


def test_quoting_follows_the_value(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    assert [r[0] for r in df.select(quoted(F.col("v"))).collect()] == [repr(v) for v in values]
