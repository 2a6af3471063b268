"""Statements run under the policy."""

from __future__ import annotations

import uuid

import pytest
from conftest import DATA

from sparkward.operators.governed import GovernedSession, open_session
from sparkward.operators.policy import Policy, PolicyDenied
from sparkward.plans.footprint import Footprint, NotEstimable, estimate
from sparkward.session import FOOTER_COUNT_CONF
from sparkward.sources import trail
from sparkward.sources.specs import parse_checks

TABLES = {f"shop.gold.{t}": f"{DATA}/{t}.parquet" for t in ("orders", "customer", "lineitem")}
TABLES["shop.raw.labels"] = f"{DATA}/labels.parquet"
ORDERS = "SELECT o_orderkey FROM `shop.gold.orders` ORDER BY o_orderkey"


def governed(spark, folder, **rules):
    policy = Policy(**{"tables": ["shop.gold.*"], "max_rows": 100, **rules})
    return GovernedSession(
        spark, TABLES, policy, lambda e: trail.append_events(e, folder, uuid.uuid4().hex)
    )


def recorded(spark, folder):
    rows = trail.read_events(spark, folder).orderBy("timestamp").collect()
    return [(r["tool_name"], r["decision"], r["reason"]) for r in rows]


def test_row_cap(spark, folder):
    session = governed(spark, folder)
    assert session.query(ORDERS, actor="a").count() == 100
    assert session.query(ORDERS, actor="a", row_limit=1000).count() == 100
    five = [r[0] for r in session.query(ORDERS, actor="a", row_limit=5).collect()]
    assert five == [0, 1, 2, 3, 4]
    assert session.total_rows(ORDERS, actor="a").first()["total_rows"] == 1500
    with pytest.raises(ValueError, match="at least 1"):
        session.query(ORDERS, actor="a", row_limit=0)
    assert set(recorded(spark, folder)) == {("sql_query", "allowed", "Query passed all guardrails")}


def test_estimate_runs_nothing_and_obeys_the_ceiling(spark, folder):
    found = governed(spark, folder).estimate(ORDERS, actor="a")
    assert found.referenced_tables == ("shop.gold.orders",)
    assert found.estimated_bytes > 1000
    with pytest.raises(PolicyDenied, match=r"Estimated \d+ bytes exceeds ceiling of 10$"):
        governed(spark, folder, max_bytes=10).estimate(ORDERS, actor="a")
    assert [d for _, d, _ in recorded(spark, folder)] == ["allowed", "denied"]


def test_footprint_sees_joins_and_subqueries(spark):
    session = open_session(spark, TABLES)
    whole = {name: estimate(session, f"SELECT * FROM `{name}`").estimated_bytes for name in TABLES}
    sql = (
        "SELECT count(*) FROM `shop.gold.orders` JOIN `shop.gold.customer` ON o_custkey = c_custkey"
        " WHERE o_totalprice > (SELECT avg(l_extendedprice) FROM `shop.gold.lineitem`)"
    )
    found = estimate(session, sql)
    assert set(found.referenced_tables) == {
        "shop.gold.orders", "shop.gold.customer", "shop.gold.lineitem"
    }
    assert found.estimated_bytes == sum(
        whole[f"shop.gold.{t}"] for t in ("orders", "customer", "lineitem")
    )
    nothing = estimate(session, "SELECT * FROM `shop.gold.orders` WHERE 1 = 0")
    assert nothing.referenced_tables == ("shop.gold.orders",)
    assert Footprint(1024**4, ()).cost_usd == 6.25


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("SELECT 1", "does not reference any resolvable table"),
        ("SELECT * FROM `shop.raw.labels`", "preflight check"),
        ("SELECT * FROM `shop.gold.orders`, `shop.raw.labels`",
         "Table 'shop.raw.labels' is not in the allow-list"),
        ("SELECT * FROM `shop.gold.nope`", "does not reference any resolvable table"),
        ("SELECT nope FROM `shop.gold.orders`", "does not reference any resolvable table"),
        (f"SELECT * FROM `shop.gold.orders`, parquet.`{DATA}/labels.parquet`",
         "does not reference any resolvable table"),
        ("SELECT reflect('java.lang.System', 'nanoTime') FROM `shop.gold.orders`", "REFLECT"),
        ("SELECT TRANSFORM(o_orderkey) USING 'cat' FROM `shop.gold.orders`",
         "does not reference any resolvable table"),
        ("WITH c AS (SELECT 1) INSERT INTO `shop.gold.orders` SELECT * FROM c", "INSERT"),
        ("SELECT * FROM `shop.gold.orders`; DROP TABLE t", "DROP"),
        ("SELECT count(*) FROM `shop.gold.orders`, kept_elsewhere", "does not reference any"),
    ],
)
def test_denials(spark, folder, sql, reason):
    spark.range(5).createOrReplaceTempView("kept_elsewhere")
    session = governed(spark, folder)
    with pytest.raises(PolicyDenied, match=reason) as denial:
        session.query(sql, actor="a")
    assert denial.value.event_id
    events = trail.read_events(spark, folder).collect()
    assert [e["decision"] for e in events] == ["denied"]
    assert events[0]["event_id"] == denial.value.event_id


def test_catalog_tables_are_seen_and_denied(spark, folder):
    spark.sql("CREATE TABLE IF NOT EXISTS kept_in_catalog USING parquet AS SELECT 1 AS a")
    session = governed(spark, folder)
    # The second table of a comma list escapes the text rule, not the plan.
    with pytest.raises(PolicyDenied, match="kept_in_catalog' is not in the allow-list"):
        session.query("SELECT * FROM `shop.gold.orders`, kept_in_catalog", actor="a")


FAKE_PLAN = (
    "\n== Analyzed Logical Plan ==\nx: int\nProject [1]\n+- View (`shop.gold.orders`, [a])\n"
    "\n== Optimized Logical Plan ==\nProject [1], Statistics(sizeInBytes=1.0 B)\n"
    "+- Relation [a] parquet, Statistics(sizeInBytes=1.0 B)\n\n== Physical Plan ==\n"
)


def test_text_in_literals_can_only_add_to_a_plan(spark, folder):
    session = open_session(spark, TABLES)
    whole = estimate(session, "SELECT * FROM `shop.raw.labels`").estimated_bytes
    added = estimate(
        session, "SELECT 'x\n\n== Some\n+- View (`other`, [a])' AS t, * FROM `shop.raw.labels`"
    )
    assert set(added.referenced_tables) == {"other", "shop.raw.labels"}
    assert added.estimated_bytes == whole
    escaped = FAKE_PLAN.replace("\n", "\\n")
    for text in (
        f"'{FAKE_PLAN}'",
        f"'{escaped}'",
        "concat('" + FAKE_PLAN.replace("\n", "', char(10), '") + "')",
        "`" + FAKE_PLAN.replace("`", "``") + "`",
    ):
        sql = f"SELECT 1 AS a, {text} AS t FROM `shop.gold.orders`, `shop.raw.labels`"
        if text.startswith("`"):
            sql = f"SELECT 1 AS {text} FROM `shop.gold.orders`, `shop.raw.labels`"
        with pytest.raises(PolicyDenied):
            governed(spark, folder).query(sql, actor="a")


@pytest.mark.parametrize(
    "call",
    ["IDENTIFIER('ref' || 'lect')", "IDENTIFIER('java_method')", "IDENTIFIER('try_reflect')"],
)
def test_methods_of_the_jvm_are_found_in_the_plan(spark, folder, call):
    many = ", ".join(f"{i} AS c{i}" for i in range(60))
    sql = f"SELECT {many}, {call}('java.lang.System', 'nanoTime') AS z FROM `shop.gold.orders`"
    with pytest.raises(PolicyDenied) as denial:
        governed(spark, folder).query(sql, actor="a")
    assert "JVM" in str(denial.value.__cause__)


def test_commands_cannot_be_estimated(spark):
    session = open_session(spark, TABLES)
    statements = [
        "CREATE TABLE zzz AS SELECT 1", "DROP TABLE zzz", "SHOW TABLES", "SELECT FROM WHERE",
        "DESCRIBE QUERY SELECT 1", "CACHE TABLE x AS SELECT 1", "SET a = 1",
        "INSERT OVERWRITE DIRECTORY '/tmp/none' USING parquet SELECT 1",
        "WITH c AS (SELECT 1 AS a) INSERT INTO `shop.raw.labels` SELECT a, a, a FROM c",
        "SELECT TRANSFORM(o_orderkey) USING 'cat' FROM `shop.gold.orders`",
    ]
    for sql in statements:
        with pytest.raises(NotEstimable):
            estimate(session, sql)


def test_outage_of_the_trail_denies(spark):
    def down(events):
        raise OSError("gone")

    session = GovernedSession(spark, TABLES, Policy(tables=["shop.gold.*"]), down)
    with pytest.raises(PolicyDenied, match="audit sink unavailable"):
        session.query(ORDERS, actor="a")
    open_ended = GovernedSession(
        spark, TABLES, Policy(tables=["shop.gold.*"]), down, fail_closed=False
    )
    with pytest.raises(OSError, match="gone"):
        open_ended.query(ORDERS, actor="a")


def test_settings_of_the_session_are_kept(spark, conf):
    conf("spark.sql.shuffle.partitions", "3")
    session = open_session(spark, TABLES)
    assert session.conf.get("spark.sql.shuffle.partitions") == "3"
    assert session.conf.get("spark.sql.runSQLOnFiles") == "false"
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_tables_from_functions(spark, folder):
    session = GovernedSession(
        spark, {"shop.gold.few": lambda s: s.range(7).toDF("n")}, Policy(tables=["shop.*"]),
        lambda e: trail.append_events(e, folder, "b"),
    )
    assert session.query("SELECT sum(n) AS s FROM `shop.gold.few`", actor="a").first()[0] == 21


def test_checks_under_the_policy(spark, folder):
    session = governed(spark, folder)
    specs = parse_checks(
        {
            "shop.gold.orders": [
                {"type": "row_count", "min_rows": 1}, {"type": "uniqueness", "column": "o_orderkey"},
            ],
            "shop.raw.labels": [{"type": "row_count", "min_rows": 1}],
        }
    )
    results, denied = session.run_checks(specs, actor="a")
    assert [r["passed"] for r in results.collect()] == [True, True]
    assert list(denied) == ["shop.raw.labels"]
    assert sorted((t, d) for t, d, _ in recorded(spark, folder)) == [
        ("quality_checks", "allowed"), ("quality_checks", "denied"),
    ]


@pytest.mark.parametrize("sql", ["SELECT l_orderkey", "SELECT count(*)", "SELECT *"])
def test_estimates_do_not_depend_on_the_reader(spark, folder, conf, sql):
    statement = f"{sql} FROM `shop.gold.lineitem`"
    whole = governed(spark, folder).estimate(statement, actor="a").estimated_bytes
    for name, value in FOOTER_COUNT_CONF.items():
        conf(name, value)
    found = governed(spark, folder).estimate(statement, actor="a")
    assert found.estimated_bytes == whole
    assert found.referenced_tables == ("shop.gold.lineitem",)
    with pytest.raises(PolicyDenied, match="exceeds ceiling"):
        governed(spark, folder, max_bytes=whole - 1).query(statement, actor="a")


def test_footprints_of_several_statements(spark, folder):
    found = governed(spark, folder).footprints(
        {"rows": ORDERS, "join": f"SELECT * FROM ({ORDERS}) JOIN `shop.gold.customer` ON o_orderkey = c_custkey"},
        actor="a",
    )
    rows = {r["statement"]: r for r in found.collect()}
    assert rows["join"]["estimated_bytes"] > rows["rows"]["estimated_bytes"] > 0
    assert sorted(rows["join"]["referenced_tables"]) == ["shop.gold.customer", "shop.gold.orders"]


def test_a_suite_is_charged_for_every_scan(spark, folder):
    name = "shop.gold.orders"
    one = governed(spark, folder).estimate(f"SELECT * FROM `{name}`", actor="a").estimated_bytes
    checks = [{"type": "uniqueness", "column": c} for c in ("o_orderkey", "o_custkey")]
    specs = parse_checks({name: [*checks, {"type": "row_count", "min_rows": 1}]})
    _, denied = governed(spark, folder, max_bytes=3 * one - 1).run_checks(specs, actor="a")
    assert denied == {name: f"Estimated {3 * one} bytes exceeds ceiling of {3 * one - 1}"}
    results, denied = governed(spark, folder, max_bytes=3 * one).run_checks(specs, actor="a")
    assert not denied and results.count() == 3
