"""Rules that the SQL has to state at any size: budgets, limits, and what an unanswered lookup means."""

import duckdb

from triagelake.operators.patches import PATCH_CHARS
from triagelake.operators.reach import BUDGET
from triagelake.plans import contract, inputs  # noqa: F401


def _parts(n):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT range AS p_partkey FROM range({n})")
    return con


def test_a_parent_without_an_answer_lifts_nothing():
    rows = _parts(12_000).execute(f"SELECT command FROM ({contract.SQL['scan_findings']}) WHERE project_id = 0 AND package = 'p-1122' AND fix_reason = 'parent_constraint'").fetchall()
    assert rows == [('[tool.uv]\noverride-dependencies = ["p-1122>=2.0"]',)]  # p-280 has releases that nobody could tell


def test_a_patch_over_the_limit_is_refused():
    con = duckdb.connect()
    head = len("--- a/x\n+++ b/src/pkg/m7.py\n")  # ids 7 and 14: neither skipped, failed nor refused by number
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (7, repeat('x', ?)), (14, repeat('x', ?))) t(doc_id, text)", [PATCH_CHARS - head - 1, PATCH_CHARS - head - 1])
    assert dict(con.execute(f"SELECT patch_id, state FROM ({contract.SQL['patch_states']})").fetchall()) == {7: "reduced", 14: "refused"}


def test_a_spent_budget_is_counted():
    con = _parts(10 * (4 * BUDGET + 400))
    rows = con.execute(f"SELECT reason_code, count(*) FROM ({contract.SQL['source_to_verdict']}) WHERE project_id = 0 GROUP BY 1").fetchall()
    assert {"symbol_not_in_graph", "expansion_incomplete"} <= {r[0] for r in rows} and "symbol_not_reached" not in {r[0] for r in rows}
    assert con.execute(f"SELECT max(dependency_modules_parsed) FROM ({contract.SQL['source_counters']})").fetchone() == (BUDGET,)
