"""Every branch of the decisions on records is reached by the given tables, and repeated commands are decided in order."""

import pytest

from ledgerloom import registry
from ledgerloom.operators import workflow as W

SF = "/root/testdata/sf0.01"
OUTCOMES = {
    "N06b_marked_verifications": {"none", "unknown type", "failed", "verified", "evidence required"},
    "N07b_decided_requests": {"none", "role not allowed", "already approved", "not the requester", "dual control", "approve", "reject", "cancel"},
    "N07c_created_requests": {"invalid type", "role not allowed", "case not found", "item not found", "already waived", "duplicate", "created"},
    "P23b_case_moves": {"none", "invalid transition", "open critical exceptions", "moved"},
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_branches(spark, name):
    assert {r.outcome for r in registry.QUERIES[name](spark, SF).select("outcome").distinct().collect()} == OUTCOMES[name]


def test_effects_and_satisfied(spark):
    rows = registry.QUERIES["R20b_approval_effects"](spark, SF).select("relation", "status", "detail").distinct().collect()
    assert {r.detail for r in rows if r.relation == "case"} == {"none", "moved", "invalid transition"}
    assert any(r.status == "Waived" and r.detail for r in rows if r.relation == "exception") and any(r.status == "Waived" and r.detail for r in rows if r.relation == "cp")
    got = {(r.rule_id, r.satisfied_by) for r in registry.QUERIES["R15b_satisfied_by_type"](spark, SF).collect() if r.satisfied_by}
    assert got == {("EST-VERIFY-01", "e_stamp"), ("REG-VERIFY-01", "registry_rod")}


def test_the_first_request_of_an_item_counts(spark):
    asks = [("cp_waive", 1, 5, "Viewer", 0), ("cp_waive", 1, 5, "Admin", 1), ("cp_waive", 1, 5, "Reviewer", 2), ("case_decision", 9, 9, "Admin", 3), ("case_decision", 1, 1, "Admin", 4), ("export_release", 1, 7, "Admin", 5)]
    df = spark.createDataFrame(asks, "request_type string, case_id long, item long, role string, n int")
    items = spark.createDataFrame([("cp_waive", 5, "Open"), ("export_release", 8, "Done")], "request_type string, item long, status string")
    none = spark.createDataFrame([], "request_type string, item long")
    got = {r.n: r.outcome for r in W.created(df, spark.createDataFrame([(1,)], "case_id long"), items, none, ["n"]).collect()}
    assert got == {0: "role not allowed", 1: "created", 2: "duplicate", 3: "case not found", 4: "created", 5: "item not found"}


def test_recipients_are_single_before_they_are_multiplied(spark):
    users = [(o, "Admin", f"a{i % 40}-{o}@x") for o in range(2) for i in range(80)] + [(0, "Approver", "a1-0@x"), (0, "Reviewer", "r@x"), (0, "Admin", ""), (0, "Admin", None)]
    events = [(i, i % 2, ("approval.pending", "case.decided", "approval.decided", "other")[i % 4], f"a{i}@x") for i in range(400)]
    events += [*events[:8], (0, 1, "case.decided", None), (0, 0, "approval.decided", "a1-0@x"), (5, 1, "export.generated", None), (None, 0, "case.decided", None), (9, None, "case.decided", None), (10, 0, "approval.decided", "")]
    x = spark.createDataFrame(events, "event_id long, org_id long, event_type string, requested_by_email string")
    got = W.recipients(x, spark.createDataFrame(users, "org_id long, role string, email string"))
    roles = {k: set(v) for k, v in W.RECIPIENT_ROLES.items()}
    want = {(e, m) for e, o, k, _ in events for uo, r, m in users if m and o == uo and r in roles.get(k, ())} | {(e, m) for e, _, k, m in events if k == "approval.decided" and m}
    rows = [(r.event_id, r.email) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # Only pairs of the four event_ids that have several events are compared again.
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
