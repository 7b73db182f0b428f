from tests.test_journal_rules import rows
from weftline.operators import journal as J


def test_last_two_runs_and_truncated_sides(spark):
    j = rows(spark, ("a", "MEASURED", 9.0, 0, "1"), ("a", "MEASURED", 1.0, 5, "2"), ("b", "MEASURED", 1.0, 5, "2"), ("a", "MEASURED", 2.0, 9, "3"), ("c", "ABSENT", None, 9, "3"))
    found = {r["domain"]: (r["old"], r["new"], r["outcome"], r["truncated"]) for r in J.run_diff(j, limit=2).collect()}
    assert found == {"a": (1.0, 2.0, "moved", True), "b": (1.0, None, "gone", True), "c": (None, None, "appeared", True)}
    assert not any(r["truncated"] for r in J.run_diff(j, limit=3).collect())
    assert {r["outcome"] for r in J.run_diff(j, "3", "1", limit=2).filter("not truncated").collect()} == {"moved", "appeared"}
