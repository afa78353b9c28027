import json

from fathomline.operators import bundle_rules as R
from fathomline.sources import bundles as B

DOC = {
    "bundle_id": "b", "schema_version": "0.1.0", "target": {"id": "t", "kind": "product"},
    "claims": [{"id": "c1", "subject_ref": {"type": "product", "id": "t"}}, {"id": "c2", "subject_ref": {"type": "event", "id": "gone"}}],
    "repositories": [{"id": "r1"}], "sources": [{"id": "s1"}],
    "source_fetches": [{"id": "f1", "source_id": "s1", "retained_artifact_path": "a/b"}, {"id": "f2", "source_id": "s9", "retained_artifact_path": "../x"}, {"id": "f3"}],
    "events": [{"id": "e1", "claim_ids": ["c1"], "time": {"start": "2024-01-02", "end": "2024-01-01"}}, {"id": "e2", "claim_ids": [], "launch_episode_id": "l9"}],
    "launch_episodes": [{"id": "l1", "event_ids": ["e1"]}, {"id": "l2", "event_ids": []}],
    "growth_episodes": [{"id": "g1", "repository_id": "r1", "related_event_ids": ["e1", "e9"]}, {"id": "g2", "start_metric_id": "m9"}],
    "metric_snapshots": [{"id": "m1", "value_numeric": 120.0, "unit": "percent", "claim_ids": ["c1"]}, {"id": "m2", "claim_ids": ["c1", "c9"]}],
    "tactic_occurrences": [{"id": "o1", "tactic_id": "nope", "claim_ids": ["c1"]}],
    "constraints": [{"id": "k1", "applies_to_refs": [{"type": "event", "id": "e1"}, {"type": "claim", "id": "c9"}], "claim_ids": ["c1"]}],
    "conflicts": [{"id": "x1", "claim_ids": ["c1", "c1"]}],
}


def test_all_rules(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(DOC))
    b = B.read_bundles(spark, str(tmp_path))
    tables = {n: B.collection(b, n) for n in B.COLLECTIONS}
    got = {(r["table_name"], r["row_id"], r["rule"]) for r in R.bundle_violations(tables, b.selectExpr("bundle_id", "target.kind AS type", "target.id AS id")).collect()}
    assert got == {
        ("claims", "c2", "subject_ref names nothing"), ("source_fetches", "f2", "source_id names nothing"), ("source_fetches", "f2", "path leaves the bundle"), ("source_fetches", "f3", "source_id is missing"),
        ("events", "e1", "ends before it begins"), ("events", "e2", "rests on no claim"), ("events", "e2", "launch_episode_id names nothing"), ("launch_episodes", "l2", "groups no events"),
        ("growth_episodes", "g1", "related_event_ids names nothing"), ("growth_episodes", "g2", "repository_id is missing"), ("growth_episodes", "g2", "start_metric_id names nothing"),
        ("metric_snapshots", "m1", "percent outside 0 to 100"), ("metric_snapshots", "m2", "is both number and text, or neither"), ("metric_snapshots", "m2", "claim_ids names nothing"),
        ("tactic_occurrences", "o1", "tactic_id names nothing"), ("constraints", "k1", "applies_to_refs names nothing"), ("conflicts", "x1", "fewer than two claims"),
    }


def test_narrative(spark):
    blocks = spark.createDataFrame([("b", "origin", ["c1", "c9"]), ("b", "flywheel", []), ("b", "first_users", None), ("b", "thirty_second", ["c1"])], "bundle_id string, id string, claim_ids array<string>")
    claims = spark.createDataFrame([("b", "c1"), ("other", "c9")], "bundle_id string, id string")
    got = {(r["row_id"], r["rule"]) for r in R.narrative_violations(blocks, claims).collect()}
    assert got == {("origin", "cites an unknown claim"), ("flywheel", "cites no claim"), ("first_users", "cites no claim")}
