import json

from recordloom.plans import adoption, integrity
from recordloom.sources.records import Records
from tests.repository import AS_OF, CASES, EVIDENCE_SCHEMA, WORK_SCHEMA, base, evidence, materialised

CASES = CASES | {
    "bootstrapped": (dict.fromkeys(base()) | adoption.bootstrap_files(AS_OF), "accept", ""),
    "own-schema-allows": (evidence(result="unknown") | {"schemas/evidence-run.schema.json": "{}"}, "accept", ""),
    "own-schema-forbids": ({"schemas/evidence-run.schema.json": json.dumps({"properties": {"id": {"const": "x"}}})}, "reject", "schema id: 'x' was expected"),
    "broken-manifest": ({"work/completed/001-seed/work-item.json": "[1]", "evidence/runs/20260101-seed.json": None, "_dashboard": "as it was\n"}, "reject", "expected a JSON object"),
    "twice-the-same-id": ({"work/completed/001-again/README.md": "x", "work/completed/001-again/work-item.json": base()["work/completed/001-seed/work-item.json"]}, "reject", "duplicate id also used by work/completed/001-again/work-item.json"),
    "unticked-box": ({"work/completed/001-seed/README.md": "- [ ] **AC-1** done\n"}, "reject", "is satisfied but its README checkbox is unchecked"),
    "review-overdue": ({"audits/registry.json": base()["audits/registry.json"].replace("2026-09-15", "2026-07-01")}, "reject", "freshness expired on 2026-07-01"),
    "soft-evidence": (evidence(provenance="provisional"), "reject", "rests on non-concrete evidence; ratchet it"),
    "no-supersedes": ({"decisions/0002-b.md": "---\nid: 0002\ntitle: B\nstatus: accepted\ndate: 2026-01-01\nsupersedes: [0009]\n---\n"}, "reject", "supersedes unknown decision '0009'"),
}


def test_all_cases_in_one_batch(spark):
    r = Records(materialised(spark, {k: v[0] for k, v in CASES.items()}))
    found = integrity.validate(r, AS_OF, {"work": WORK_SCHEMA, "evidence": EVIDENCE_SCHEMA}).persist()
    told = {}
    for x in integrity.ordered(found).collect():
        told.setdefault(x["repo_id"], []).append((x["path"], x["message"]))
    cases = spark.createDataFrame([(k, expect, fragment) for k, (_, expect, fragment) in CASES.items()], "repo_id string, expect string, fragment string")
    out = integrity.verdicts(cases, r, found).collect()
    assert len(out) == len(CASES)
    assert not {x["case"]: told.get(x["case"]) for x in out if not x["passed"]}
    assert {x["repo_id"] for x in integrity.accepted(r, found).collect() if x["accepted"]} == {k for k, v in CASES.items() if v[1] == "accept"}
