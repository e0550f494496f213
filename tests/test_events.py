import json

from factloom.streaming.events import decided

REPOSITORY = {"id": 7, "name": "r", "owner": {"login": "o"}, "default_branch": "main"}
BASE = {"repository": REPOSITORY, "installation": {"id": 1}}


def pull(**kw):
    return {**BASE, "action": "opened", "pull_request": {"number": 3, "head": {"sha": "h1"}, "base": {"sha": "b1"}}, **kw}


def push(files=("a.ts",), **kw):
    return {**BASE, "ref": "refs/heads/main", "before": "b0", "after": "h2", "commits": [{"added": list(files)}], **kw}


CASES = [
    ("pull_request", pull(), "h1", True, None),
    ("pull_request", pull(action="closed"), None, False, "pull_request.closed is not analysed"),
    ("pull_request", pull(repository={}), None, False, "payload missing repository"),
    ("pull_request", pull(installation=None), None, False, "payload missing installation"),
    ("pull_request", pull(pull_request={"head": {"sha": "h"}}), None, False, "pull_request payload missing number or SHAs"),
    ("push", push(["x/package.json"]), None, True, None),
    ("push", push(["README.md"]), None, False, "no dependency manifest, lockfile, scope config changed"),
    ("push", push(deleted=True), None, False, "branch deletion"),
    ("push", push(ref="refs/tags/v1"), None, False, "tag or non-branch push"),
    ("push", push(ref="refs/heads/dev"), None, False, "push to a non-default branch"),
    ("push", push(before="000"), None, False, "new branch push has no diff"),
    ("push", push(commits=[]), None, True, None),
    ("star", {}, None, False, "event star is not analysed"),
]


def test_decisions(spark):
    rows = [(i, e, json.dumps(p)) for i, (e, p, *_) in enumerate(CASES)]
    deliveries = spark.createDataFrame(rows, "delivery int, event string, payload string")
    changed = spark.createDataFrame([("7:h1", ["go.mod"], True)], "key string, files array<string>, complete boolean")
    got = {r.delivery: (r.analyse, r.reason) for r in decided(deliveries, changed).collect()}
    assert got == {i: (a, why) for i, (_, _, _, a, why) in enumerate(CASES)}


def test_source_only(spark):
    deliveries = spark.createDataFrame([(1, "pull_request", json.dumps(pull()))], "delivery int, event string, payload string")
    look = lambda files, complete: spark.createDataFrame([("7:h1", files, complete)], "key string, files array<string>, complete boolean")
    one = lambda files, complete, trigger: tuple(decided(deliveries, look(files, complete), trigger).select("analyse", "source_only").first())
    assert one(["src/a.ts"], True, True) == (True, True)
    assert one(["src/a.ts"], True, False) == (False, False)
    assert one(["src/a.ts"], False, True) == (True, False)
    assert one(["dist/a.ts"], True, True) == (False, False)
    assert one(["src/a.ts", "go.sum"], True, True) == (True, False)
