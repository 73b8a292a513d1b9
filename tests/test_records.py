"""States out of logs, against loops."""

import random

from palimpsest.operators import records as R


def test_members_after_any_changes(spark):
    r = random.Random(1)
    stored = [(p, u, f"old{u}", r.choice(["intern", "sde2"]), r.random() < 0.5) for p in range(3) for u in range(8) if r.random() < 0.5]
    changes = [(r.randrange(3), r.randrange(8), i, r.choice(["add", "remove", "role", "role", "other"]), f"n{i}", r.choice(["manager", "sde2"])) for i in range(150)]
    state = {(p, u): [n, role, active] for p, u, n, role, active in stored}
    for p, u, _, kind, name, role in changes:
        if kind == "add":
            state[(p, u)] = [name, role, True]
        elif (p, u) in state and kind == "remove":
            state[(p, u)][2] = False
        elif (p, u) in state and kind == "role":
            state[(p, u)][1] = role
    m = spark.createDataFrame(stored, "project_id int, user_id int, username string, role string, is_active boolean")
    c = spark.createDataFrame(r.sample(changes, len(changes)), "project_id int, user_id int, seq int, kind string, username string, role string")
    for n in (150, 40, 10):
        some = c.where(f"seq < {n}")
        state = {(p, u): [x, role, active] for p, u, x, role, active in stored}
        for p, u, _, kind, name, role in changes[:n]:
            if kind == "add":
                state[(p, u)] = [name, role, True]
            elif (p, u) in state and kind == "remove":
                state[(p, u)][2] = False
            elif (p, u) in state and kind == "role":
                state[(p, u)][1] = role
        assert sorted(map(tuple, R.members_after(m, some).collect())) == sorted((*k, *v) for k, v in state.items())
    assert sorted(map(tuple, R.members_after(m, c.where("false")).collect())) == sorted(stored)


def test_scans_and_lists(spark):
    log = [("o", "r", 1, "started", 5, "a", None), ("o", "r", 1, "failed", 9, None, "disk"), ("o", "r", 1, "completed", 7, "b", None), ("o", "r", 2, "started", 5, "a", None), ("o", "r", 2, "completed", 3, "x", None), ("o", "r", 3, "completed", 3, "x", None), ("o", None, 4, "started", 1, None, None)]
    df = spark.createDataFrame(log, "org_id string, repo string, scan_id int, event string, at int, commit_sha string, error string")
    got = {tuple(r) for r in R.scan_states(df).collect()}
    assert got == {("o", "r", 1, "failed", "a", 5, 9, "disk"), ("o", "r", 2, "running", "a", 5, None, None), ("o", None, 4, "running", None, 1, None, None)}
    t = spark.createDataFrame([(1, "s", "e"), (2, None, "f")], "id int, summary string, code_embedding string")
    new = spark.createDataFrame([(1, None, "x"), (2, "n", "y"), (3, "z", "z")], "id int, summary string, code_embedding string")
    assert {tuple(r) for r in R.whitelisted(t, new, ["id"], R.SUMMARY).collect()} == {(1, "s", "e"), (2, "n", "f")}
