import re

from inlay.llm import op8_secrets as op
from tests.llm.corpus import frame, words

HEX = "0123456789abcdef"


def rows():
    import random

    rng = random.Random(6)
    out = []
    plain = ["thinking", "otherwise", "management", "ingredient", "wise", "other", "thermal", "agement"]
    for i in range(160):
        body = " ".join(rng.choices(plain, k=30))
        if i % 4 == 0:
            body += ' my token = "' + "".join(rng.choices(HEX, k=40)) + '" rest'
        elif i % 4 == 1:
            body += " otherwisemanagementthinking rest"
        elif i % 8 == 2:
            body += ' TOKEN: "' + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)) + '"'
        out.append((i, body, "src/app.py", "x", 1))
    out += [(500, None, None, None, None), (501, "", "a", "x", 1), (502, "a b c", "a", "x", 1), (0, out[0][1], "src/app.py", "x", 1)]
    return out


def test_candidates_equal_brute_force(spark):
    data = rows()
    got = sorted((r.doc_id, r.position, r.finding) for r in op.findings(frame(spark, data)).collect())
    want = sorted(
        (d, i, m) for d, text, *_ in data for i, w in enumerate(words(text, False)) for m in re.findall(op.RUN, w)
    )
    assert got == want


def test_held_out_findings_are_told_apart(spark):
    data = rows()
    labels = spark.createDataFrame(
        [
            (d, i, m, float(any(c.isdigit() for c in m)))
            for d, text, *_ in data
            for i, w in enumerate(words(text, False))
            for m in re.findall(op.RUN, w)
            if d < 80 and d
        ],
        "doc_id bigint, position bigint, finding string, label double",
    )
    out = op.scanned(frame(spark, data), labels).collect()
    held = [r for r in out if r.label is None]
    right = sum(r.is_secret == any(c.isdigit() for c in r.finding) for r in held)
    assert len(held) > 40 and right >= 0.95 * len(held)


def test_one_kind_of_labels_and_empty_table(spark):
    only = [(1, 'token = "' + "ab12" * 10 + '"', "p", "x", 1)]
    assert [r.probability for r in op.scanned(frame(spark, only)).collect()] == [1.0]
    assert op.scanned(frame(spark).limit(0)).count() == 0


def test_no_user_functions(spark):
    plan = op.scanned(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
