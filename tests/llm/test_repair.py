"""Repair of conversations against plain recursion over all edits."""

import functools
import hashlib
import random
import zlib

import pytest

from inlay.llm import op11_repair as op11

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "audit int, conv_id bigint, turn bigint, role string, text string, part string, _row string"


def best_audit(symbols):
    """(cost, audit) of the cheapest repair, least audit first."""

    @functools.cache
    def best(at, state, inserted):
        found = []
        if at == len(symbols):
            found += [(0, "")] if state in (0, 3) else []
        else:
            initial, fault = symbols[at]
            found.append((4, "D", best(at + 1, state, 0)))
            extra = 3 if fault == "t" else 0
            if fault in ("", "t"):
                found += [(extra, "K", best(at + 1, NEXT[state, initial], 0))] if (state, initial) in NEXT else []
                found += [(extra + 3, "R", best(at + 1, NEXT[state, x], 0)) for x in "ua" if (state, x) in NEXT]
        if inserted < 3:
            found += [(3, "I", best(at, NEXT[state, x], inserted + 1)) for x in "ua" if (state, x) in NEXT]
        return min([f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found], default=(10**9, ""))

    return best(0, 0, 0)


def plain_report(rows):
    """``{conv_id: report}`` of ``(conv_id, turn, role, text)`` rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols = set(), []
        for _, role, text in turns:
            body = text.rstrip(SPACE)
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = best_audit(tuple(symbols))
        lines, at, state = [], 0, 0
        for edit in audit:
            if edit == "I" or edit == "R":
                initial = "a" if state == 2 else "u"
                lines.append({"u": "user", "a": "assistant"}[initial] + ":" + (turns[at][2] if edit == "R" else ""))
            elif edit == "K":
                initial = symbols[at][0]
                lines.append(f"{turns[at][1]}:{turns[at][2]}")
            state = state if edit == "D" else NEXT[state, initial]
            at += edit != "I"
        present = [t for t, _, _ in turns if t is not None]
        faults = [f for _, f in symbols]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (
            max(present) - min(present) + 1 - len(set(present)) if present else 0,
            faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Well.", "why?", "no end", "  ", "", "So it is!\n", "🙂 東京.", "x" * 5000 + "."]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice([*texts, f"text {rng.random()}.", f"text {rng.random()}.", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(3, 1, "user", "Twice."), (3, 1, "user", "Twice.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(1, *r, "x", "y") for r in rows], SCHEMA).repartition(3)


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.select(*op11.REPORT_NAMES).collect()}


def test_every_edit_matches_recursion():
    rng, steps = random.Random(5), op11.Steps()
    for _ in range(600):
        rows = [(rng.choice("suuaaa?s"), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randrange(1, 11))]
        edits, tail = op11.edits_of(steps, rows, 0, None)
        assert "".join(edits) + tail == best_audit(tuple(rows))[1]
        ends = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(4)))) if len(rows) > 1 else []
        pieces = [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)])]
        cut = ""
        for piece, (begin, end) in zip(pieces, op11.chain([steps.table(p) for p in pieces])):
            edits_here, tail_here = op11.edits_of(steps, piece, begin, end)
            cut += "".join(edits_here) + tail_here
        assert cut == "".join(edits) + tail


@pytest.mark.parametrize("seed", [1, 2])
def test_report_matches_brute_force(spark, seed):
    rows = conversations(seed)
    assert found(op11.report(frame(spark, rows))) == plain_report(rows)


def test_one_conversation_over_many_parts(spark, monkeypatch):
    """Most rows in one conversation, which adaptive execution leaves in several parts."""
    monkeypatch.setattr(op11, "CHUNK_CHARS", 500)
    rng = random.Random(3)
    long = [(700, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}{rng.choice(['.', '', '!'])}") for t in range(3000)]
    long += [(700, 10, "user", "Again.")] * 300
    rows = long + conversations(4, 20)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        staged = op11.staged_rows(df)
        assert max(len(c) for c in op11.cut_conversations(staged)) >= 3
        got = found(op11.report(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = plain_report([r for r in rows if r[0] != 700])
    assert {k: v for k, v in got.items() if k != 700} == want
    turns = sorted(long, key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, symbols = set(), []
    for _, _, role, text in turns:
        symbols.append((role[0], "d" if (role, text) in seen else "" if text[-1] in ".!?" else "t"))
        seen.add((role, text))
    edits, tail = op11.edits_of(op11.Steps(), symbols, 0, None)
    assert got[700][6] == "".join(edits) + tail
    lines = [f"{r}:{x}" for e, _, r, x in op11.lines_of(op11.Run(700, 0, *zip(*[t[1:] for t in turns]), symbols), edits, tail, 0) if e != "D"]
    assert got[700][7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repaired_messages_are_legal(spark):
    rows = conversations(6)
    out = {}
    for r in op11.repaired(frame(spark, rows)).orderBy("conv_id", "part", "at").collect():
        out.setdefault(r.conv_id, []).append(r)
    for conv, want in plain_report(rows).items():
        assert "".join(r.edit for r in out[conv]) == want[6]
        kept = [f"{r.role}:{r.text}" for r in out[conv] if r.role is not None]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == want[7]


def test_damage_and_empty_tables(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {c} {t}!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else text.replace("!", "") if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, op11.damaged(frame(spark, rows)).collect())) == sorted(
        f"Row(conv_id={a!r}, turn={b!r}, role={c!r}, text={d!r})" for a, b, c, d in want
    )
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: r for r in op11.op11_conversation_repair(spark, folder).collect()}
    report = plain_report(want)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {k: tuple(v)[1:] for k, v in got.items()} == {r[0]: report.get(r[0], nothing) for r in rows}
    frame(spark, []).write.parquet(f"{folder}/e/conversations.parquet")
    assert op11.op11_conversation_repair(spark, f"{folder}/e").count() == 0
    assert op11.repaired(frame(spark, [])).count() == 0
