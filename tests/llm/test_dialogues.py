"""Repair of conversations against a search over all edits."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from harness import connect, difference

from lectern.llm import dialogues, queries
from lectern.sources.tables import table

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, rank long"
SPACE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults_by_hand(rows):
    seen = set()
    for role, text in rows:
        bare = text.strip(SPACE)
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(rows, faults, most=2):
    """The least (cost, audit, repaired) over all edits, with up to ``most`` inserts in a gap, by states one by one."""
    found = {"": (0, "", ())}

    def better(table, state, new):
        if state not in table or new[:2] < table[state][:2]:
            table[state] = new

    def grown(state, letter):
        roles = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        return letter in roles and letter

    def inserted(table):
        for _ in range(most):
            for state, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if to := grown(state, role[0]):
                        better(table, to, (cost + 2, audit + "I", (*out, (role, ""))))
        return table

    for (role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in inserted(dict(found)).items():
            better(after, state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if to := grown(state, role[:1]):
                better(after, to, (cost + late, audit + "K", (*out, (role, text))))
            for other in ("user", "assistant"):
                if to := grown(state, other[0]):
                    better(after, to, (cost + 2 + late, audit + "R", (*out, (other, text))))
        found = after
    ends = [v for s, v in inserted(found).items() if s in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def by_hand(rows):
    convs = {r[0] for r in rows}
    held = {c: [] for c in convs}
    for conv, turn, role, text in damaged_by_hand(rows):
        held[conv].append((turn, role, text))
    out = []
    for conv, own in held.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(r, t) for _, r, t in own]
        faults = list(faults_by_hand(pairs))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, kept = cheapest(pairs, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def found(spark, root):
    return sorted(map(tuple, queries.queries()["op12_dialogue_repair"](spark, root).collect()), key=str)


def test_given_conversations(spark, root):
    rows = [tuple(r) for r in table(spark, root, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, root) == by_hand(rows)


def test_sql_twin(spark, root):
    name = "op12_dialogue_repair"
    assert difference(queries.queries()[name](spark, root), connect(root), queries.oracle_sql()[name]) is None


def every_audit(rows, kinds):
    """Cost and letters of every sequence of edits that ends in the wanted roles, two inserts a gap at most."""
    gaps = [g for k in range(3) for g in itertools.product("ua", repeat=k)]
    edits = [[("D", "", 3)] if kind in (1, 2) else
             [("D", "", 3), ("R", "u", 2 + (kind == 3)), ("R", "a", 2 + (kind == 3)), ("K", role[:1] or "-", int(kind == 3))]
             for (role, _), kind in zip(rows, kinds)]
    for chosen in itertools.product(*[x for e in edits for x in (gaps, e)], gaps):
        cost, audit, roles = 0, "", ""
        for at, part in enumerate(chosen):
            if at % 2:
                cost, audit, roles = cost + part[2], audit + part[0], roles + part[1]
            else:
                cost, audit, roles = cost + 2 * len(part), audit + "I" * len(part), roles + "".join(part)
        if re.fullmatch("(s?(ua)+)?", roles):
            yield cost, audit


def test_every_sequence_of_edits():
    draw = np.random.default_rng(11)
    for count in (1, 2, 2, 3, 3, 3):
        rows = [(str(draw.choice(["system", "user", "assistant", "tool"])), "") for _ in range(count)]
        kinds = [int(draw.choice([0, 0, 1, 3])) for _ in rows]
        pairs = [(role[:1], kind) for (role, _), kind in zip(rows, kinds)]
        assert dialogues.finished(dialogues.solved(pairs)) == min(every_audit(rows, kinds))


@pytest.mark.parametrize("seed", range(3))
def test_search_over_all_edits(seed):
    draw = np.random.default_rng(seed)
    for _ in range(150):
        count = int(draw.integers(0, 9))
        rows = [
            (str(draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ü"])), str(draw.choice(["a.", "b", "", "c!", "d?"])))
            for _ in range(count)
        ]
        faults = list(faults_by_hand(rows))
        kinds = [["", "blank", "duplicate", "truncated"].index(f) for f in faults]
        pairs = [(role[:1], kind) for (role, _), kind in zip(rows, kinds)]
        cost, audit, _ = cheapest(rows, faults, 3)
        if pairs:
            assert dialogues.finished(dialogues.solved(pairs)) == (cost, audit)
            for cut in range(1, count):
                halves = dialogues.joined(dialogues.solved(pairs[:cut]), dialogues.solved(pairs[cut:]))
                assert dialogues.finished(halves) == (cost, audit)


def test_letters_of_one_price_are_no_prefixes():
    """What the joining of runs relies on."""
    kinds = list(itertools.product("sua", (0, 1, 3)))
    for rows in itertools.product(kinds, repeat=2):
        whole = dialogues.solved(list(rows))
        parts = dialogues.joined(dialogues.solved([rows[0]]), dialogues.solved([rows[1]]))
        assert whole == parts


def odd_rows():
    long = "word " * 40_000
    rows = [
        (1, None, "user", "a."), (1, None, None, None), (1, 3, "assistant", "b!"), (1, 3, "assistant", "b!"), (1, 9, "user", long),
        (2, 0, "", ""), (2, 1, "tool", "x."), (2, 2, "sys", " "), (2, 3, "user", "é.\u0085"), (2, 4, "user", "e? \t\n"),
        (None, 0, "user", "q."), (None, 1, "assistant", "r."), (None, None, "system", "s."), (4, 5, "user", "same."), (4, 5, "user", "other."),
    ]
    return [*rows, *[(100 + i % 40, i // 40, ("user", "assistant")[i // 40 % 2], f"text {i}.") for i in range(400)]]


def test_odd_rows(spark, folder):
    rows = odd_rows()
    spark.createDataFrame([(*r, "own", 7, 8) for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    assert found(spark, folder) == by_hand(rows)


def test_no_rows(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    assert found(spark, folder) == []


def test_long_conversations_are_solved_in_runs(spark):
    draw = np.random.default_rng(9)
    rows = []
    for conv, count in ((1, 3000), (2, 700), (3, 4), (4, 5)):
        for turn in range(count):
            role = str(draw.choice(["user", "assistant", "system"], p=[0.5, 0.45, 0.05]))
            rows.append((conv, turn, role, str(draw.choice([f"t {turn}.", f"t {turn}", "same.", ""]))))
    frame = spark.createDataFrame([(*r, None, 0, 0) for r in rows], SCHEMA)
    out = {r["key"]: r for r in dialogues.repair(frame, block=4).collect()}
    for conv in (1, 2, 3, 4):
        own = [(r, t) for c, _, r, t in rows if c == conv]
        cost, audit, kept = cheapest(own, list(faults_by_hand(own)))
        assert (out[str(conv)]["cost"], out[str(conv)]["audit"]) == (cost, audit)
        assert out[str(conv)]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    held = dialogues.turns(frame, "conv_id", "turn", "role", "text")
    edits = dialogues.audits(dialogues.with_faults(held), 64)
    repaired = sorted((r["place"], r["role"], r["text"]) for r in dialogues.repaired_turns(held, edits).collect() if r["key"] == "2")
    own = [(r, t) for c, _, r, t in rows if c == 2]
    kept = cheapest(own, list(faults_by_hand(own)))[2]
    assert repaired == [(i, r, t) for i, (r, t) in enumerate(kept)]
