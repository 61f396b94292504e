import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from llm_fixtures import SF, ready  # noqa: F401

from attestlake.llm import conversation_repair as repair
from attestlake.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, block string, codes string, edits string, given string"


def brute(rows):
    """Summary of one conversation's rows (turn, role, text) in order, by a search over all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for new in "ua":
                if new in follow[state]:
                    cost, audit, out = best(i, follow[state][new], inserts + 1)
                    found.append((cost + 3, "I" + audit, ((full[new], ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for new_role, label, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if new_role[:1] in follow[state]:
                        cost, audit, out = best(i + 1, follow[state][new_role[:1]], 0)
                        found.append((cost + price + more, label + audit, ((new_role, text), *out)))
        return min(found, default=(10**9, "", ()))

    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": illegal,
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: brute(sorted(g, key=order)) for conv, g in groups.items()}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "e", "g") for r in rows], SCHEMA)


def compared(summary):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in summary.collect()}


def some_rows(rng, conversations, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua", "system"]
    texts = ["Yes.", "No!", "cut off", "Why?", " ", "", None, "é 😀.", "ok. \n", "x" * 50, "\x0b", "\x00."]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, longest)):
            place = rng.choice([turn, turn, turn, turn + rng.randint(0, 3), None])
            rows.append((conv, place, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"{rng.random()}."))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, children", [(4096, 512), (3, 2)])
def test_against_a_search_over_all_edits(ready, monkeypatch, block, children):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHILDREN", children)
    rows = some_rows(random.Random(block), 150, 9) + [(900, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(40)]
    rows += [(901, None, "user", "same.")] * 30 + [(902, 5, "assistant", "cut")] * 2 + [(903, 1, "", "")]
    assert compared(repair.repair_conversations(frame(ready, rows)).summary()) == expected(rows)


def test_turns_are_those_of_the_digest(ready):
    rows = some_rows(random.Random(5), 30, 8)
    repaired = repair.repair_conversations(frame(ready, rows))
    found = {}
    for r in sorted(repaired.turns().collect(), key=lambda r: r.position):
        found.setdefault(r.conv_id, []).append(r)
    for r in repaired.summary().collect():
        turns = found.get(r.conv_id, [])
        assert [t.position for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in turns))
        assert "".join(t.edit for t in turns) == r.audit.replace("D", "")
        text = "\n".join(f"{t.role}:{t.text}" for t in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_a_long_conversation_in_blocks(ready):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice([f"{t}.", f"{t}", "twice."])) for t in range(12_000)]
    rows += [(2, 0, "user", "one?"), (2, 1, "assistant", "two.")]
    found = compared(repair.repair_conversations(frame(ready, rows)).summary())
    # The search over all edits goes down one call a row, so the long one is followed without recursion.
    seen, codes = set(), []
    for _, _, role, text in rows[:12_000]:
        fault = 3 if (role, text) in seen else 0 if text.endswith(".") else 1
        seen.add((role, text))
        codes.append(("s", "u", "a").index(role[0]) * 4 + fault if role[0] in "sua" else 12 + fault)
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    best = {s: (c, [a]) for s, (c, a) in best.items()}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    cost = {s: c for s, (c, _) in best.items()}
    table = [dict(cost)]
    for code in reversed(codes):
        kind, fault = "suao"[code // 4], code % 4
        now = {}
        for s in cost:
            options = [cost[s] + 4]
            if fault < 2:
                if kind == follow[s] or (s, kind) == ("", "s"):
                    options.append(cost[kind] + 3 * fault)
                options.append(cost[follow[s]] + 3 + 3 * fault)
            now[s] = min(options)
        cost = {s: min(now[s], now[follow[s]] + 3, now[follow[follow[s]]] + 6) for s in now}
        table.append(dict(cost))
    table.reverse()
    audit, state, i = [], "", 0
    while i < len(codes):
        kind, fault = "suao"[codes[i] // 4], codes[i] % 4
        left, after = table[i][state], table[i + 1]
        if left == after[state] + 4:
            audit.append("D")
        elif left == table[i][follow[state]] + 3:
            audit.append("I")
            state, i = follow[state], i - 1
        elif fault < 2 and (kind == follow[state] or (state, kind) == ("", "s")) and left == after[kind] + 3 * fault:
            audit.append("K")
            state = kind
        else:
            audit.append("R")
            state = follow[state]
        i += 1
    audit.append(best[state][1][0])
    assert found[1]["cost"] == table[0][""]
    assert found[1]["audit"] == "".join(audit)
    assert found[2]["audit"] == "KK"


def test_ranks_order_nodes_by_their_audits():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 16, 60)
    offsets = np.array([0, 1, 20, 60])
    ends = np.tile(np.array(repair.AT_END), (3, 1))
    ranked, _ = repair.ranked_paths(codes, offsets, ends)
    audits = []
    for node in range(ranked.first_end):
        path = repair.least_path(ranked, np.array([node]))
        audits.append("".join(repair.LABELS[x - 1] for x in ranked.labels[path]))
    ranks = ranked.rank[: ranked.first_end]
    assert sorted(range(len(audits)), key=lambda n: audits[n]) == sorted(range(len(audits)), key=lambda n: ranks[n])
    assert len(set(zip(audits, ranks.tolist(), strict=True))) == len(set(audits)) == len(set(ranks.tolist()))


def test_empty_table_and_damage(ready):
    assert repair.repair_conversations(frame(ready, [])).summary().count() == 0
    assert repair.repair_conversations(frame(ready, [])).turns().count() == 0
    rows = some_rows(random.Random(9), 60, 6)
    got = repair.damage(frame(ready, rows)).collect()
    key = lambda r: tuple((v is not None, v or 0) if i < 2 else v for i, v in enumerate(r))
    assert sorted(map(tuple, got), key=key) == sorted(damaged(rows), key=key)


def test_query(spark):
    found = compared(QUERIES["op13_conversation_repair"](spark, SF))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(damaged(rows))
    nothing = repair.NOTHING_LEFT
    assert found == {conv: want.get(conv, nothing) for conv in {r[0] for r in rows}}
