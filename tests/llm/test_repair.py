import hashlib
import itertools
import random
import re
import zlib

import pytest

from ebbtide.llm import repair as rp

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def brute(codes: bytes, inserts: int = 2):
    """All edits with at most so many insertions between two rows."""
    gaps = ["".join(x) for k in range(inserts + 1) for x in itertools.product("ua", repeat=k)]
    best = None

    def go(i, roles, audit, cost):
        nonlocal best
        for g in gaps:
            r, a, c = roles + g, audit + "I" * len(g), cost + 2 * len(g)
            if i == len(codes):
                if SHAPE.match(r) and (best is None or (c, a) < best):
                    best = (c, a)
                continue
            if best is not None and c > best[0]:
                continue
            code = codes[i]
            go(i + 1, r, a + "D", c + 3)
            if not code & rp.FAULTY:
                more = 1 if code & rp.TRUNCATED else 0
                if code & 3 < 3:
                    go(i + 1, r + "sua"[code & 3], a + "K", c + more)
                for x in "ua":
                    go(i + 1, r + x, a + "R", c + 2 + more)

    go(0, "", "", 0)
    return best


def chain(codes: bytes):
    """The same by going row by row through the four states, texts and all."""
    state = {0: (0, "")}

    def inserted(found):
        for _ in range(4):
            for q, (c, a) in list(found.items()):
                to, new = rp._GIVEN[q], (c + 2, a + "I")
                if to not in found or new < found[to]:
                    found[to] = new
        return found

    state = inserted(state)
    for code in codes:
        new = {}

        def put(q, label):
            if q not in new or label < new[q]:
                new[q] = label

        for q, (c, a) in state.items():
            put(q, (c + 3, a + "D"))
            if not code & rp.FAULTY:
                more = 1 if code & rp.TRUNCATED else 0
                if code & 3 in rp._AFTER[q]:
                    put(rp._AFTER[q][code & 3], (c + more, a + "K"))
                put(rp._GIVEN[q], (c + 2 + more, a + "R"))
        state = inserted(new)
    return min(state[q] for q in (0, 3) if q in state)


def test_search_against_all_edits():
    for n in (0, 1, 2):
        for codes in itertools.product(range(12), repeat=n):
            if all(not (c & 8) or c < 12 for c in codes):
                assert rp.search(bytes(codes)) == brute(bytes(codes)), codes
    draw = random.Random(1)
    for _ in range(12):
        codes = bytes(draw.choice((0, 1, 2, 3, 5, 6, 9, 10)) for _ in range(3))
        assert rp.search(codes) == brute(codes), codes


def test_search_against_row_by_row():
    draw = random.Random(2)
    for n in range(1, 40):
        for _ in range(8):
            codes = bytes(draw.choice((0, 1, 1, 2, 2, 3, 4, 5, 6, 9, 10)) for _ in range(n))
            assert rp.cheapest(codes) == chain(codes), codes
    whole = bytes([1, 2] * 2000)
    assert rp.search(whole) == (0, "K" * 4000)
    assert rp.search(bytes([1] * 500)) == chain(bytes([1] * 500))


def expected(rows):
    """The report of rows (conv_id, turn, role, text) before damage, by loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if way == 0:
                continue
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            role = "user" if way == 4 else role
            own += [(t, role, text)] * (2 if way == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        codes, seen, faults, last, illegal = [], set(), [0, 0, 0], None, 0
        for t, role, text in own:
            inner = re.sub(r"[\x20\x09-\x0D]+", "", text)
            code = "sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
                code |= (8, 8, 4)[fault]
            seen.add((role, text))
            codes.append(code)
            illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
            last = role[:1]
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = chain(bytes(codes)) if codes else (0, "")
        said, i, state = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = rp._GIVEN[state]
                said.append(f"{rp.ROLES[state]}:")
                continue
            _, role, text = own[i]
            i += 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                said.append(f"{role}:{text}")
            elif edit == "R":
                state = rp._GIVEN[state]
                said.append(f"{rp.ROLES[state]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, code int, audit string"


@pytest.mark.parametrize("parts", [1, 7])
def test_report_against_loops(spark, parts):
    draw = random.Random(3)
    texts = ["Hello.", "Yes!", "and so", "", " \t", None, "Long? " * 30000, "ü .", "same.", "same."]
    rows = [(c, draw.choice([None, *range(6)]), draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(texts)) for c in range(60) for _ in range(draw.randint(0, 9))]
    rows += [(None, t, "user", "Who?") for t in range(3)] + [(7, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(300)] + [(8, 1, "user", "a."), (8, 1, "user", "a.")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    got = {r["conv_id"]: tuple(r)[1:] for r in rp.repair_report(turns, rp.damaged(turns)).select("conv_id", *rp._SUMMARY, "audit", "repaired_sha256").collect()}
    assert got == expected(rows)


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", "Well."), (2, 0, "tool", " ")]
    turns = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    spoken = rp.marked(turns)
    found = rp.audits(spoken)
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in found.collect()} == {(1, 2, "KIKK"), (2, 3, "D")}
    fixed = rp.repaired(spoken, found).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in fixed] == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Again?"), (1, 3, "K", "assistant", "Well.")]
    none = spark.createDataFrame([], SCHEMA)
    assert rp.repair_report(none, rp.damaged(none)).count() == 0
