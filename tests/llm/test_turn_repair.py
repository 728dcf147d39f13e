import hashlib
import itertools
import random
import re
import zlib

import pytest
from tidewell.llm import turn_repair as tr

EMPTY = hashlib.sha256(b"").hexdigest()
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text, d = name(role), name(text), zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows, faults):
    """All ways at once: by roles so far, the least (cost, audit, lines)."""
    ways = {"": (0, "", [])}

    def put(found, so_far, way):
        if re.fullmatch("s?(ua)*u?", so_far):
            key = so_far if len(so_far) < 2 else so_far[-1]
            found[key] = min(found.get(key, way), way)

    def with_inserts(ways):
        for _ in range(3):
            more = dict(ways)
            for roles, (cost, audit, lines) in ways.items():
                for name in ("user", "assistant"):
                    if re.fullmatch("s?(ua)*u?", ("ua" if roles == "a" else roles) + name[0]):
                        put(more, ("ua" if roles == "a" else roles) + name[0], (cost + 2, audit + "I", [*lines, f"{name}:"]))
            ways = more
        return ways

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        found = {}
        for roles, (cost, audit, lines) in with_inserts(ways).items():
            roles = "ua" if roles == "a" else roles
            put(found, roles, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    put(found, roles + role[0], (cost + cut, audit + "K", [*lines, f"{role}:{text}"]))
                for name in ("user", "assistant"):
                    put(found, roles + name[0], (cost + cut + 2, audit + "R", [*lines, f"{name}:{text}"]))
        ways = found
    done = [w for roles, w in with_inserts(ways).items() if roles == "" or roles[-1] == "a"]
    cost, audit, lines = min(done)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def report(rows, damage=True):
    text = lambda x: " " if x is None else x
    after = damaged(rows) if damage else [(c, t, text(r), text(x)) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        if not mine:
            out[conv] = (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        faults = faults_of(mine)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        odd = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), odd, *brute(mine, faults))
    return out


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def made(seed, n, convs):
    r = random.Random(seed)
    texts = ["", " \t", "Hello there.", "Well", "Is it so?", "No!", "one more line.\nand none", "Yes. \n", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(k % convs if r.random() < 0.97 else None, r.choice([None, *range(12)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"Words {k}.") for k in range(n)]


def exhaustive(codes):
    """Every string of edits for these rows, tried as it stands."""
    best = None
    for edits in itertools.product("DKR", repeat=len(codes)):
        for puts in itertools.product(range(3), repeat=len(codes) + 1):
            state, cost, audit = tr.START, 0, ""
            for k, edit in enumerate([*edits, ""]):
                for _ in range(puts[k]):
                    state, cost, audit = tr.FOLLOWS[state], cost + 2, audit + "I"
                if not edit:
                    break
                kind, fault = divmod(codes[k], 3)
                audit += edit
                if edit == "D":
                    cost += 3
                elif fault == 2:
                    break
                elif edit == "R":
                    state, cost = tr.FOLLOWS[state], cost + 2 + fault
                elif (kind == 0 and state == 0) or (kind == 1 and state != 2) or (kind == 2 and state == 2):
                    state, cost = kind + 1, cost + fault
                else:
                    break
            else:
                pass
            if len([c for c in audit if c != "I"]) == len(codes) and not edit and state in (tr.START, tr.ASSISTANT):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_edits_equal_all_tried():
    r = random.Random(3)
    for codes in [[], *([c] for c in range(12)), *([r.randrange(12) for _ in range(r.randint(2, 4))] for _ in range(60))]:
        if not codes:
            continue
        audit, cost, states = tr.whole_audit(bytes(codes))
        close = tr.CLOSE[states[-1]]
        assert (cost + 2 * len(close), audit + close) == exhaustive(codes), codes


def test_long_rows_equal_the_plain_table():
    r = random.Random(5)
    for n in (65, 300, 1_500):
        roles, ends = ["system", "user", "assistant", "tool"], [".", "", None]
        codes = [r.randrange(12) for _ in range(n)]
        rows = [(1, k, roles[c // 3], f"x{k}" + (ends[c % 3] or "")) for k, c in enumerate(codes)]
        faults = [(None, "truncated", "blank")[c % 3] for c in codes]
        audit, cost, states = tr.whole_audit(bytes(codes))
        close = tr.CLOSE[states[-1]]
        assert (cost + 2 * len(close), audit + close) == brute(rows, faults)[:2]


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_equals_brute_force(spark, block_rows):
    schema = "conv_id long, turn long, role string, text string, digest string, block int, fault string, d int"
    for rows in (made(1, 400, 60), made(2, 300, 1), [(1, 1, "user", "Hi.")] * 30 + [(2, None, None, None)] * 3 + made(4, 90, 9)):
        df = spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], schema).repartition(3)
        assert got(tr.repair(df, damaged=True, block_rows=block_rows, most_chars=50)) == report(rows)
        assert got(tr.repair(df, block_rows=block_rows, most_chars=50)) == report(rows, damage=False)


def test_repaired_turns_are_the_edited_rows(spark):
    rows = made(7, 200, 5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = report(rows, damage=False)
    lines, audit = {}, {}
    for r in tr.repaired_turns(df, block_rows=30).orderBy("conv_id", "block", "place").collect():
        audit[r["conv_id"]] = audit.get(r["conv_id"], "") + r["edit"]
        if r["edit"] != "D":
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: w[6] for c, w in want.items()} == audit
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[7] for c, w in want.items())


def test_nothing_and_very_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tr.repair(spark.createDataFrame([], schema), damaged=True).count() == 0
    rows = [(1, k, ("user", "assistant")[k % 2], "long " * 200_000 + "end.") for k in range(12)]
    assert got(tr.repair(spark.createDataFrame(rows, schema), damaged=True)) == report(rows)
