import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd

from reviewlab.llm import dialogue as D
from reviewlab.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault), by trying every edit with up to two insertions before and after each."""
    best = None
    n = len(rows)
    for edits in itertools.product("KRD", repeat=n):
        if any(f in "bd" and e != "D" for (_, _, f), e in zip(rows, edits)):
            continue
        for inserts in itertools.product(range(3), repeat=n + 1):
            if sum(inserts) > n + 2:
                continue
            word, cost = "", 0
            slots = []
            for i in range(n + 1):
                word += "I" * inserts[i]
                cost += 2 * inserts[i]
                slots += [("I", "", "")] * inserts[i]
                if i < n:
                    word += edits[i]
                    cost += {"K": 0, "R": 2, "D": 3}[edits[i]] + (edits[i] != "D" and rows[i][2] == "t")
                    if edits[i] != "D":
                        slots.append((edits[i], *rows[i][:2]))
            if best is not None and (cost, word) >= best[:2]:
                continue
            led = bool(slots) and slots[0][0] == "K" and slots[0][1][:1] == "s"
            lines, good = [], len(slots) == 0 or (len(slots) - led) % 2 == 0 and len(slots) > led
            for p, (e, role, text) in enumerate(slots):
                due = "s" if led and p == 0 else "ua"[(p - led) % 2]
                good &= e != "K" or role[:1] == due
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant', 's': ''}[due]}:{text}")
            if good:
                best = (cost, word, lines)
    return best


def expected(rows, conv):
    own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, marked = set(), []
    for _, _, role, text in own:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        marked.append((role, text, "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "k"))
        seen.add((role, text))
    turns = {r[1] for r in own} - {None}
    cost, word, lines = cheapest(marked)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(marked)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(m[2] == f for m in marked) for f in "bdt"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, word, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def odd_rows():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "Why? \n", "open", "open ", "", " \t", "Yes.", None, "long " * 400 + "end."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randrange(0, 5)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None, 1]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ubot"]), rnd.choice(texts)))
    return rows


def test_repair_against_every_edit(spark):
    rows = odd_rows()
    kept = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", fault int, seen string").repartition(3)
    found = D.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    lines = {}
    for conv in got:
        want, lines[conv] = expected(kept, conv)
        assert got[conv] == want, conv
    texts = {}
    for r in D.repaired(df, found).orderBy("conv_id", "position").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert texts == {c: x for c, x in lines.items() if x}


def test_query_against_every_edit_and_sql(spark, tmp_path):
    rows = [r for r in odd_rows() if r[2] is None or len(r[2]) != 1]
    rows += [(1000 + i, 0, "user", "Alone.") for i in range(40)]  # some are dropped whole
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    hurt = damaged(rows)
    assert len({r[0] for r in hurt}) < len(got)
    for conv in got:
        assert got[conv] == expected(hurt, conv)[0], conv
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(ORACLE["op11_conversation_repair"]).fetchall()} == got


def test_spilled_backpointers_and_batches(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(7, i, rnd.choice(["user", "assistant", "system"]), f"Turn {i}{rnd.choice(['.', ''])}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = D.repair(df).collect()
    monkeypatch.setattr(D, "AT_ONCE", 64)
    monkeypatch.setattr(D, "HELD", 256)
    batches = [pd.DataFrame([(str(c), True, str(t), r, x, "k" if x.endswith(".") else "t") for c, t, r, x in rows[i:i + 7]],
                            columns=["conv", "present", "turn", "role", "text", "fault"]) for i in range(0, len(rows), 7)]
    parts = pd.concat(D.streamed(iter(batches)))
    assert parts.drop(columns="conv").values.tolist() == [list(r)[1:] for r in whole]
    assert len(whole[0].audit.replace("I", "")) == 3000


def test_no_rows(spark):
    assert D.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    assert D.step.cache_info().currsize < 2000
