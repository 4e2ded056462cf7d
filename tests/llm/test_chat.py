"""Formatted conversations read back, their loss and their turn order."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from clauselake.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string, segments string, state int"
NASTY = ["", None, "\\", "###", "####", "#####", "a#", "##", "</turn>", "<", "</turn", "\\### Assistant: </turn> ok", "### User: hi</turn>\n", "\\\\</turn>\n\n", "x: y", "#\\##", "<\\/turn>", "🙂 ### é", "</turn></turn>###", "\n"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], ROWS)


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "tool", "User", "role user", "", None, ": ", "a: b", "### x", "</turn>", "\\", "x:", "A\nb"]
    rows = [(i, n, role, text) for i, role in enumerate(roles) for n, text in enumerate([*NASTY, "long ## </turn> \\ " * 20_000])]
    out = chat.formatted(conversations(spark, rows)).withColumn("formatted", chat.joined(F.col("segments")))
    out = out.select("*", chat.read_back(F.col("formatted")).alias("read"), chat.learned(F.col("segments")).alias("learned"), chat.n_chars(F.col("segments")).alias("n"))
    seen = 0
    for r in out.collect():
        want = [(roles[r.conv_id] or "", text or "") for _, _, _, text in rows[: len(NASTY) + 1]]
        assert [tuple(x) for x in r.read] == want
        assert r.learned == ("".join(t for _, t in want) if roles[r.conv_id] == "assistant" else "")
        assert r.formatted.count("</turn>") == r.n_turns == len(want) and r.n == len(r.formatted)
        assert sum(s.loss for s in r.segments) == (r.n_turns if roles[r.conv_id] == "assistant" else 0)
        seen += 1
    assert seen == len(roles)


@pytest.mark.parametrize(
    "roles, valid, complete, fault",
    [("sua", 1, 1, None), ("uaua", 1, 1, None), ("u", 1, 0, None), ("su", 1, 0, None), ("s", 1, 0, None), ("a", 0, 0, 0), ("uu", 0, 0, 1), ("uas", 0, 1, 2), ("ssua", 0, 1, 1), ("uaxua", 0, 1, 2), ("saua", 0, 1, 1)],
)
def test_turn_order(spark, roles, valid, complete, fault):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    r = chat.formatted(conversations(spark, [(1, n, names[x], "t") for n, x in enumerate(roles)])).first()
    assert (r.valid, r.complete, r.fault) == (bool(valid), bool(complete), fault)


def test_order_nulls_and_repeats(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "first"), (1, 1, "user", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 1, "user", "y")]
    got = sorted((r.conv_id or 0, [x.text for x in r.read]) for r in chat.formatted(conversations(spark, rows)).select("conv_id", chat.read_back(chat.joined(F.col("segments"))).alias("read")).collect())
    assert got == [(0, ["x"]), (0, ["y"]), (1, ["first", "b", "b", "b", "c"])]
    assert chat.formatted(conversations(spark, [])).count() == 0


def test_templates_are_checked():
    fine = dict(labels={"user": "U"}, learned=(), start="b", moves={}, ends=())
    chat.Template(**fine)
    for bad in ({"close": "#"}, {"close": "##end"}, {"close": "a\\b"}, {"colon": ":#"}, {"labels": {"user": "role x"}}, {"labels": {"a": "U", "b": "U"}}, {"labels": {"a": "x: y"}}):
        with pytest.raises(ValueError):
            chat.Template(**(fine | bad))


def test_another_template(spark):
    template = chat.Template(labels={"user": "usr", "assistant": "bot"}, learned=("user",), start="0", moves={("0", "user"): "1"}, ends=("1",), head="[im ", colon="|\n", close="[/end]", other="other ")
    rows = [(1, n, "user", t) for n, t in enumerate([*NASTY, "[im", "[/end]", "a|\nb", "[", "[[/end]", "[/end"])]
    r = chat.formatted(conversations(spark, rows), template).select(chat.read_back(chat.joined(F.col("segments")), template).alias("read"), chat.learned(F.col("segments")).alias("learned")).first()
    assert [x.text for x in r.read] == [t or "" for *_, t in rows] and r.learned == "".join(x.text for x in r.read)


def test_op12(spark, small):
    rows = queries.op12_chat_format(spark, small)
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{small}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op12_chat_format"])
    assert sorted(tuple(r) for r in rows.select(*want.columns).collect()) == sorted(want.fetchall())
    by: dict = {-7: [("user", queries.ADDED), ("assistant", queries.ADDED)]}
    for i, role, text in con.sql("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        by.setdefault(i, []).append((role, text or ""))
    for r in rows.collect():
        turns = by[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
