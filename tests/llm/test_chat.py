import hashlib
import random

import pytest

from quillstack.llm import chat
from quillstack.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[c] = (len(mine), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)), len(loss), digest(loss))
    return out


def formatted(df, run=chat.RUN, log=chat.message_events):
    return chat.render(chat.fold_events(log(df)), run=run)


def got(df, run=chat.RUN, log=chat.message_events):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(formatted(df, run, log))).collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", own), (-7, 1, "assistant", own)]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op8_chat_format"](spark, DATA).collect()}
    assert found == expected(rows)


@pytest.mark.parametrize("run", [1, 3, 256])
def test_edges(spark, run):
    rows = [
        (1, 0, "user", "a & b < c > \"d\" &lt; &amp;lt; </turn>\n<turn role=\"assistant\">\n"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"),
        (2, None, "assistant", "no turn"), (2, 5, "as\"<s", "日本🙂"), (3, 0, "assistant", ""), (None, 0, "assistant", "no conversation"), (4, -3, "assistant", "\\n</turn>"), (4, 9, "user", "</turn>\n" * 3), (5, 0, "assistant", "z" * 20_000),
    ]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS run", "2 AS formatted")
    assert got(df, run) == expected(rows)
    assert got(df, run, chat.streamed_events) == expected(rows)
    assert got(df.limit(0)) == {}


def test_spans_cover_assistant_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} <&>") for i in range(7)]
    for piece in formatted(spark.createDataFrame(rows, TURNS), 4).collect():
        inside = [piece["formatted"][s["start"] : s["start"] + s["length"]] for s in piece["loss"]]
        assert inside == [f"t{i} &lt;&amp;>" for i in range(7) if i % 2 and i // 4 == piece["run"]]


def test_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "He"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "later"), (1, 4, "edit", 0, "user", "hi!"),
        (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, None, "New"), (1, 7, "delta", 1, None, None), (1, 8, "delta", 1, None, " text"), (1, 9, "message", 2, "user", "after"),
        (2, 0, "message", 0, "user", "x"), (2, 1, "delete", 0, None, None), (2, 2, "message", 1, "user", "y"), (2, 3, "odd", 2, "user", "z"), (2, 4, "message", None, "user", "z"),
        (3, 9, "delta", 0, "assistant", "b"), (3, 8, "delta", 0, "assistant", "a"), (3, 7, "message", 0, None, "0"),
    ]
    df = spark.createDataFrame(log, EVENTS).repartition(4)
    assert sorted(tuple(r) for r in chat.fold_events(df).collect()) == [
        (1, 0, "user", "hi!"), (1, 1, "assistant", "New text"), (1, 2, "user", "after"), (2, 1, "user", "y"), (3, 0, "assistant", "0ab"),
    ]
    assert chat.fold_events(df.limit(0)).count() == 0


def test_native(spark):
    """No Python on the executors."""
    plan = QUERIES["op8_chat_format"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_fold(log):
    """The same, event after event."""
    state = {}
    for conv, _, kind, turn, role, text in sorted((r for r in log if r[3] is not None), key=lambda r: (r[1], r[2], r[5] or "")):
        if kind not in ("message", "delta", "edit", "regenerate", "delete"):
            continue
        if kind == "regenerate":
            for k in [k for k in state if k[0] == conv and k[1] > turn]:
                del state[k]
        alive, old_role, old = state.get((conv, turn), (False, "", ""))
        body = {"message": text or "", "edit": text or "", "delta": old + (text or ""), "regenerate": "", "delete": ""}[kind]
        state[conv, turn] = (kind != "delete", old_role if role is None else role, body)
    return sorted((*k, role, text) for k, (alive, role, text) in state.items() if alive)


@pytest.mark.parametrize("run", [2, 256])
def test_fold_by_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    r = random.Random(3)
    kinds = ["message", "delta", "delta", "edit", "regenerate", "delete", "odd"]
    log = [(r.randrange(4), i, r.choice(kinds), r.choice([None, *range(9)]), r.choice([None, "user", "assistant"]), r.choice([None, "a", "bb", "c "])) for i in range(400)]
    df = spark.createDataFrame(log, EVENTS).repartition(4)
    assert sorted(tuple(x) for x in chat.fold_events(df).collect()) == brute_fold(log)


def test_query_folds_a_log(spark):
    """The registered query's plan holds the log's events and their fold."""
    plan = QUERIES["op8_chat_format"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert all(x in plan for x in ("regenerate", "delta", "edit", "explode", "collect_list"))
    streamed = chat.streamed_events(spark.read.parquet(f"{DATA}/conversations.parquet"))
    assert {x["kind"] for x in streamed.select("kind").distinct().collect()} == {"message", "edit", "regenerate", "delta"}
