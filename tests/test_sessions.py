"""Session logs with headers and policies; the command line."""

import json

from pyspark.sql import functions as F

from strandline import __main__ as cli
from strandline.operators import sessions
from tests.test_records import BASE


def test_session_turns(spark):
    at = "2024-01-02T03:04:05.000Z"
    say = lambda role, text, **k: {"type": "message", "timestamp": k.pop("timestamp", at), **k, "message": {"role": role, "content": text}}
    policy = lambda v: {"type": "custom", "customType": "session-policy", "data": {"capture": v}}
    log = [
        {"type": "session"},
        say("user", "one"),
        say("user", [{"type": "text", "text": "more"}]),
        say("assistant", [{"type": "toolCall", "name": "read"}], id="a0"),
        say("assistant", [{"type": "text", "text": "answer"}, {"type": "toolCall", "name": "read"}], id="a1"),
        policy("off"),
        say("user", "two"),
        say("assistant", "hidden", id="a2"),
        policy("on"),
        say("user", "three"),
        say("assistant", "no id"),
        say("user", "four"),
        say("assistant", "timed", id="a4", timestamp=None),
    ]
    rows = [("s", i, json.dumps(o)) for i, o in enumerate(log)] + [("s", 50, "{"), ("s", 51, " ")]
    rows += [("sub", 0, '{"type": "session", "parentSession": "x"}'), ("sub", 1, json.dumps(log[1])), ("sub", 2, json.dumps(log[4])), ("none", 0, json.dumps(log[1]))]
    got = sessions.session_turns(spark.createDataFrame(rows, "session string, line_no long, value string")).orderBy("turn").collect()
    assert [(r.user_content, r.assistant_result, r.turn_id, r.skip) for r in got] == [("one\n\nmore", "answer", "a1", False), ("two", "hidden", "a2", True), ("three", "no id", None, True), ("four", "timed", "a4", True)]
    assert got[0].tools == ["read"] and got[0].event_time_ms == 1704164645000


def test_session_token(spark):
    df = spark.createDataFrame([("a b/ç.x",), ("",), ("x" * 200,)], "n string").select(sessions.session_token(F.col("n")))
    assert [len(r[0]) if len(r[0]) > 20 else r[0] for r in df.collect()] == ["a-b/-.x", "session", 128]


def test_command_line(spark, tmp_path, capsys):
    root, spool = tmp_path / "journal", tmp_path / "spool"
    root.mkdir()
    spool.mkdir()
    for i, extra in enumerate([{"user_content": "where do quokkas live"}, {"turn_id": "t2", "user_content": "wombats"}]):
        (spool / f"{i}.json").write_text(json.dumps(BASE | extra))
    (spool / "bad.json").write_text("{}")
    assert cli.main(["capture", str(root), str(spool)]) == 0
    made = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert made["outcomes"] == {"published": 2, "malformed": 1} and len(made["written"]) == 2
    assert cli.main(["search", str(root), "quokkas"]) == 0
    hit = json.loads(capsys.readouterr().out.splitlines()[-1])["hits"][0]
    assert cli.main(["get", str(root), hit["episode_id"], hit["revision"]]) == 0
    assert "where do quokkas live" in json.loads(capsys.readouterr().out.splitlines()[-1])["content"]
    assert cli.main(["get", str(root), "x", "y"]) == 2
