import random

from pyspark.sql import functions as F

from quillspark.llm import chat


def conversations(n=300):
    """Questions and answers of several lines with tools and nothing said between."""
    rng = random.Random(3)
    rows = []
    for c in range(n):
        t = 0
        if rng.random() < 0.3:
            rows.append((c, t, "system", "You are a helpful assistant."))
            t += 1
        for _ in range(rng.randrange(1, 4)):
            rows.append((c, t, "user", f"How do I count the {rng.choice(['birds', 'stars', 'words'])} here?"))
            if rng.random() < 0.3:
                t += 1
                rows.append((c, t, rng.choice(["tool", "function", "developer"]), '{"found": ' + str(rng.randrange(9)) + "}"))
            t += 1
            rows.append((c, t, "assistant", "- first of all, look around.\n- then count them all, one by one, and write the number down."))
            t += 1
    return rows


def test_other_roles_are_turns(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.chat_report(df).collect()
    assert sum(r.n_turns for r in found) == len(rows) and len(found) == 300
    held = [r.same_roles for r in found if r.held_out]
    assert len(held) > 40 and sum(held) >= 0.9 * len(held)


def test_tool_markers_and_silent_speakers():
    model = chat.tables({})
    assert chat.turns(model, "User: count\nFunction: {1}\nAssistant: one\nUser: \nAssistant: still there?") == [("user", "count"), ("tool", "{1}"), ("assistant", "one"), ("user", ""), ("assistant", "still there?")]
    assert chat.turns(model, " \n \n") == []
    assert chat.render([("tool", "x")]) == "<|tool|>\nx\n<|end|>\n"


def test_every_row_counts_once(spark):
    rows = [(1, 0, "user", "a"), (1, None, "user", "b"), (1, 1, None, "c"), (1, 2, "narrator", None), (1, 2, "narrator", None), (None, None, None, None), (None, 1, "user", "x"), (2, 5000, "user", "far"), (2, 1, "assistant", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"roles": F.lit(1), "line": F.lit("clash")})
    made = chat.transcripts(df).collect()
    assert sum(len(r.roles) for r in made) == len(set(rows))
    one = next(r for r in made if r.conv_id == 1)
    assert one.roles == ["user", "user", "tool", "tool"] and all(len(r.states) == len(r.transcript.split("\n")) for r in made)
