import random

import duckdb
import pandas as pd
import pytest

from winnow.llm import quotes

ROWS = [
    (1, 0, "u", "Hello there friend\nHow are you today?"),
    (1, 1, "a", "On Monday, X wrote:\n> Hello there friend\n> How are you today?\nFine thanks."),
    (1, 2, "u", "> > How are   you today?\n> Fine thanks.\nGreat!"),
    (1, 5, "a", "> hello THERE friend\n\nLate reply"),
    (1, 5, "a", "> hello THERE friend\n\nLate reply"),
    (2, 0, "u", "> Great!\nQuoted elsewhere"),
    (2, 1, "a", None),
    (2, 2000, "u", ""),
    (None, None, None, "> nothing known\nx"),
]


SCHEMA = "conv_id long, turn long, role string, text string"


def replies(spark, rows):
    return {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def same_as_sql(spark, rows):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = [d[0] for d in con.execute(quotes.CONVERSATIONS_SQL).description]
    want = con.execute(quotes.CONVERSATIONS_SQL).fetchall()
    got = [tuple(r[n] for n in names) for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as mid", "1 as depth", "2 as level")


def test_replies(messages):
    rows = quotes.conversations(messages).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    reply = {k: (r["reply_conv"], r["reply_turn"], r["root_conv"], r["root_turn"], r["depth"]) for k, r in got.items()}
    assert reply == {
        (1, 0): (None, None, 1, 0, 0),
        (1, 1): (1, 0, 1, 0, 1),
        (1, 2): (1, 1, 1, 0, 2),
        (1, 5): (1, 0, 1, 0, 1),
        (2, 0): (1, 2, 1, 0, 3),
        (2, 1): (2, 0, 1, 0, 4),
        (2, 2000): (2, 1, 1, 0, 5),
        (None, None): (None, None, None, None, 0),
    }
    assert {k: r["text"] for k, r in got.items()} == {
        (1, 0): "Hello there friend\nHow are you today?",
        (1, 1): "Fine thanks.",
        (1, 2): "Great!",
        (1, 5): "Late reply",
        (2, 0): "Quoted elsewhere",
        (2, 1): "",
        (2, 2000): "",
        (None, None): "x",
    }
    assert got[1, 5]["copies"] == 2 and got[1, 2]["linked_words"] == 6 and got[None, None]["linked_words"] == 0
    place = {(r["conv_id"], r["turn"]): i for i, r in enumerate(rows)}
    assert all(r["reply_turn"] is None or place[r["reply_conv"], r["reply_turn"]] < place[k] for k, r in got.items())


def test_no_circles(spark):
    rows = [(1, 0, "u", "> b\na"), (2, 0, "u", "> a\nb"), (1, 1, "u", "> c\nd"), (1, 2, "u", "> d\nc")]
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (None, None), (2, 0): (1, 0), (1, 1): (1, 0), (1, 2): (1, 1)}


def test_empty(messages):
    assert quotes.conversations(messages.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    same_as_sql(spark, ROWS)


def test_line_breaks_play_no_part(spark):
    said = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, 0, "u", said),
        (1, 1, "a", "something else"),
        (1, 2, "u", "> one two three four\n>\n> five six\tseven\n\n> EIGHT nine\n> ten eleven\nyes"),
        (1, 3, "a", "> four five six seven\n> eight\nin part"),
        (1, 4, "u", "> words that nobody wrote here\nno"),
    ]
    assert replies(spark, rows) == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 0), (1, 4): (1, 3)}
    linked = {r["turn"]: r["linked_words"] for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert linked == {0: 0, 1: 0, 2: 11, 3: 5, 4: 0}


def test_common_lines_do_not_decide(spark):
    rows = [
        (1, 0, "u", "Hi,\nwhat is new"),
        (1, 1, "a", "Hi,\nnot much"),
        (1, 2, "u", "Hi,\nYes, do that"),
        (1, 3, "a", "Hi,\nlater then"),
        (1, 4, "u", "> Hi,\n> Yes, do that\nthanks"),
        (1, 5, "a", "> Hi,\nhello\n> Yes, do that\nok"),
        (1, 6, "u", "> Hi,\nthe nearest of equals"),
    ]
    assert replies(spark, rows) == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (1, 4): (1, 2), (1, 5): (1, 2), (1, 6): (1, 3)}


def test_windows_that_many_wrote(spark, monkeypatch):
    """Beyond COMMON writers the nearest counts, over buckets of turns too; a line of one writer still decides."""
    rows = [(1, t, "u", "so it goes" + (" and one more word here" if t == 10 else "")) for t in range(quotes.COMMON + 10)]
    rows += [(1, 5000, "a", "> so it goes\nfar"), (1, 5001, "a", "> so it goes\nnear"), (1, 40000, "a", "> so it goes and one more word here\nten")]
    rows += [(1, 5000, "u", "> so it goes\nanother of this turn"), (1, 6000, "u", "so it goes"), (1, 6000, "a", "> so it goes\nstrictly before"), (2, 0, "u", "> so it goes\nelsewhere")]
    got = replies(spark, rows)
    last = quotes.COMMON + 9
    assert got[1, 5000] == got[1, 5001] == (1, last) and got[1, 40000] == (1, 10) and got[2, 0] == (1, 0)
    same_as_sql(spark, rows)


def test_common_windows_count_for_all_their_writers(spark):
    """Two common windows point to the message that wrote both, though others that wrote one of them are nearer."""
    rows = [(1, t, "u", "so it goes\nand on") for t in range(40)] + [(1, 40 + t, "u", "so it goes") for t in range(40)] + [(1, 80 + t, "u", "well\nand on") for t in range(40)]
    rows += [(1, 90, "u", "so it goes\nrare words"), (1, 6000, "a", "> so it goes\n\nx\n> and on\nboth"), (1, 6001, "a", "> so it goes\n\nx\n> rare words\nrare")]
    got = replies(spark, rows)
    assert got[1, 6000] == (1, 39) and got[1, 6001] == (1, 90)
    same_as_sql(spark, rows)


def test_any_common_messages_against_sql(spark, monkeypatch):
    """With nearly every window a common one, the same as SQL, which knows no such bound."""
    monkeypatch.setattr(quotes, "COMMON", 2)
    rng = random.Random(11)
    rows = []
    for _ in range(300):
        lines = [rng.choice(["", "", "> ", ">> "]) + " ".join(rng.choices("a b c d".split(), k=rng.choice([1, 2, 3, 6]))) for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice([1, 1, 2, None]), rng.choice([*range(25), 1500, 3000, None]), rng.choice("ua"), "\n".join(lines)))
    same_as_sql(spark, rows)


def test_any_messages_against_sql(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        lines = [rng.choice(["", "", "> ", ">> ", " >\t> "]) + " ".join(rng.choices("a b c d E f".split(), k=rng.choice([0, 1, 2, 3, 7, 12]))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), 3000, None]), rng.choice("ua"), "\n".join(lines)))
    got = same_as_sql(spark, rows + rows[:5])
    assert len(got) > 300


def test_long_text(spark):
    text = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, 0, "u", text), (1, 1, "a", "x"), (1, 2, "u", "> " + text.replace(" w5", "\n>w5") + "\nall of it")]
    assert replies(spark, rows)[1, 2] == (1, 0)
