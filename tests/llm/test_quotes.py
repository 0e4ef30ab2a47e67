from docledger.llm import quotes

SAID = "We should move the meeting\nto Friday.\n\nThe hall is booked\nuntil noon then.\n\nPlease bring the maps\nof the harbour."
LONG = "the harbour office opens its doors at nine every morning"


def links(spark, rows):
    got = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return {(r.conv_id, r.turn): ((r.reply_conv, r.reply_turn), r.depth) for r in got}


def test_inline_answers(spark):
    rows = [(1, 0, "a", SAID), (1, 1, "b", "> We should move the\n> meeting to Friday.\n\nFine.\n\n> Please bring\n> the maps of\n> the harbour.\n\nGladly.")]
    rows += [(2, 0, "a", SAID), (2, 1, "b", "> The hall is\n> booked until\n> noon then. Please\n> bring the maps of the harbour.\n\nYes.")]  # two of three paragraphs, rewrapped
    rows += [(3, 0, "a", "Are you\nthere now?"), (3, 1, "b", "Where did\nyou go then?"), (3, 2, "c", "> Are you there\n> now?\n\nI am.\n\n> Where did you\n> go then?\n\nHome.")]
    got = links(spark, rows)
    assert got[1, 1] == ((1, 0), 1) and got[2, 1] == ((2, 0), 1) and got[3, 2][0] in ((3, 0), (3, 1))


def test_other_conversations(spark):
    rows = [(1, 0, "a", "hello there"), (1, 1, "b", LONG), (2, 0, "c", f"> {LONG}\n\nForwarded to you.")]
    assert links(spark, rows)[2, 0] == ((1, 1), 1)
    other = "nobody has seen the keeper of the old lighthouse"
    cycle = [(5, 3, "a", f"> {other}\n\n{LONG}"), (6, 3, "b", f"> {LONG}\n\n{other}"), (7, 0, "c", f"> {other}\n\nnews?")]
    got = links(spark, cycle)
    assert got[5, 3] == ((None, None), 0) and got[6, 3] == ((5, 3), 1) and got[7, 0] == ((6, 3), 2)
