"""Chat formatting by quotation linking, in DataFrame operations only.

Quote marks at the starts of lines give each line its level. Quoted lines, blocks and paragraphs, and all lines of a level
together, are hashed in normal form and joined to the first message that says them as a line, paragraph, run of paragraphs
or whole; a message replies to the original that its least quoted level points to. Threads are ordered so that a message
stands right before all that answers it, by an Euler tour whose places come from pointer doubling; their texts no longer
hold the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import free, materialize

#: Shortest normal form of a passage that links to another conversation even if several say it.
SHORTEST_ABROAD = 40
#: Longest run of paragraphs of an original that counts as a passage, beside its single ones and the whole message.
RUN = 32
MARKS = r"^[ \t]{0,3}((?:>[ \t]?)+)"
#: Fixed value: a line that only says who is quoted below.
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.{0,300}(?:wrote|schrieb|a écrit|escribió).{0,80}:\s*$"


def normal(text: Column) -> Column:
    """Lower case; letters and digits, with one space for each run of anything else."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _join(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["body"]), "\n")


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `lines` (array of level, body), `own` (the text without quotes) and `n_quoted` (quoted lines).

    A text without quoted lines is its own, unchanged; null counts as empty. A line of attribution goes with the quote
    that starts right below it, at any level.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))

    out = messages.withColumn("_all", F.transform(F.split(text, r"\r\n|\r|\n"), line))
    announces = lambda x, i: x["body"].rlike(ATTRIBUTION) & F.coalesce(F.get(F.col("_all"), i + 1)["level"] > x["level"], F.lit(False))
    out = out.withColumn("lines", F.filter("_all", lambda x, i: ~announces(x, i))).drop("_all")
    out = out.withColumn("n_quoted", F.size(F.filter("lines", lambda x: x["level"] > 0)))
    own = F.filter("lines", lambda x: x["level"] == 0)
    return out.withColumn("own", F.when(F.col("n_quoted") == 0, text).otherwise(F.regexp_replace(_join(own), r"^\s+|\s+$", "")))


def _cut_at(lines: Column, begins) -> Column:
    """array<array<line>>: the lines in pieces; begins(line, the one before) says where a piece starts."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | begins(x, F.get(lines, i - 1)), i + 1)), lambda i: i.isNotNull())
    return F.transform(starts, lambda a, k: F.slice(lines, a, F.coalesce(F.get(starts, k + 1), F.size(lines) + 1) - a))


def _blank(x: Column) -> Column:
    return F.trim(x["body"]) == ""


def _passages(lines: Column, begins) -> Column:
    return F.transform(_cut_at(lines, begins), lambda p: F.struct(F.get(p, 0)["level"].alias("level"), normal(_join(p)).alias("norm")))


def _units(lines: Column, levels: Column, least: int) -> Column:
    """array<struct<level, norm>>: from level `least` on each line, each block of a level and each paragraph of a block; and all lines of each level together."""
    kept = F.filter(lines, lambda x: x["level"] >= least)
    alone = F.transform(kept, lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("norm")))
    whole = F.transform(levels, lambda k: F.struct(k.alias("level"), normal(_join(F.filter(lines, lambda x: x["level"] == k))).alias("norm")))
    blocks = _passages(lines, lambda x, y: x["level"] != y["level"])
    paragraphs = _passages(lines, lambda x, y: (x["level"] != y["level"]) | (_blank(x) != _blank(y)))
    parts = F.filter(F.concat(blocks, paragraphs), lambda u: u["level"] >= least)
    return F.array_distinct(F.filter(F.concat(alone, whole, parts), lambda u: u["norm"] != ""))


def _runs(lines: Column) -> Column:
    """array<string>: the normal forms of all runs of up to RUN paragraphs."""
    paragraphs = F.filter(F.transform(_cut_at(lines, lambda x, y: _blank(x) != _blank(y)), lambda p: normal(_join(p))), lambda n: n != "")
    n = F.size(paragraphs)
    longest = lambda i: F.least(F.lit(RUN), n - i)
    runs = F.transform(paragraphs, lambda _, i: F.transform(F.sequence(F.lit(1), longest(i)), lambda k: F.array_join(F.slice(paragraphs, i + 1, k), " ")))
    return F.flatten(runs)


def link(messages: DataFrame) -> DataFrame:
    """conv, turn, digest and the original (conv, turn) of every message whose quotes were found.

    messages: conv, turn, digest (of role and text), lines, own. The original is the first message with the passage in
    the same conversation and before it; failing that the first one elsewhere, at any turn: turns of two conversations have no
    order. A passage of fewer than SHORTEST_ABROAD characters counts elsewhere only if one other conversation alone says it. Of a cycle that so arises the least message replies to nothing. Of several originals the
    one of the least quote level counts, then the one with more quoted characters, then the earliest.
    """
    known = messages.where("conv is not null and turn is not null")
    quoting = known.where("n_quoted > 0")
    levels = F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))
    quotes = quoting.withColumn("levels", levels).select("conv", "turn", "digest", F.explode(_units(F.col("lines"), F.col("levels"), 1)).alias("u"))
    quotes = quotes.select("conv", "turn", "digest", "u.level", F.length("u.norm").alias("size"), F.unhex(F.md5(F.col("u.norm").cast("binary"))).alias("hash"))
    own = known.where("own <> ''").withColumn("own_lines", F.transform(F.split("own", r"\r\n|\r|\n"), lambda x: F.struct(F.lit(0).alias("level"), x.alias("body"))))
    said = own.select("conv", "turn", F.explode(F.array_distinct(F.concat(_units(F.col("own_lines"), F.array(F.lit(0)), 0)["norm"], _runs(F.col("own_lines"))))).alias("norm"))
    said = said.select("conv", "turn", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("hash"))
    # First sayers only, by a partial minimum: a passage that everybody repeats has one original for each conversation.
    here = materialize(said.groupBy("conv", "hash").agg(F.min("turn").alias("o_turn")), "quotes-here")
    first_of = lambda df: df.groupBy("hash").agg(F.min(F.struct("o_turn", "conv")).alias("f"), F.count("*").alias("n"))
    first = materialize(first_of(here), "quotes-first")
    # The first of another conversation too, for the quotes in the conversation of the first.
    second = first_of(here.join(first.where("n > 1").select("hash", "f"), "hash").where("conv <> f.conv").select("conv", "hash", "o_turn")).select("hash", F.col("f").alias("g"))
    anywhere = first.join(second, "hash", "left")
    sayer = lambda x, other: F.struct(x["conv"].alias("conv"), x["o_turn"].alias("turn"), other["conv"].alias("other"))
    both = F.filter(F.array(sayer(F.col("f"), F.col("g")), sayer(F.col("g"), F.col("f"))), lambda x: x["conv"].isNotNull())
    anywhere = materialize(anywhere.select("hash", "n", F.explode(both).alias("s")).select("hash", "n", F.col("s.conv").alias("o_conv"), F.col("s.turn").alias("o_turn"), F.col("s.other").alias("besides")), "quotes-anywhere")
    quotes = materialize(quotes, "quotes")
    near = quotes.join(here, ["conv", "hash"]).where("o_turn < turn").select("conv", "turn", "digest", "level", "size", F.lit(0).alias("abroad"), F.col("conv").alias("o_conv"), "o_turn")
    only = (F.col("n") == 1) | ((F.col("n") == 2) & (F.col("besides") == F.col("conv")))
    far = quotes.join(anywhere, "hash").where("o_conv <> conv").where((F.col("size") >= SHORTEST_ABROAD) | only)
    far = far.select("conv", "turn", "digest", "level", "size", F.lit(1).alias("abroad"), "o_conv", "o_turn")
    votes = near.union(far).groupBy("conv", "turn", "digest", "abroad", "level", "o_conv", "o_turn").agg(F.sum("size").alias("size"))
    rank = F.struct("abroad", "level", -F.col("size"), "o_turn", "o_conv")
    found = votes.groupBy("conv", "turn", "digest").agg(F.min_by(F.struct("o_conv", "o_turn"), rank).alias("o")).select("conv", "turn", "digest", "o.o_conv", "o.o_turn")
    return without_cycles(materialize(found, "quotes-found"))


def _parents(links: DataFrame) -> DataFrame:
    """conv, turn, a_conv, a_turn: of messages that share conv and turn the least original counts."""
    return links.groupBy("conv", "turn").agg(F.min(F.struct("o_turn", "o_conv")).alias("o")).select("conv", "turn", F.col("o.o_conv").alias("a_conv"), F.col("o.o_turn").alias("a_turn"))


def without_cycles(links: DataFrame) -> DataFrame:
    """The links without those of the least message of each cycle.

    Pointers double and those that reach an end fall out; after as many steps as there are links only what leads into a cycle is
    left, and its pointers stand on the cycle with the least message of it.
    """
    if links.where("o_conv <> conv and o_turn >= turn").isEmpty():
        return links
    walk = materialize(_parents(links).withColumn("low", F.struct("turn", "conv")), "quotes-walk")
    steps, most = 1, walk.count()
    over = lambda w: w.select(F.col("conv").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("a_conv").alias("b_conv"), F.col("a_turn").alias("b_turn"), F.col("low").alias("b_low"))
    while steps <= most:
        new = materialize(walk.join(over(walk), ["a_conv", "a_turn"]).select("conv", "turn", F.col("b_conv").alias("a_conv"), F.col("b_turn").alias("a_turn"), F.least("low", "b_low").alias("low")), "quotes-walk")
        free(walk)
        walk, steps = new, 2 * steps
        if walk.isEmpty():
            return links
    cut = walk.join(over(walk), ["a_conv", "a_turn"]).select(F.col("b_low.conv").alias("conv"), F.col("b_low.turn").alias("turn")).distinct()
    return links.join(cut, ["conv", "turn"], "left_anti")


def depths(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """conv, turn, root_conv, root_turn and depth of every message that replies, by pointer doubling.

    The links have no cycles (see without_cycles); rounds grow with the logarithm of the depth. Of messages that share conv and
    turn the least original counts.
    """
    paths = materialize(_parents(links).withColumn("depth", F.lit(1)), "quotes-paths")
    for _ in range(most_rounds):
        over = paths.select(F.col("conv").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("a_conv").alias("b_conv"), F.col("a_turn").alias("b_turn"), F.col("depth").alias("more"))
        new = paths.join(over, ["a_conv", "a_turn"], "left").select("conv", "turn", F.coalesce("b_conv", "a_conv").alias("a_conv"), F.coalesce("b_turn", "a_turn").alias("a_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"))
        new = materialize(new, "quotes-paths")
        free(paths)
        paths = new.drop("moved")
        if new.where("moved").isEmpty():
            return paths.select("conv", "turn", F.col("a_conv").alias("root_conv"), F.col("a_turn").alias("root_turn"), "depth")
    raise RuntimeError("reply chains did not end")


def _siblings(parents: DataFrame) -> DataFrame:
    """conv, turn, n_conv, n_turn: the next answer to the same message, by turn, of those that have one.

    The answers are sorted as a whole, so that very many to one message are not one task's.
    """
    kids = parents.orderBy("a_conv", "a_turn", "turn", "conv").withColumn("at", F.monotonically_increasing_id())
    kids = materialize(kids, "quotes-kids")
    # A row for each partition of the sort: where it ends, and where the next one begins.
    ends = kids.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("at"))
    ends = ends.select("at", F.lead("first").over(Window.orderBy("part")).alias("following"))
    follow = kids.join(ends, "at", "left").withColumn("following", F.coalesce("following", F.col("at") + 1))
    after = kids.select(F.col("at").alias("following"), F.col("conv").alias("n_conv"), F.col("turn").alias("n_turn"), F.col("a_conv").alias("p_conv"), F.col("a_turn").alias("p_turn"))
    return follow.join(after, "following").where("a_conv = p_conv and a_turn = p_turn").select("conv", "turn", "n_conv", "n_turn")


def places(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """conv, turn and place of the messages that reply or are replied to: within a thread a message comes before its answers,
    and these, with all their own, follow each other by turn.

    The Euler tour of a thread goes into each message and out of it again; how far a step is from the end of its tour comes
    from pointer doubling, so that rounds grow with the logarithm of a thread's size and rows do not grow at all.
    """
    parents = materialize(_parents(links), "quotes-parents")
    heads = parents.groupBy(F.col("a_conv").alias("conv"), F.col("a_turn").alias("turn")).agg(F.min(F.struct("turn", "conv")).alias("kid"))
    nodes = parents.select("conv", "turn").union(parents.select("a_conv", "a_turn")).distinct()
    step = lambda conv, turn, out: F.struct(conv.alias("conv"), turn.alias("turn"), F.lit(out).alias("out"))
    conv, turn = F.col("conv"), F.col("turn")
    into = nodes.join(heads, ["conv", "turn"], "left").select(step(conv, turn, 0).alias("x"), F.when(F.col("kid").isNull(), step(conv, turn, 1)).otherwise(step(F.col("kid.conv"), F.col("kid.turn"), 0)).alias("next"))
    leave = nodes.join(parents, ["conv", "turn"], "left").join(_siblings(parents), ["conv", "turn"], "left")
    up = F.when(F.col("a_conv").isNotNull(), step(F.col("a_conv"), F.col("a_turn"), 1))
    leave = leave.select(step(conv, turn, 1).alias("x"), F.when(F.col("n_conv").isNotNull(), step(F.col("n_conv"), F.col("n_turn"), 0)).otherwise(up).alias("next"))
    tour = materialize(into.union(leave).withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "quotes-tour")
    for _ in range(most_rounds):
        if tour.where("next is not null").isEmpty():
            return tour.where("x.out = 0").select("x.conv", "x.turn", (-F.col("left")).alias("place"))
        over = tour.select(F.col("x").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        new = tour.join(over, "next", "left").select("x", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        new = materialize(new, "quotes-tour")
        free(tour)
        tour = new
    raise RuntimeError("threads did not end")


def threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes, a row for every message.

    conv_id, turn, role, text (without quotes), n_quoted (lines taken out), reply_conv and reply_turn (null: no reply),
    thread_conv and thread_turn (the message the thread starts with), depth (0: starts a thread) and place (0 at a thread's
    start, then growing). Rows are sorted by thread and place, over all partitions: a message, then its first answer with all
    that follows from it, then the next answer. A null text counts as empty; a message with a null conversation or turn
    links nowhere; repeated rows are kept each and link alike. No rows give no rows; other columns are ignored.
    """
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    base = base.withColumn("digest", F.xxhash64("role", "text"))
    parsed = parse(base)
    links = materialize(link(parsed), "quotes-links")
    up = depths(links)
    order = places(links)
    start = up.where("depth = 1").select("root_conv", "root_turn").distinct()
    starts = order.join(start, (F.col("conv") == F.col("root_conv")) & (F.col("turn") == F.col("root_turn"))).select("root_conv", "root_turn", F.col("place").alias("zero"))
    out = parsed.select("conv", "turn", "role", "digest", F.col("own").alias("text"), "n_quoted")
    out = out.join(links, ["conv", "turn", "digest"], "left").join(up, ["conv", "turn"], "left").join(order, ["conv", "turn"], "left")
    out = out.withColumns({"root_conv": F.coalesce("root_conv", "conv"), "root_turn": F.coalesce("root_turn", "turn")}).join(starts, ["root_conv", "root_turn"], "left")
    out = out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quoted", F.col("o_conv").alias("reply_conv"), F.col("o_turn").alias("reply_turn"),
        F.col("root_conv").alias("thread_conv"), F.col("root_turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce(F.col("place") - F.col("zero"), F.lit(0)).alias("place"),
    )
    return out.orderBy("thread_conv", "thread_turn", "place", "conv_id", "turn", "role", "text")
