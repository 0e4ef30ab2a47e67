"""Threads against brute force: linking, cycles and reply order in plain loops over generated conversations."""

import random
import re
from itertools import groupby

import pytest
import regex
from pyspark.sql import functions as F

from docledger.llm import quotes

LINES = ["yes", "ok then", "see you", "the weather is fine", "a line that is long enough to be known abroad, at once", "numbers 1 2 3", "what about the other plan that we had", "Thanks!"]


def norm(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()


def parse(text):
    out = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        m = re.match(r"[ \t]{0,3}((?:>[ \t]?)+)", line)
        out.append((m.group(1).count(">") if m else 0, line[m.end() :] if m else line))
    says = re.compile(r"(?i)^\s*(?:on|am|le|el)\b.{0,300}(?:wrote|schrieb|a écrit|escribió).{0,80}:\s*$")
    return [x for i, x in enumerate(out) if not (says.match(x[1]) and i + 1 < len(out) and out[i + 1][0] > x[0])]


def passages(lines):
    """(level, normal form) of lines, of all lines of a level, of blocks and of paragraphs."""
    found = {(k, norm(t)) for k, t in lines}
    found |= {(k, norm("\n".join(t for j, t in lines if j == k))) for k, _ in lines}
    for key in (lambda x: x[0], lambda x: (x[0], not x[1].strip(" "))):
        for _, run in groupby(lines, key):
            run = list(run)
            found.add((run[0][0], norm("\n".join(t for _, t in run))))
    return {x for x in found if x[1]}


def brute(messages):
    """{(conv, turn): (original, root, depth)} and the messages of each thread in reply order."""
    said, own = {}, {}
    for conv, turn, text in messages:
        lines = parse(text)
        own[conv, turn] = "\n".join(t for k, t in lines if k == 0).strip() if any(k for k, _ in lines) else text or ""
        if own[conv, turn]:
            plain = [(0, x) for x in re.split(r"\r\n|\r|\n", own[conv, turn])]
            units = {n for _, n in passages(plain)}
            paragraphs = [norm("\n".join(t for _, t in run)) for _, run in groupby(plain, lambda x: not x[1].strip(" "))]
            paragraphs = [p for p in paragraphs if p]
            units |= {" ".join(paragraphs[i:j]) for i in range(len(paragraphs)) for j in range(i + 1, min(len(paragraphs), i + 32) + 1)}
            for n in units:
                said.setdefault(n, {}).setdefault(conv, turn)
                said[n][conv] = min(said[n][conv], turn)
    up = {}
    for conv, turn, text in messages:
        votes = {}
        for level, n in [p for p in passages(parse(text)) if p[0] > 0]:
            sayers = said.get(n, {})
            if conv in sayers and sayers[conv] < turn:
                votes[0, level, conv, sayers[conv]] = votes.get((0, level, conv, sayers[conv]), 0) + len(n)
            by = sorted((t, c) for c, t in sayers.items())[:2]
            others = [c for c in sayers if c != conv]
            for t, c in by:
                if c != conv and (len(n) >= 40 or len(others) == 1):
                    votes[1, level, c, t] = votes.get((1, level, c, t), 0) + len(n)
        if votes:
            best = min((a, k, -size, t, c) for (a, k, c, t), size in votes.items())
            up[conv, turn] = best[4], best[3]
    cut = set()
    for x in up:
        seen, y = [], x
        while y in up and y not in seen:
            seen.append(y)
            y = up[y]
        if y in seen:
            cut.add(min(seen[seen.index(y) :], key=lambda m: (m[1], m[0])))
    up = {x: y for x, y in up.items() if x not in cut}
    kids = {}
    for x, y in up.items():
        kids.setdefault(y, []).append(x)
    order = {}

    def visit(x, root, depth):
        order.setdefault(root, []).append(x)
        for k in sorted(kids.get(x, []), key=lambda m: (m[1], m[0])):
            visit(k, root, depth + 1)

    for conv, turn, _ in messages:
        if (conv, turn) not in up:
            visit((conv, turn), (conv, turn), 0)
    return up, order, own


def generated(rng, n_conv, n_turns):
    messages, texts = [], {}
    for conv in range(n_conv):
        for turn in range(n_turns):
            text = []
            while texts and len(text) < 12 and rng.random() < 0.75:
                c, t = rng.choice([x for x in texts if x[0] == conv] or list(texts)) if rng.random() < 0.8 else rng.choice(list(texts))
                if rng.random() < 0.3:
                    text.append("On Monday X wrote:")
                old = texts[c, t].split("\n")
                i = rng.randrange(len(old))
                text += [rng.choice(["> ", ">", " > "]) + x for x in old[i : i + rng.randrange(1, 5)]]
                text += rng.choice([[], ["my answer %d" % rng.randrange(40)], [""]])
            text += [rng.choice(LINES) if rng.random() < 0.6 else f"fresh words {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.4:
                text.insert(rng.randrange(len(text)), "")
            texts[conv, turn] = "\n".join(text)
            messages.append((conv, turn, texts[conv, turn]))
    for i in range(4):  # conversations that quote each other
        messages += [(100 + i, 5, f"> the sentence number {(i + 1) % 4} that only one conversation says\nthe sentence number {i} that only one conversation says")]
    return messages


@pytest.mark.parametrize("seed, n_conv, n_turns", [(1, 6, 8), (2, 3, 25)])
def test_threads_against_brute_force(spark, seed, n_conv, n_turns):
    messages = generated(random.Random(seed), n_conv, n_turns)
    up, order, own = brute(messages)
    assert len(up) > len(messages) // 3
    got = quotes.threads(spark.createDataFrame([(c, t, "u", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in got} == {(c, t): up.get((c, t), (None, None)) for c, t, _ in messages}
    assert {(r.conv_id, r.turn): r.text for r in got} == own
    rows = {}
    for r in got:
        rows.setdefault((r.thread_conv, r.thread_turn), []).append((r.conv_id, r.turn))
    assert rows == order
    assert [(r.thread_conv, r.thread_turn, r.place) for r in got] == sorted((r.thread_conv, r.thread_turn, r.place) for r in got) and {r.place for r in got if r.depth == 0} == {0}


def test_hot_passage_long_text_and_many_levels(spark):
    """A passage that all quote, one message of very many lines, quotes of 60 levels, a long chain of replies, and clashing columns."""
    rows = [(1, 0, "u", "everybody quotes this line")] + [(1, t, "u", f"> everybody quotes this line\nme too {t}") for t in range(1, 300)]
    rows += [(2, 0, "u", "\n".join(f"line {i} of a long text" for i in range(20_000))), (2, 1, "u", "> line 19999 of a long text\nindeed")]
    rows += [(3, t, "u", "\n".join([">" * (t - k) + f" said at {k} in three" for k in range(t)] + [f"said at {t} in three"])) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("place", "hash", "lines", "own", "n", "f", "at")])
    got = {(r.conv_id, r.turn): r for r in quotes.threads(df).collect()}
    assert all((got[1, t].reply_conv, got[1, t].reply_turn, got[1, t].depth) == (1, 0, 1) for t in range(1, 300)) and (got[2, 1].reply_conv, got[2, 1].reply_turn) == (2, 0)
    assert [got[3, t].depth for t in range(60)] == list(range(60)) and [got[3, t].place for t in range(60)] == list(range(60))
