"""Conversations repaired to a legal order of roles at the least cost, and rendered.

Legal: at most one system turn, first; then user and assistant in turn, user first, assistant last. Dynamic programming over this automaton
chooses for each turn to keep it, relabel it or merge it into the turn before, and where to insert empty turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: To merge a turn into one of its own role, to relabel it (a merge into another role relabels too), to insert an empty one.
MERGE, RELABEL, INSERT = 1, 3, 4
#: The automaton: which roles may follow which ("" is the start); a conversation may end after an assistant.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LAST = "assistant"
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def plan(roles: tuple[str, ...]) -> tuple[int, list[tuple[str, list[int]]]]:
    """The least cost, and the repaired turns: role and which of the given turns are in it (none: inserted). Ties are
    always broken alike: turns are taken one by one, states by cost and then as in ROLES, a turn of its own before a merge, and what is
    found first stays. No turns: cost 0, no turns."""
    if not roles:
        return 0, []
    big = 1 << 60
    # best[state] after some turns: cost and a chain (previous, role, source)
    best: dict[str, tuple[int, tuple | None]] = {"": (0, None)}

    def insert(b: dict) -> dict:
        # an inserted turn never helps twice in a row beyond a whole round, so two steps close it
        b = dict(b)
        for _ in range(2):
            for state, (cost, chain) in sorted(b.items(), key=lambda x: (x[1][0], ROLES.index(x[0]) if x[0] else -1)):
                for r in NEXT[state]:
                    if cost + INSERT < b.get(r, (big, None))[0]:
                        b[r] = (cost + INSERT, (chain, r, None))
        return b

    for i, role in enumerate(roles):
        new: dict[str, tuple[int, tuple | None]] = {}
        for state, (cost, chain) in sorted(insert(best).items(), key=lambda x: (x[1][0], ROLES.index(x[0]) if x[0] else -1)):
            for r in NEXT[state]:
                c = cost + (0 if r == role else RELABEL)
                if c < new.get(r, (big, None))[0]:
                    new[r] = (c, (chain, r, i))
        for state, (cost, chain) in sorted(best.items(), key=lambda x: (x[1][0], ROLES.index(x[0]) if x[0] else -1)):
            if state:
                c = cost + MERGE + (0 if state == role else RELABEL)
                if c < new.get(state, (big, None))[0]:
                    new[state] = (c, (chain, "", i))
        best = new
    cost, chain = insert(best)[LAST]
    turns: list[tuple[str, list[int]]] = []
    steps = []
    while chain:
        chain, r, i = chain
        steps.append((r, i))
    for r, i in reversed(steps):
        if r:
            turns.append((r, [] if i is None else [i]))
        else:
            turns[-1][1].append(i)
    return cost, turns


def escaped(text: str) -> str:
    """The text without a marker: "<|", with any backslashes between, has one more. unescaped() takes it back."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, list[int]]], texts: list[str]) -> str:
    """Each turn between markers. What looks like a marker in a text is escaped, so that no text can begin or end a turn."""
    texts = [escaped(t) for t in texts]
    return "".join(OPEN.format(r) + "\n".join(texts[i] for i in of) + CLOSE for r, of in turns)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, cost, roles, rendered) of every conversation, its turns in order of turn, then role, then text.

    A null text counts as empty; a null or unknown role is no role and must be relabelled; rows with a null conv_id or turn are ignored; equal turn
    numbers and repeated rows are all turns; an empty table gives an empty result; other columns are not read. Markers in texts are escaped. A
    conversation becomes one value, so all of it has to fit in one; however many conversations there are, none meets another."""
    turns = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    ready = turns.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[str, ...], tuple[int, list]] = {}
        for f in frames:
            out = []
            for conv, roles, texts in zip(f["conv_id"], f["roles"], f["texts"]):
                key = tuple(roles)
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = plan(key)
                cost, fixed = memo[key]
                out.append((conv, len(fixed), cost, [r for r, _ in fixed], render(fixed, list(texts))))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "cost", "roles", "rendered"]).astype({"conv_id": np.int64, "n_turns": np.int64, "cost": np.int64})

    return ready.mapInPandas(run, "conv_id long, n_turns long, cost long, roles array<string>, rendered string")
