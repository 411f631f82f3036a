"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, with tool turns between two assistant turns, and ends with the
assistant.  Every input turn is taken in its role, relabelled, or merged into the
output turn before it; empty user or assistant turns may be put in front of a
turn or at the end.  Dynamic programming over the automaton finds the cheapest
repair; of equally cheap ones the one that is first in state order, turn by turn.

Turns are sorted into chunks by range, so a huge conversation is cut over many of
them.  What a piece of a conversation costs between any two states is a 5 × 5
min-plus matrix; the matrices of the pieces at chunk ends are put together per
conversation, which tells every chunk the costs behind it and the state it starts
in.  So the result does not depend on where chunks end."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

STATES = ("start", "system", "user", "assistant", "tool")
START, SYSTEM, USER, ASSISTANT, TOOL = range(5)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT,)}
INSERTED = (USER, ASSISTANT)
#: Other names of the roles; any further role is unknown and fits nowhere without a relabel.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
           "ai": "assistant", "function": "tool", "developer": "system"}
NEVER = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Move:
    cost: int
    action: str
    merged: bool
    inserted: tuple[int, ...]


@dataclass(frozen=True)
class Repair:
    """Costs of the three repairs, and the automaton's moves they lead to."""
    merge: int = 1
    relabel: int = 2
    insert: int = 3
    moves: list = field(init=False, compare=False)
    finish: list = field(init=False, compare=False)

    def __post_init__(self):
        moves = [[[self._move(role, s, x) for x in range(5)] for s in range(5)] for role in range(5)]
        object.__setattr__(self, "moves", moves)
        object.__setattr__(self, "finish", [_fill(s, lambda t: t == ASSISTANT) for s in range(5)])

    def _move(self, role: int, s: int, x: int) -> Move | None:
        """The cheapest way to read a turn of ``role`` (0: unknown) from state s into x."""
        wrong = self.relabel * (role != x)
        ways = []
        if x != START and (path := _fill(s, lambda t: x in FOLLOWS[t])) is not None:
            ways.append(Move(wrong + self.insert * len(path), "relabel" if wrong else "keep", False, path))
        if x == s != START:
            ways.append(Move(wrong + self.merge, "relabel+merge" if wrong else "merge", True, ()))
        return min(ways, key=lambda m: m.cost, default=None)

    def end_costs(self) -> list[int]:
        return [NEVER if p is None or s == START else self.insert * len(p) for s, p in enumerate(self.finish)]

    def before(self, role: int, togo: list[int]) -> list[int]:
        """Costs to go in front of a turn, from those behind it."""
        return [min((m.cost + togo[x] for x, m in enumerate(row) if m), default=NEVER) for row in self.moves[role]]

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least costs from every state in front of ``roles`` to every state behind."""
        cols = []
        for x in range(5):
            togo = [0 if s == x else NEVER for s in range(5)]
            for r in reversed(roles):
                togo = [min(c, NEVER) for c in self.before(r, togo)]
            cols.append(togo)
        return [[cols[x][s] for x in range(5)] for s in range(5)]

    def costs_to_go(self, roles: list[int], togo: list[int]) -> list[list[int]]:
        """Costs to go behind every turn."""
        out = [togo]
        for r in reversed(roles[1:]):
            out.append(self.before(r, out[-1]))
        return out[::-1]

    def walk(self, roles: list[int], entry: int, behind: list[list[int]]) -> Iterator[tuple[int, Move]]:
        """(state, move) of the first cheapest path."""
        s = entry
        for r, togo in zip(roles, behind, strict=True):
            s = min((x for x in range(5) if self.moves[r][s][x]), key=lambda x: self.moves[r][s][x].cost + togo[x])
            move = self.moves[r][entry][s]
            entry = s
            yield s, move


def _fill(s: int, done) -> tuple[int, ...] | None:
    """The shortest run of empty turns after state s to a state that is ``done``."""
    seen, work = {s}, deque([(s, ())])
    while work:
        t, path = work.popleft()
        if done(t):
            return path
        for n in FOLLOWS[t]:
            if n in INSERTED and n not in seen:
                seen.add(n)
                work.append((n, (*path, n)))
    return None


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _sorted_roles(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    rows = rows.sort_values("pos").reset_index(drop=True)
    return rows, _segments(rows["conv"].to_numpy())


def _ends(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [parts[0], parts[-1]] if len(parts) > 1 else parts


def _matrices(rule: Repair):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, parts = _sorted_roles(rows)
        role = rows["code"].tolist()
        out = [(rows["conv"][a], rows["chunk"][0], sum(rule.matrix(role[a:b]), [])) for a, b in _ends(parts)]
        return pd.DataFrame(out, columns=["conv", "chunk", "matrix"])
    return run


def _costs_behind(rule: Repair):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("chunk").reset_index(drop=True)
        togo, out = rule.end_costs(), []
        for i in reversed(range(len(pieces))):
            out.append((pieces["conv"][i], pieces["chunk"][i], togo, i == len(pieces) - 1))
            m = np.asarray(pieces["matrix"][i]).reshape(5, 5)
            togo = np.minimum((m + np.array(togo)).min(1), NEVER).tolist()
        return pd.DataFrame(out, columns=["conv", "chunk", "togo", "closes"])
    return run


def _exits(rule: Repair):
    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows, parts = _sorted_roles(rows)
        role, by = rows["code"].tolist(), known.set_index("conv")
        out = []
        for a, b in _ends(parts):
            info = by.loc[rows["conv"][a]]
            behind = rule.costs_to_go(role[a:b], list(info["togo"]))
            ends = [s for e in range(5) for s, _ in list(rule.walk(role[a:b], e, behind))[-1:]]
            out.append((rows["conv"][a], rows["chunk"][0], list(info["togo"]), bool(info["closes"]), ends))
        return pd.DataFrame(out, columns=["conv", "chunk", "togo", "closes", "exits"])
    return run


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("chunk").reset_index(drop=True)
    state, entry = START, []
    for exits in pieces["exits"]:
        entry.append(state)
        state = exits[state]
    return pieces.assign(entry=entry)[["conv", "chunk", "togo", "closes", "entry"]]


def _repaired(rule: Repair):
    names = np.array(STATES)

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows, parts = _sorted_roles(rows)
        role, by = rows["code"].tolist(), {r.conv: r for r in known.itertuples()}
        out = []
        for i, (a, b) in enumerate(parts):
            info = by.get(rows["conv"][a]) if i in (0, len(parts) - 1) else None
            entry = info.entry if info else START
            closes = info.closes if info else True
            behind = rule.costs_to_go(role[a:b], list(info.togo) if info else rule.end_costs())
            for j, (s, m) in enumerate(rule.walk(role[a:b], entry, behind)):
                last = closes and j == b - a - 1
                tail = rule.finish[s] if last else ()
                out.append((rows["pos"][a + j], names[s], m.action, m.merged, [STATES[x] for x in m.inserted],
                            entry == START and j == 0, last, [STATES[x] for x in tail], m.cost + rule.insert * len(tail)))
        return pd.DataFrame(out, columns=["pos", "out_role", "action", "merged", "inserted", "first", "last", "tail", "cost"])
    return run


def _empties(roles: str) -> Column:
    return F.concat(F.lit(""), F.array_join(F.transform(roles, lambda r: F.concat(F.lit(OPEN), r, F.lit("\n" + CLOSE))), ""))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", rule: Repair | None = None, chunk_rows: int = 50_000) -> DataFrame:
    """(conv_id, turn, role, pos, out_role, action, n_inserted, cost, rendered), one row per input turn.

    ``rendered`` is the turn's part of the text: a conversation is the
    concatenation of its parts by ``pos``.  ``n_inserted`` counts empty turns put in
    front of the turn and, on the last one, at the end.  ``chunk_rows`` bounds the
    turns of one task.

    Turns go by number, nulls first, then role and text; repeated rows are turns of
    their own.  Null conversation ids are one conversation; a null or unknown role
    costs a relabel; a null text is empty; the template's own marks in a text are
    broken by a backslash; an empty table gives an empty result."""
    rule = rule or Repair()
    known_roles = {n: i for i, n in enumerate(STATES) if i} | {a: STATES.index(n) for a, n in ALIASES.items()}
    codes = F.create_map(*[F.lit(x) for pair in known_roles.items() for x in pair])
    code = F.coalesce(codes[F.lower(F.trim(F.col(role_col).cast("string")))], F.lit(0))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), code.alias("code"),
        F.coalesce(F.concat(F.lit("id "), F.col(conv_col).cast("string")), F.lit("null")).alias("conv"))
    chunks = -(-rows.count() // chunk_rows) or 1
    keys = ["conv", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(chunks, *keys).sortWithinPartitions(*keys).drop("tie")
    dealt = written(dealt.select("*", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("pos")),
                    "turns")
    roles = dealt.select("conv", "chunk", "pos", "code")
    known = "conv string, chunk int, togo array<bigint>, closes boolean"
    ends = roles.groupBy("chunk").applyInPandas(_matrices(rule), "conv string, chunk int, matrix array<bigint>")
    behind = ends.groupBy("conv").applyInPandas(_costs_behind(rule), known)
    exits = roles.groupBy("chunk").cogroup(behind.groupBy("chunk")).applyInPandas(_exits(rule), known + ", exits array<int>")
    entered = written(exits.groupBy("conv").applyInPandas(_entries, known + ", entry int"), "chunk-ends")
    fixed = roles.groupBy("chunk").cogroup(entered.groupBy("chunk")).applyInPandas(
        _repaired(rule), "pos bigint, out_role string, action string, merged boolean, inserted array<string>, "
                         "first boolean, last boolean, tail array<string>, cost int")
    safe = F.replace(F.replace("text", F.lit("<|im_start|>"), F.lit("<\\|im_start|>")),
                     F.lit("<|im_end|>"), F.lit("<\\|im_end|>"))
    head = F.concat(F.when(F.col("first"), "").otherwise(CLOSE), _empties("inserted"), F.lit(OPEN), "out_role", F.lit("\n"))
    rendered = F.concat(F.when(F.col("merged"), "\n").otherwise(head), safe,
                        F.when(F.col("last"), F.concat(F.lit(CLOSE), _empties("tail"))).otherwise(""))
    return dealt.join(fixed, "pos").select("conv_id", "turn", "role", "pos", "out_role", "action",
                                           (F.size("inserted") + F.size("tail")).alias("n_inserted"), "cost",
                                           rendered.alias("rendered"))
