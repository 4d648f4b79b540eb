"""Masking by a finite automaton over texts in chunks, in column functions.

A chunk is cut into marks, which may move the automaton, and the text between them. What
a chunk does is then a function from states to states, an array with an entry for each
state, whatever stands before the chunk. Such functions compose: groups of ``FAN`` chunks
are composed into one, groups of groups likewise, and states go back down the same tree.
So every chunk learns its first state while no task holds more than ``FAN`` functions of a
text, and is then masked where it is.

Edge cases: a null or empty text has no chunks; a run of characters that marks are made
of is never cut, so a chunk may be longer than asked by such a run; an unclosed comment or
quote masks all that follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64


@dataclass(frozen=True)
class Automaton:
    """States 0.. with the start first, marks in the order in which they are tried, and moves (state, mark) to state; others stay."""

    n_states: int
    marks: tuple[str, ...]
    moves: dict[tuple[int, int], int]
    masked: tuple[int, ...]

    def table(self) -> Column:
        return F.array(*[F.lit(self.moves.get((s, m), s)) for s in range(self.n_states) for m in range(len(self.marks))])

    def characters(self) -> str:
        """Those that marks are made of, as they stand in a character class."""
        return "".join("\\" + c if c in "\\^]-[" else c for c in sorted({c for mark in self.marks for c in mark}))

    def cut(self, text: Column, size: int) -> Column:
        """Chunks of ``size`` characters and the mark characters that follow."""
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}[{self.characters()}]*"), F.lit(0))

    def tokens(self, text: Column) -> Column:
        """Marks and what stands between them, in order; their concatenation is the text."""
        marks = "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in self.marks)
        return F.regexp_extract_all(text, F.lit(f"(?s){marks}|[^{self.characters()}]+|."), F.lit(0))

    def mark_of(self, token: Column) -> Column:
        """Index of a mark, null for other text."""
        found = F.when(F.lit(False), 0)
        for k, mark in enumerate(self.marks):
            found = found.when(token == mark, k)
        return found

    def moved(self, state: Column, mark: Column) -> Column:
        return F.get(self.table(), state * len(self.marks) + mark)


#: Text, tag, double and single quotes inside tags, comment.
MARKUP = Automaton(5, ("<!--", "-->", "<", ">", '"', "'"), {(0, 0): 4, (0, 2): 1, (1, 1): 0, (1, 3): 0, (1, 4): 2, (1, 5): 3, (2, 4): 1, (3, 5): 1, (4, 1): 0}, (2, 3, 4))


def chunks(texts: DataFrame, key: str, text: str, machine: Automaton, size: int = 4096) -> DataFrame:
    """(key, chunk from 0, part)."""
    return texts.select(key, F.posexplode(machine.cut(F.col(text), size)).alias("__at", "part")).select(key, F.col("__at").cast("long").alias("chunk"), "part")


def function_of(part: Column, machine: Automaton) -> Column:
    """What a chunk does: its last state for each first state."""
    marks = F.filter(F.transform(machine.tokens(part), machine.mark_of), lambda m: m.isNotNull())
    same = F.array(*[F.lit(s) for s in range(machine.n_states)])
    return F.aggregate(marks, same, lambda states, m: F.transform(states, lambda s: machine.moved(s, m)))


def first_states(functions: DataFrame, key: str, start: int = 0) -> DataFrame:
    """(key, chunk, state): the state in which each of the chunks (key, chunk, function) begins, by a tree of groups."""
    home = F.floor(F.col("chunk") / FAN).cast("long")
    grouped = functions.groupBy(key, home.alias("__group")).agg(F.array_sort(F.collect_list(F.struct("chunk", "function"))).alias("__held"))
    if functions.where(home > 0).limit(1).count():
        whole = F.aggregate(F.slice("__held", F.lit(2), F.size("__held")), F.get("__held", F.lit(0))["function"], lambda a, f: F.transform(a, lambda s: F.get(f["function"], s)))
        above = first_states(grouped.select(key, F.col("__group").alias("chunk"), whole.alias("function")), key, start)
        grouped = grouped.join(above.select(F.col(key).alias("__key"), F.col("chunk").alias("__of"), F.col("state").alias("__first")), (F.col(key) == F.col("__key")) & (F.col("__group") == F.col("__of")))
    else:
        grouped = grouped.withColumn("__first", F.lit(start))
    begun = F.struct(F.col("__first").alias("state"), F.array().cast("array<struct<chunk:bigint,state:int>>").alias("seen"))
    walked = F.aggregate(
        "__held", begun, lambda a, f: F.struct(F.get(f["function"], a["state"]).alias("state"), F.concat(a["seen"], F.array(F.struct(f["chunk"].alias("chunk"), a["state"].alias("state")))).alias("seen"))
    )
    return grouped.select(key, F.explode(walked["seen"]).alias("__seen")).select(key, "__seen.chunk", "__seen.state")


def masked_part(part: Column, state: Column, machine: Automaton) -> Column:
    """The chunk with masked tokens, and the marks that open and close them, as spaces; line ends and length stay."""
    hidden = lambda s: s.isin(*machine.masked)

    def step(a, token):
        after = F.coalesce(machine.moved(a["state"], machine.mark_of(token)), a["state"])
        shown = F.when(hidden(a["state"]) | hidden(after), F.regexp_replace(token, r"[^\r\n]", " ")).otherwise(token)
        return F.struct(after.alias("state"), F.concat(a["text"], shown).alias("text"))

    return F.aggregate(machine.tokens(part), F.struct(state.alias("state"), F.lit("").alias("text")), step)["text"]


def masked(texts: DataFrame, key: str, text: str, machine: Automaton = MARKUP, size: int = 4096) -> DataFrame:
    """(key, chunk, part): the masked chunks of each text. Their concatenation is as long as the text."""
    cut = chunks(texts, key, text, machine, size)
    states = first_states(cut.select(key, "chunk", function_of(F.col("part"), machine).alias("function")), key)
    joined = cut.join(states.select(F.col(key).alias("__key"), F.col("chunk").alias("__chunk"), "state"), (F.col(key) == F.col("__key")) & (F.col("chunk") == F.col("__chunk")))
    return joined.select(key, "chunk", masked_part(F.col("part"), F.col("state"), machine).alias("part"))
