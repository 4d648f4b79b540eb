"""Tool output as a stream of lines: diagnostics with their context, and blocks of warnings.

What a line is by itself is told by columns. Two things depend on lines before it: a
source excerpt is context only after a run's first diagnostic, and an indented line goes
on with the warning block that is open. Both are kept as state by run (a flag, a number and
the open block), so a run may arrive over any number of batches and a restarted query goes
on from its checkpoint.

A run's lines must arrive in order, as a log that is followed gives them. A row with a null
line ends a run: its open block is given out and its state dropped. Where ``idle_ms`` is
given, a run from which nothing comes for so long is ended the same way; a query with such
a timeout never runs out of batches, so it needs a trigger other than ``availableNow``.

Edge cases: blank lines have no part; a block takes the indented lines up to the next
warning, whatever stands between; a line after the end of its run begins a new run; null
keys are one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline.functions import text as T
from sieveline.sources import logs

STATE = "seen boolean, block long, message string"


def told(lines: DataFrame) -> DataFrame:
    """Adds what a line (run, line_no, raw) is by itself."""
    bare = T.stripped(F.col("raw"))
    frame = T.starts_with_any(bare, ("In file included from", "from ")) | bare.rlike(logs.CONTEXT_HEADER) | bare.rlike(logs.REQUIRED_FROM)
    tests = {"diagnostic": bare.rlike(logs.DIAGNOSTIC), "frame": frame, "excerpt": F.col("raw").rlike(logs.CONTEXT), "head": F.col("raw").rlike(logs.WARNING_HEAD), "more": F.col("raw").rlike(r"^\s"), "blank": bare == ""}
    return lines.select("run", "line_no", "raw", *[F.coalesce(test, F.lit(False)).alias(name) for name, test in tests.items()])


def judged(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(run, line_no, part, block, message) of a stream of lines.

    A row for every line that is not blank, with its part; and a row with part ``block``
    for each warning and its indented lines, given out when the block ends.
    """
    kind = dict(lines.dtypes)["run"]
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    columns = ["run", "line_no", "part", "block", "message"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        seen, block, message = state.get if state.exists else (False, 0, None)

        def close() -> None:
            nonlocal message
            if message is not None:
                out.append((run, None, "block", block, message))
            message = None

        ended = idle_ms is not None and state.hasTimedOut
        if not ended:
            rows = pd.concat(batches).sort_values("line_no", kind="stable", na_position="last")
            for row in rows.itertuples():
                if row.raw is None:
                    close()
                    seen, block, ended = False, 0, True
                    continue
                ended = False
                seen = seen or row.diagnostic
                if not row.blank:
                    part = "diagnostic" if row.diagnostic else "context" if row.frame or (seen and row.excerpt) else "malformed"
                    out.append((run, int(row.line_no), part, None, None))
                if row.head:
                    close()
                    block, message = block + 1, row.raw
                elif row.more and message is not None:
                    message += "\n" + row.raw
        if ended:
            close()
            if state.exists:
                state.remove()
        else:
            state.update((bool(seen), block, message))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns).astype({"line_no": "Int64", "block": "Int64"})

    return told(lines).groupBy("run").applyInPandasWithState(fold, f"run {kind}, line_no long, part string, block long, message string", STATE, "append", timeout)
