"""Watching answers as they arrive: where an object is closed, or where it is padded and will not be.

An answer comes in pieces of any length. What is carried from piece to piece is
small and does not depend on how the text is cut: how deep the object is, whether
a string is open, and how long the run of white space is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.answers import MOST_BLANKS

FOUND = "outcome string, at long"
_OUTSIDE, _INSIDE = re.compile(r"\s+|[\"{}]|[^\s\"{}]+"), re.compile(r"[\\\"]")


@dataclass
class Guard:
    """The state after some pieces: ``outcome`` is open, closed or padded, ``at`` the code points read when it was decided."""

    depth: int = 0
    begun: bool = False
    inside: bool = False
    escaped: bool = False
    blanks: int = 0
    at: int = 0
    outcome: str = "open"

    def feed(self, piece: str) -> None:
        place = 0
        while place < len(piece) and self.outcome == "open":
            begin = place
            if self.inside:
                place = self._string(piece, place)
            else:
                found = _OUTSIDE.match(piece, place)
                place = found.end()
                if found[0].isspace():
                    self.blanks += len(found[0])
                    if self.blanks > MOST_BLANKS:
                        place -= self.blanks - MOST_BLANKS - 1
                        self.outcome = "padded"
                else:
                    self.blanks = 0
                    self._mark(found[0])
            self.at += place - begin

    def _string(self, piece: str, place: int) -> int:
        if self.escaped:
            self.escaped = False
            return place + 1
        found = _INSIDE.search(piece, place)
        if found is None:
            return len(piece)
        self.escaped = found[0] == "\\"
        self.inside = self.escaped
        return found.end()

    def _mark(self, mark: str) -> None:
        if mark == '"':
            self.inside = True
        elif mark == "{":
            self.depth, self.begun = self.depth + 1, True
        elif mark == "}":
            self.depth -= 1
            if self.begun and self.depth == 0:
                self.outcome = "closed"


def guarded(pieces: DataFrame, call: str = "call", seq: str = "seq", piece: str = "piece") -> DataFrame:
    """``call``, outcome, at of calls whose pieces are all there, in the order of ``seq``; one call is in one task.

    closed: the root object ends at code point ``at``; padded: the 81st blank in a
    row outside a string ends there; open: neither comes. A null piece is empty.
    """
    ordered = F.array_sort(F.collect_list(F.struct(seq, F.coalesce(piece, F.lit("")).alias(piece))))
    calls = pieces.groupBy(call).agg(F.transform(ordered, lambda p: p[piece]).alias("_pieces"))
    return calls.select(call, _read("_pieces").alias("_g")).select(call, "_g.outcome", "_g.at")


@F.pandas_udf(S.StructType([S.StructField("outcome", S.StringType()), S.StructField("at", S.LongType())]))
def _read(calls: pd.Series) -> pd.DataFrame:
    def one(texts: list[str]) -> tuple[str, int]:
        state = Guard()
        for text in texts:
            state.feed(text)
        return state.outcome, state.at

    return pd.DataFrame([one(c) for c in calls], columns=["outcome", "at"])


def guarded_stream(pieces: DataFrame, call: str = "call", seq: str = "seq", piece: str = "piece") -> DataFrame:
    """The same of a stream of pieces: a row for each call as soon as it is closed or padded.

    ``seq`` counts a call's pieces from 0. Pieces that come too early wait in the
    call's state for those before them; pieces after the end, and pieces that come
    twice, are passed over.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard, following, waiting = Guard(), 0, {}
        if state.exists:
            held, following, early = state.get
            guard, waiting = Guard(**json.loads(held)), {int(k): v for k, v in json.loads(early).items()}
        was = guard.outcome
        for frame in frames:
            waiting |= {int(n): text or "" for n, text in zip(frame[seq], frame[piece], strict=True) if n >= following}
        while guard.outcome == "open" and following in waiting:
            guard.feed(waiting.pop(following))
            following += 1
        state.update((json.dumps(asdict(guard)), following, json.dumps(waiting if guard.outcome == "open" else {})))
        if was == "open" and guard.outcome != "open":
            yield pd.DataFrame({call: [key[0]], "outcome": [guard.outcome], "at": [guard.at]})

    kind = pieces.schema[call].dataType.simpleString()
    return pieces.select(call, seq, piece).groupBy(call).applyInPandasWithState(update, f"`{call}` {kind}, {FOUND}", "guard string, following long, waiting string", "append", GroupStateTimeout.NoTimeout)
