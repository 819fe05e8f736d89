"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. Prefix sums of the turns'
tokens say where a window is full; each window repeats the conversation's system
turn and a limited stretch of the turns before it, and only its new assistant
turns are under the loss mask, so every target is learned once.

A turn is written as ``<turn ROLE>TEXT</turn>`` and a line feed. Inside a text a
backslash is put after the ``<`` of whatever would read as such a mark, with or
without backslashes there already, so taking one away gives the text back; no
other text is changed. Roles are percent-encoded.

A conversation of more than ``SEGMENT`` turns, or of very long ones, is cut into
segments first: its turns are numbered by a sort over range partitions, which
one conversation may span, and each segment is then walked by itself. So no task
holds more of one conversation than a segment, whatever it has of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import keep

BUDGET = 768
HISTORY = 192
REACH = 8
SEGMENT = 1024
ROW_BYTES = 64 << 10
FEW_LONG = 10_000
END = "</turn>\n"
# About a model's pieces: six letters or digits at most, or one sign.
TOKEN = r"[\p{L}\p{N}]{1,6}|[^\x20\x09-\x0D\p{L}\p{N}]"
SYSTEM, TARGET = "system", "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def _pieces(conversations: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Column | None) -> DataFrame:
    """One row a turn: what is written for it, where its text begins there, and its tokens."""
    body, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    counted = F.regexp_count(body, F.lit(TOKEN)) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), body.alias("text"), counted.cast("long").alias("tokens"))
    head = F.concat(F.lit("<turn "), F.url_encode("role"), F.lit(">"))
    rows = rows.select("conv", "turn", "role", "tokens", F.char_length(head).alias("head"), F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"), F.xxhash64("text").alias("tie"))
    return rows.withColumn("chars", F.char_length("piece").cast("long"))


def _long(rows: DataFrame) -> DataFrame:
    """The conversations that one segment does not hold."""
    sums = rows.groupBy("conv").agg(F.sum(_weight()).alias("weight"))
    return sums.where(F.col("weight") > SEGMENT).select(F.col("conv").alias("long_conv"))


def _weight() -> Column:
    """A segment's share that a turn takes: one row of ``SEGMENT``, or more where it is long."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length("piece") / ROW_BYTES)).cast("long")


def _in_one(rows: DataFrame) -> DataFrame:
    """Turns of conversations that are one segment, numbered in it."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "tie")
    rows = rows.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "segment": F.lit(0).cast("long"), "carried": F.lit(False)})
    first = F.min(F.when(F.col("role") == SYSTEM, F.col("at"))).over(Window.partitionBy("conv"))
    return rows.withColumn("kept", F.coalesce(F.col("at") == first, F.lit(False)))


def _in_segments(rows: DataFrame) -> DataFrame:
    """Turns of long conversations, numbered in order, with the turns that later segments repeat.

    Range partitions cut a conversation where they will; counts by partition
    and conversation give what came before, so numbers do not depend on them.
    """
    order = ["conv", "turn", "role", "tie"]
    sorted_rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    kept = keep(sorted_rows.drop("row").withColumns({"row": F.monotonically_increasing_id(), "weight": _weight()}), "long-turns").withColumn("part", F.shiftright("row", 33))
    cells = kept.groupBy(F.col("conv").alias("cell_conv"), F.col("part").alias("cell_part")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    before = Window.partitionBy("cell_conv").orderBy("cell_part")
    cells = cells.select("cell_conv", "cell_part", (F.sum("n").over(before) - F.col("n")).alias("n_before"), (F.sum("w").over(before) - F.col("w")).alias("w_before"))
    here = Window.partitionBy("conv", "part").orderBy("row")
    placed = kept.withColumns({"rank": F.row_number().over(here), "sum": F.sum("weight").over(here)})
    placed = placed.join(cells, (F.col("part") == F.col("cell_part")) & F.col("conv").eqNullSafe(F.col("cell_conv")))
    at, weight = (F.col("n_before") + F.col("rank") - 1).cast("long"), F.col("w_before") + F.col("sum") - F.col("weight")
    columns = ["conv", "turn", "role", "tokens", "head", "piece", "tie", "chars"]
    turns = keep(placed.select(*columns, at.alias("at"), F.floor(weight / SEGMENT).alias("segment")), "numbered-turns")
    segments = turns.groupBy(F.col("conv").alias("of"), F.col("segment").alias("seg")).agg(F.max("at").alias("last"))
    systems = turns.where(F.col("role") == SYSTEM).groupBy(F.col("conv").alias("sys_conv")).agg(F.min("at").alias("sys_at"))
    turns = turns.join(systems, F.col("conv").eqNullSafe(F.col("sys_conv")), "left").withColumn("kept", F.coalesce(F.col("at") == F.col("sys_at"), F.lit(False))).drop("sys_conv", "sys_at")
    following = segments.groupBy("of").agg(F.collect_list("seg").alias("segs"))
    system_rows = turns.where("kept").join(following, F.col("conv").eqNullSafe(F.col("of"))).withColumn("next", F.explode(F.filter("segs", lambda s: s > F.col("segment"))))
    tail = turns.where(~F.col("kept")).join(segments, F.col("conv").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("seg"))).where(F.col("at") > F.col("last") - REACH)
    repeats = lambda df, to: df.select(*columns, "at", to.alias("segment"), F.lit(True).alias("carried"), "kept")
    own = turns.select(*columns, "at", "segment", F.lit(False).alias("carried"), "kept")
    return own.unionByName(repeats(system_rows, F.col("next"))).unionByName(repeats(tail, F.col("segment") + 1))


def _windows(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The windows of every segment, one row each."""
    order = Window.partitionBy("conv", "segment").orderBy("at")
    before = lambda c: F.sum(c).over(order) - F.col(c)
    turns = turns.withColumns({"tokens_before": before("tokens"), "chars_before": before("chars")})
    fields = ["at", "turn", "role", "tokens", "head", "chars", "carried", "kept", "tokens_before", "chars_before"]
    whole = turns.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(F.struct(*fields, "piece"))).alias("all"))
    whole = whole.where(F.exists("all", lambda t: ~t["carried"]))
    whole = whole.select("conv", "segment", F.transform("all", lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("turns"), F.transform("all", lambda t: t["piece"]).alias("pieces"))
    place = F.array_position(F.transform("turns", lambda t: t["kept"]), True).cast("int") - 1
    whole = whole.withColumn("system", F.struct(place.alias("i"), *[F.when(place >= 0, F.get("turns", place)[c]).otherwise(0).alias(c) for c in ("tokens", "chars")]))
    system, get = F.col("system"), lambda i: F.get("turns", i)
    above = lambda i: (system["i"] >= 0) & (system["i"] < i)

    def between(j: Column, i: Column, what: str) -> Column:
        """Tokens or characters of turns ``j`` to ``i``, the system turn left out."""
        return get(i)[f"{what}_before"] - get(j)[f"{what}_before"] - F.when((system["i"] >= j) & (system["i"] < i), system[what]).otherwise(0)

    def opened(i: Column) -> Column:
        """A window whose first new turn is ``i``: where its history begins, and the tokens it has then."""
        top = F.when(above(i), system["tokens"]).otherwise(0)
        room = F.least(F.lit(history), F.lit(budget) - top - get(i)["tokens"])
        starts = F.filter(F.sequence(F.greatest(i - REACH, F.lit(0)), i), lambda j: (j == i) | (between(j, i, "tokens") <= room))
        return F.transform(F.array(F.get(starts, F.lit(0))), lambda j: F.struct(i.alias("first"), j.alias("since"), (top + between(j, i, "tokens") + get(i)["tokens"]).alias("used")))[0]

    kind = "struct<list:array<struct<first:int,since:int,used:bigint>>,used:bigint>"

    def step(state: Column, i: Column) -> Column:
        full = (F.size(state["list"]) == 0) | (state["used"] + get(i)["tokens"] > budget)
        fresh = F.transform(F.array(opened(i)), lambda w: F.struct(F.concat(state["list"], F.array(w)).alias("list"), w["used"].alias("used")))[0]
        more = F.struct(state["list"].alias("list"), (state["used"] + get(i)["tokens"]).alias("used"))
        return F.when(get(i)["carried"], state).when(full, fresh.cast(kind)).otherwise(more.cast(kind))

    none = F.struct(F.array().cast("array<struct<first:int,since:int,used:bigint>>").alias("list"), F.lit(0).cast("bigint").alias("used"))
    found = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), none, step, lambda s: s["list"])
    whole = whole.withColumn("starts", found)
    ends = lambda k: F.coalesce(F.get("starts", k + 1)["first"], F.size("turns"))
    windows = whole.select("*", F.posexplode(F.transform("starts", lambda w, k: F.struct(w["first"].alias("first"), w["since"].alias("since"), ends(k).alias("until")))).alias("window", "w"))
    first, since, until = F.col("w.first"), F.col("w.since"), F.col("w.until")
    top = F.when(above(first), F.array(system["i"])).otherwise(F.array().cast("array<int>"))
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    past = F.filter(span(since, first), lambda i: i != system["i"])
    windows = windows.withColumns({"top": F.when(above(first), system["chars"]).otherwise(0), "shown": F.concat(top, past, span(first, until))})
    base = F.col("top") + between(since, first, "chars")
    begins = lambda i: F.when(i >= first, base + get(i)["chars_before"] - get(first)["chars_before"]).when(above(first) & (i == system["i"]), F.lit(0)).otherwise(F.col("top") + between(since, i, "chars"))
    entry = lambda i: F.struct(
        get(i)["turn"].alias("turn"),
        get(i)["role"].alias("role"),
        (begins(i) + get(i)["head"]).cast("long").alias("start"),
        (begins(i) + get(i)["chars"] - len(END)).cast("long").alias("end"),
        (i < first).alias("repeated"),
        ((i >= first) & (get(i)["role"] == TARGET)).alias("loss"),
    )
    used = F.aggregate("shown", F.lit(0).cast("long"), lambda s, i: s + get(i)["tokens"])
    return windows.select(
        "conv",
        "segment",
        "window",
        used.alias("n_tokens"),
        (used > budget).alias("over_budget"),
        F.array_join(F.transform("shown", lambda i: F.get("pieces", i)), "").alias("formatted"),
        F.transform("shown", entry).alias("turns"),
    )


def chat_windows(
    conversations: DataFrame,
    *,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """One row per window: ``conv``, segment, window, n_tokens, over_budget, formatted, turns.

    ``turns`` has, in the order of ``formatted``, each turn's number and role,
    the code points of its (escaped) text as start and end, whether it is
    repeated, and whether it is under the loss mask. A window takes turns while
    the system turn, the history and they stay within ``budget`` tokens; marks
    count nothing. Its history is the longest stretch of at most ``REACH`` turns
    right before it that has at most ``history`` tokens and leaves room for its
    first turn. A turn that is too large alone gets a window of its own, without
    history, marked ``over_budget``; nothing is cut. The system turn is the
    first turn whose role is ``system``; others are turns like any.

    Turns are ordered by ``turn``, nulls first, then by role and a hash of the
    text; repeated rows are turns each. A null text or role counts as empty, a
    null ``conv`` is a conversation, ``tokens`` that are null count 0. Windows do
    not reach over the ``SEGMENT`` turns of a segment, of which each turn counts
    once for every ``ROW_BYTES`` of text; the history of a segment's first window
    lies in the segment before. Other columns are not read. An empty table gives
    no rows.
    """
    rows = _pieces(conversations, conv, turn, role, text, tokens)
    found = _long(rows).limit(FEW_LONG + 1).collect()  # at most FEW_LONG + 1 keys: what is decided is the plan alone
    turns = _in_one(rows)
    if found:
        names = _long(rows)
        names = F.broadcast(names) if len(found) <= FEW_LONG else names
        same = F.col("conv").eqNullSafe(F.col("long_conv"))
        turns = _in_one(rows.join(names, same, "left_anti")).unionByName(_in_segments(rows.join(names, same, "left_semi")))
    return _windows(turns, budget, history).withColumnRenamed("conv", conv)


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``said``: role, text, repeated and loss of every turn, read from ``formatted``.

    Roles and texts come from the marks, a target's text from its span.
    """
    parts = F.split(F.col("formatted"), END, -1)
    marks = F.col("turns")

    def one(piece: Column, i: Column) -> Column:
        close = F.instr(piece, F.lit(">"))
        mark = F.get(marks, i)
        span = F.substring(F.col("formatted"), (mark["start"] + 1).cast("int"), (mark["end"] - mark["start"]).cast("int"))
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(7), close - 7)).alias("role"),
            unescaped(F.substring(piece, close + 1, F.char_length(piece))).alias("text"),
            mark["repeated"].alias("repeated"),
            F.when(mark["loss"], unescaped(span)).alias("target"),
        )

    return windows.withColumn("said", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one))
