"""Repeated passages by collinear chaining of shared seeds.

Seeds are the runs of five words whose hash is least among sixteen neighbours,
so any twenty equal words share one. Texts that hold a seed are joined with the
first text that has it, and with each other only if they are DECIDED at most. A
task first links the texts that share a very common seed with one of them and
passes on only that, so no part of the join grows with a seed's frequency.

A seed of more than DECIDED texts does not say which of them share a passage.
Texts with such seeds are read again: of the long runs of words in every stretch
of ``least`` words one is chosen by its hash, and if its other seeds do not decide
it, it becomes a seed of its own. All texts with it are matched with the first of
them, so no exact passage is lost among common lines.

Matches of two texts on one diagonal become runs. Runs are chained in order
through a Fenwick tree of prefix maxima, with a cost for every word of a gap.
Chains ask for the blocks of words that they cover, which are joined by text and
block, and are aligned word by word; stretches that agree well enough are the
passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunks, mix, shingles
from tessera.llm.workspace import keep

SEED_WORDS = 5
NEIGHBOURS = 16
REACH = SEED_WORDS + NEIGHBOURS
SAME_RUN = 2 * REACH
LEAST_WEIGHT = 2 * SEED_WORDS
OFTEN = 64
DECIDED = 3
HELD_SEEDS = 1 << 20
PART_ENTRIES = 400_000
PART_CHAINS = 2_000
BLOCK = 128
MISS = 3
BYTES_A_SEED = 45
_SEED = np.dtype([("seed", "<u8"), ("node", "<i8"), ("at", "<i4")])
_MATCH = np.dtype([("a", "<i8"), ("b", "<i8"), ("pa", "<i4"), ("pb", "<i4")])
_RUN = np.dtype([("seed", "<u8"), ("task", "<i8"), ("node", "<i8"), ("at", "<i4")])
_LAST = np.uint64((1 << 64) - 1)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` values in a row, by doubling; ``width`` is a power of two."""
    step = 1
    while step < width:
        x = best(x[: len(x) - step], x[step:])
        step *= 2
    return x


def seeds(words: Words) -> np.ndarray:
    """Seeds of some rows' texts: hash, row (as ``node``) and first word."""
    counts = words.counts
    names, begin = shingles(words, SEED_WORDS)
    row = np.repeat(np.arange(len(counts)), np.diff(begin))
    at = np.arange(len(names)) - begin[:-1][row]
    if len(names) < NEIGHBOURS:
        return np.zeros(0, _SEED)
    least = _sliding(names, NEIGHBOURS, np.minimum)
    least[row[: len(least)] != row[NEIGHBOURS - 1 :]] = 0
    padded = np.concatenate([np.zeros(NEIGHBOURS - 1, np.uint64), least, np.zeros(NEIGHBOURS - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(padded, NEIGHBOURS, np.maximum) == names) & (names > 0))
    out = np.zeros(len(chosen), _SEED)
    out["seed"], out["node"], out["at"] = names[chosen], row[chosen], at[chosen]
    return out


def _linked(e: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Matches of seeds' occurrences with the first node that has the seed, and between all of at most DECIDED nodes.

    With ``most``, only seeds that occur more often are matched; the second
    result is what is left to be matched elsewhere: all occurrences of the
    others, and of these those in their first node. An occurrence is paired with
    the other text's first one, with the one that is as far on in the text, and
    with the one that is as far on in the longest run of near occurrences; where
    the other text has fewer, they are counted over again.
    """
    e = e[np.lexsort((e["at"], e["node"], e["seed"]))]
    if not len(e):
        return np.zeros(0, _MATCH), e
    new = np.diff(e["seed"], prepend=~e["seed"][:1]) != 0
    group = np.cumsum(new) - 1
    of_node = new | (np.diff(e["node"], prepend=~e["node"][:1]) != 0)
    begin = np.flatnonzero(of_node)
    times = np.diff(np.append(begin, len(e)))
    place = np.cumsum(of_node) - 1
    at_first = place[np.flatnonzero(new)[group]]
    before = np.maximum(place - 1, 0)
    nth = np.arange(len(e)) - begin[place]
    near = of_node | (np.diff(e["at"], prepend=e["at"][:1]) > REACH)
    opens = np.flatnonzero(near)
    sizes = np.diff(np.append(opens, len(e)))
    in_run = np.arange(len(e)) - opens[np.cumsum(near) - 1]
    order = np.lexsort((-sizes, place[opens]))
    longest = order[np.searchsorted(place[opens][order], np.arange(len(begin)))]
    few = (np.bincount(group[begin], minlength=1) <= DECIDED)[group]
    rest, matched = e, place != at_first
    if most is not None:
        often = np.bincount(group, minlength=1)[group] > most
        rest = e[~often | (place == at_first)]
        matched &= often
    mine, other = [], []
    for which, there in ((matched, at_first), (matched & few & (before != at_first), before)):
        some = np.flatnonzero(which)
        there = there[some]
        ways = [begin[there], begin[there] + nth[some] % times[there], opens[longest[there]] + in_run[some] % sizes[longest[there]]]
        for k, way in enumerate(ways):
            fresh = np.all([way != w for w in ways[:k]], axis=0) if k else np.ones(len(some), bool)
            mine.append(some[fresh])
            other.append(way[fresh])
    mine, other = np.concatenate(mine), np.concatenate(other)
    out = np.zeros(len(mine), _MATCH)
    out["a"], out["pa"], out["b"], out["pb"] = e["node"][mine], e["at"][mine], e["node"][other], e["at"][other]
    return out, rest


def _packed(x: np.ndarray, part: np.ndarray, parts: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Entries by the part of a join that they belong to."""
    order = np.argsort(part, kind="stable")
    x, cuts = x[order], np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    for k in range(0, len(full), 256):
        some = full[k : k + 256]
        blobs = [x[cuts[p] : cuts[p + 1]].tobytes() for p in some]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array(blobs, pa.binary())], ["kind", "part", "entries"])


def _pair_part(m: np.ndarray, parts: int) -> np.ndarray:
    return (mix(m["a"].view(np.uint64) ^ mix(m["b"].view(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _node_part(node: np.ndarray, parts: int) -> np.ndarray:
    return (mix(node.view(np.uint64) if node.flags.c_contiguous else node.copy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _sown(batches: Iterator[pa.RecordBatch], least: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Seeds of texts of at least ``least`` words by part, and matches on seeds that are common within the task."""
    kept, total = [], 0
    task = 1 + TaskContext.get().partitionId()

    def flushed() -> Iterator[pa.RecordBatch]:
        found = np.concatenate(kept)
        _, kind, times = np.unique(found["seed"], return_inverse=True, return_counts=True)
        matches, rest = _linked(found, OFTEN)
        often = found[times[kind] > OFTEN]
        marks = often.copy()
        marks["seed"] = task  # texts that one task has linked among themselves
        rest = rest.copy()
        told = np.isin(rest["seed"], often["seed"])
        rest["at"][told] = ~rest["at"][told]  # other tasks' texts with these seeds are to know
        yield from _packed(marks, _node_part(marks["node"], parts), parts, "marks")
        yield from _packed(rest, (mix(rest["seed"]) % np.uint64(parts)).astype(np.int64), parts, "seeds")
        yield from _packed(matches, _pair_part(matches, parts), parts, "matches")

    for batch in batches:
        nodes = batch.column(0).to_numpy()
        for begin, end in chunks(batch.column(1)):
            words = Words(batch.column(1), begin, end)
            found = seeds(words)
            found = found[(words.counts >= least)[found["node"]]]
            found["node"] = nodes[begin:end][found["node"]]
            kept.append(found)
            total += len(found)
            if total > HELD_SEEDS:
                yield from flushed()
                kept, total = [], 0
    if kept:
        yield from flushed()


def _read(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def _joined(part: pa.Table, parts: int) -> pa.Table:
    """Matches of one part's seeds, and as marks the occurrences of those with more than DECIDED texts."""
    e = _read(part.column("entries"), _SEED)
    told = e["at"] < 0
    e["at"][told] = ~e["at"][told]
    matches, _ = _linked(e)
    _, kind = np.unique(e["seed"], return_inverse=True)
    order = np.lexsort((e["node"], kind))
    new = (np.diff(kind[order], prepend=-1) != 0) | (np.diff(e["node"][order], prepend=0) != 0)
    texts = np.bincount(kind[order], weights=new, minlength=1)
    marks = e[(texts[kind] > DECIDED) | (np.bincount(kind, weights=told, minlength=1)[kind] > 0)]
    marks["seed"] = 0
    batches = [*_packed(matches, _pair_part(matches, parts), parts, "matches"), *_packed(marks, _node_part(marks["node"], parts), parts, "marks")]
    return pa.Table.from_batches(batches) if batches else part.slice(0, 0).select(["kind", "part", "entries"])


def _marked(part: pa.Table) -> pa.Table:
    """The marks of each text of one part, in order."""
    e = _read(part.column("entries"), _SEED)
    e = e[np.lexsort((e["at"], e["node"]))]
    cuts = np.flatnonzero(np.concatenate([[True], e["node"][1:] != e["node"][:-1]])) if len(e) else np.zeros(0, np.int64)
    ats = [np.unique(x).astype(np.int32).tobytes() for x in np.split(e["at"], cuts[1:])] if len(e) else []
    tasks = np.maximum.reduceat(e["seed"], cuts).astype(np.int64) if len(e) else np.zeros(0, np.int64)
    return pa.table([pa.array(e["node"][cuts]), pa.array(ats, pa.binary()), pa.array(tasks)], ["node", "marks", "task"])


def _over(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` values in a row."""
    step = 1 << (width.bit_length() - 1)
    x = _sliding(x, step, best)
    return best(x[: len(x) - (width - step)], x[width - step :])


def run_window(least: int) -> int:
    """Of so many neighbouring runs, which lie in one passage of ``least`` words, one is chosen."""
    return least // 5 + 1


def run_words(least: int) -> int:
    """Words of the runs by which passages of ``least`` words are found whole."""
    return least - run_window(least) + 1


def undecided(words: Words, marks: list[np.ndarray], least: int) -> np.ndarray:
    """Chosen runs of words, as seeds, whose unmarked seeds are too few for a chain by themselves.

    Of the runs within ``least`` words the one with the least name is chosen, so
    texts that share ``least`` words choose one run alike. A run's seeds are those
    chosen wholly within it, so every text with the run has them.
    """
    names, begin = shingles(words, SEED_WORDS)
    span = run_words(least)
    own = np.maximum(words.counts - least + 1, 0)
    inner = span - SEED_WORDS + 1
    if not own.sum():
        return np.zeros(0, _SEED)
    name = np.full(len(names) - inner + 1, span, np.uint64)
    for step in [*range(0, span - SEED_WORDS, SEED_WORDS), span - SEED_WORDS]:
        name = mix(name) + names[step : step + len(name)]
    name = mix(name)
    window = np.repeat(begin[:-1] - np.cumsum(own) + own, own) + np.arange(own.sum())
    views = np.lib.stride_tricks.sliding_window_view(name, run_window(least))
    where = np.unique(np.concatenate([views[window[k : k + 16384]].argmin(axis=1) + window[k : k + 16384] for k in range(0, len(window), 16384)]))
    row = np.searchsorted(begin, where, side="right") - 1
    unmarked = np.ones(len(names), bool)
    for k, at in enumerate(marks):
        unmarked[begin[k] + at] = False
    low, high = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    if inner >= NEIGHBOURS:
        views = np.lib.stride_tricks.sliding_window_view(names, NEIGHBOURS)
        chosen = np.concatenate([views[k : k + 16384].argmin(axis=1) for k in range(0, len(views), 16384)]) + np.arange(len(views))
        sure, width = unmarked[chosen], inner - NEIGHBOURS + 1
        low = _over(np.where(sure, chosen, len(names)), width, np.minimum)[where]
        high = _over(np.where(sure, chosen, -1), width, np.maximum)[where]
    some = high - low < LEAST_WEIGHT - SEED_WORDS
    where, row = where[some], row[some]
    out = np.zeros(len(where), _SEED)
    out["seed"], out["node"], out["at"] = name[where], row, where - begin[:-1][row]
    return out


def _undecided(batches: Iterator[pa.RecordBatch], least: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Undecided runs of texts by part."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        for begin, end in chunks(batch.column(1)):
            marks = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)[begin:end]]
            found = undecided(Words(batch.column(1), begin, end), marks, least)
            runs = np.zeros(len(found), _RUN)
            runs["seed"], runs["at"], runs["node"] = found["seed"], found["at"], nodes[begin:end][found["node"]]
            runs["task"] = batch.column(3).to_numpy()[begin:end][found["node"]]
            found = runs
            yield from _packed(found, (mix(found["seed"]) % np.uint64(parts)).astype(np.int64), parts, "runs")


def _with_first(part: pa.Table, parts: int) -> pa.Table:
    """Matches of one part's runs with the first text of the task that has them, and of these with the first of all."""
    e = np.unique(_read(part.column("entries"), _RUN))
    new = np.ones(len(e), bool)
    new[1:] = e["seed"][1:] != e["seed"][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(e) else np.zeros(0, np.int64)
    of_task = new.copy()
    of_task[1:] |= (e["task"][1:] != e["task"][:-1]) | ((e["task"][1:] == 0) & (e["node"][1:] != e["node"][:-1]))
    opens = np.flatnonzero(of_task)[np.cumsum(of_task) - 1] if len(e) else first
    first = np.where(e["node"] == e["node"][opens], first, opens)
    mine = np.flatnonzero(e["node"] != e["node"][first])
    out = np.zeros(len(mine), _MATCH)
    out["a"], out["pa"], out["b"], out["pb"] = e["node"][mine], e["at"][mine], e["node"][first[mine]], e["at"][first[mine]]
    batches = list(_packed(out, _pair_part(out, parts), parts, "long"))
    return pa.Table.from_batches(batches) if batches else part.slice(0, 0).select(["kind", "part", "entries"])


class _Fenwick:
    """Prefix maxima of scores by place, with who has them."""

    def __init__(self, size: int):
        self.best = [(0.0, -1)] * (size + 1)

    def raise_to(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def up_to(self, i: int) -> tuple[float, int]:
        """The best of places before ``i``."""
        found = (float("-inf"), -1)
        while i:
            if self.best[i][1] >= 0 and self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chain(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint collinear chains of runs ``(first, last, first there)``, by the greatest score.

    A run counts its words and pays one half for every word, on either side,
    between it and the run before; it begins where that one's middle has ended.
    """
    left = sorted(runs)
    places = sorted({b for _, _, b in left})
    rank = {b: k for k, b in enumerate(places)}
    tree, score, back = _Fenwick(len(places)), [0.0] * len(left), [-1] * len(left)
    waiting, done = sorted((last, k) for k, (_, last, _) in enumerate(left)), 0
    ends = [b + last - first for first, last, b in left]
    for k, (first, last, b) in enumerate(left):
        while done < len(waiting) and waiting[done][0] <= first + SEED_WORDS - 1:
            j = waiting[done][1]
            done += 1
            if left[j] < left[k]:
                at = rank[left[j][2]]
                tree.raise_to(at, (score[j] + (left[j][1] + ends[j]) / 2, j))
        value, j = tree.up_to(rank[b])
        own = last - first
        if j >= 0 and value - (first + b) / 2 > 0:
            score[k], back[k] = own + value - (first + b) / 2, j
        else:
            score[k] = own
    out, used = [], [False] * len(left)
    for k in sorted(range(len(left)), key=lambda k: -score[k]):
        found = []
        while k >= 0 and not used[k]:
            used[k] = True
            found.append(left[k])
            k = back[k]
        if found:
            out.append(found[::-1])
    return out


def _chained(part: pa.Table, least: int) -> pa.Table:
    """Chains of all pairs of one part whose runs could be a passage of ``least`` words."""
    is_long = np.array([x.as_py() == "long" for x in part.column("kind")], bool)
    m = _read(part.column("entries").filter(pa.array(~is_long)), _MATCH)
    whole = _read(part.column("entries").filter(pa.array(is_long)), _MATCH)
    span = run_words(least)
    for step in [*range(0, span - SEED_WORDS, REACH), span - SEED_WORDS] if len(whole) else []:
        moved = whole.copy()
        moved["pa"] += step
        moved["pb"] += step
        m = np.concatenate([m, moved])
    m = np.unique(m)
    diagonal = m["pa"].astype(np.int64) - m["pb"]
    m = m[np.lexsort((m["pa"], diagonal, m["b"], m["a"]))]
    diagonal = m["pa"].astype(np.int64) - m["pb"]
    pair = np.ones(len(m), bool)
    pair[1:] = (m["a"][1:] != m["a"][:-1]) | (m["b"][1:] != m["b"][:-1])
    new = pair.copy()
    new[1:] |= (diagonal[1:] != diagonal[:-1]) | (m["pa"][1:] - m["pa"][:-1] > SAME_RUN)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(m)) - 1
    of_pair = (np.cumsum(pair) - 1)[start] if len(m) else start
    first, last, there = m["pa"][start], m["pa"][stop] + SEED_WORDS, m["pb"][start]
    weight = np.bincount(of_pair, weights=last - first, minlength=1)
    near = np.bincount(of_pair, minlength=1) * 2 * REACH + weight >= least
    some = np.flatnonzero((weight >= LEAST_WEIGHT)[of_pair] & near[of_pair])
    rows = []
    cuts = np.flatnonzero(np.diff(of_pair[some], prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(some)), strict=True):
        who = some[low:high]
        a, b = int(m["a"][start[who[0]]]), int(m["b"][start[who[0]]])
        runs = list(zip(first[who].tolist(), last[who].tolist(), there[who].tolist(), strict=True))
        for runs_of in chain(runs) if len(runs) > 1 else [runs]:
            begin, end = runs_of[0][0], runs_of[-1][1]
            other, beyond = runs_of[0][2], runs_of[-1][2] + runs_of[-1][1] - runs_of[-1][0]
            if min(end - begin, beyond - other) + 2 * REACH >= least and sum(y - x for x, y, _ in runs_of) >= LEAST_WEIGHT:
                rows.append((a, b, max(0, begin - REACH), end + REACH, max(0, other - REACH), beyond + REACH, np.array(runs_of, np.int32).tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "a_from", "a_to", "b_from", "b_to", "runs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's words as 32-bit names, in blocks."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        for begin, end in chunks(batch.column(1)):
            words = Words(batch.column(1), begin, end)
            names = (words.hashes() >> np.uint64(32)).astype(np.uint32)
            own = -(-words.counts // BLOCK)
            row = np.repeat(np.arange(end - begin), own)
            block = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            low = words.first[:-1][row] + block * BLOCK
            high = np.minimum(low + BLOCK, words.first[1:][row])
            blobs = [names[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            keys = batch.column(2).take(pa.array(row + begin))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[begin:end][row]), pa.array(block), pa.array(blobs, pa.binary()), keys], ["node", "block", "words", "doc"])


def _between(a: list[int], b: list[int]) -> list[int]:
    """For each word of ``a`` its partner in ``b`` on a longest common subsequence, or -1; a row of bits at a time."""
    at: dict[int, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for w in a:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [-1] * len(a), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # the last word of b adds nothing
            j -= 1
            continue
        i -= 1
        if i == 0 or rows[i - 1] >> (j - 1) & 1:  # without this word of a it adds nothing either
            j -= 1
            out[i] = j
    return out


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int, int, int]]:
    """Passages of two fragments along a chain of runs: both ends on either side, and words matched.

    Runs are compared on their diagonals, the first and last ones to the ends of
    the fragments; gaps by a longest common subsequence. An unmatched word costs
    ``MISS`` matched ones, so a passage ends where more than a quarter differs.
    """
    partner = np.full(len(a), -1, np.int64)
    at_a = at_b = 0
    for k, (first, last, there) in enumerate(runs):
        low = max(first, at_a, first - there + at_b)
        if k == 0:
            low = max(0, first - there)
        else:
            gap = _between(a[at_a:low].tolist(), b[at_b : low - first + there].tolist())
            partner[at_a:low] = [x + at_b if x >= 0 else -1 for x in gap]
        high = last if k + 1 < len(runs) else min(len(a), len(b) + first - there)
        high = min(max(high, low), len(a), len(b) + first - there)
        if high <= low:
            continue
        same = np.flatnonzero(a[low:high] == b[low - first + there : high - first + there]) + low
        partner[same] = same - first + there
        at_a, at_b = high, high - first + there
    hit = np.flatnonzero(partner >= 0).tolist()
    found, begin, value, best, end, n = [], None, 0, 0, None, 0

    def closed() -> None:
        if begin is not None and min(end - begin + 1, partner[end] - partner[begin] + 1) >= least:
            found.append((begin, end + 1, int(partner[begin]), int(partner[end]) + 1, n))

    seen = 0
    for k, i in enumerate(hit):
        if begin is not None:
            value -= MISS * max(i - hit[k - 1] - 1, int(partner[i] - partner[hit[k - 1]]) - 1)
            if value <= 0:
                closed()
                begin = None
        if begin is None:
            begin, value, best, seen = i, 0, 0, 0
        value += 1
        seen += 1
        if value >= best:
            best, end, n = value, i, seen
    closed()
    return found


def _aligned(part: pa.Table, least: int) -> pa.Table:
    """Passages of the chains of one part, from either side."""
    fragments: dict[tuple[int, str], dict[int, bytes]] = {}
    about: dict[int, dict] = {}
    keys: dict[tuple[int, str], object] = {}
    for row in part.to_pylist():
        if row["side"] is None:
            about[row["chain"]] = row
        else:
            fragments.setdefault((row["chain"], row["side"]), {})[row["block"]] = row["words"]
            keys[row["chain"], row["side"]] = row["doc"]
    out = []
    for number, c in about.items():
        sides = []
        for side in "ab":
            held = fragments.get((number, side), {})
            low = c[f"{side}_from"] // BLOCK
            words = np.frombuffer(b"".join(held[k] for k in sorted(held)), np.uint32)
            sides.append((words[c[f"{side}_from"] - low * BLOCK : c[f"{side}_to"] - low * BLOCK], c[f"{side}_from"]))
        (a, a_from), (b, b_from) = sides
        runs = [(x - a_from, min(y - a_from, len(a)), z - b_from) for x, y, z in np.frombuffer(c["runs"], np.int32).reshape(-1, 3).tolist()]
        for x, y, z, t, n in align(a, b, runs, least):
            mine, others = (keys[number, "a"], x + a_from, y + a_from), (keys[number, "b"], z + b_from, t + b_from)
            out += [(mine[0], others[0], *mine[1:], *others[1:], n), (others[0], mine[0], *others[1:], *mine[1:], n)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 7
    kinds = [part.schema.field("doc").type] * 2 + [pa.int64()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "other_id", "first_word", "end_word", "other_first", "other_end", "matched"])


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """A row for each text and passage of at least ``least`` words that it shares with another.

    Columns: ``key``, other_id, first_word, end_word, other_first, other_end,
    matched, words counted from 0 and ends exclusive. Two texts that share a
    passage have a row each, so every text that holds one stands under ``key``.
    Words lie between ASCII white space, A-Z lower-cased; of a
    passage's words at least about three quarters agree in order. Texts that
    share a passage with many others have a row for the first of them in an
    inner order and one for their neighbour in it, so that all texts with the
    passage are connected, however common its lines are elsewhere. Null and shorter texts share nothing. Rows that
    repeat both key and text are one text; rows of one key with different texts
    are different texts of that key, a null key is a key. Other columns are left
    out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("node"), F.col(text).cast("binary").alias("content"))
    texts = rows.select("node", "content")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_SEED // PART_ENTRIES)
    packs = "kind string, part long, entries binary"
    sown = keep(texts.mapInArrow(lambda it: _sown(it, least, parts), packs), "passage-seeds")
    joined = keep(sown.where("kind = 'seeds'").groupBy("part").applyInArrow(lambda part: _joined(part, parts), packs), "passage-matches")
    marks = joined.where("kind = 'marks'").unionByName(sown.where("kind = 'marks'"))
    marks = marks.groupBy("part").applyInArrow(_marked, "node long, marks binary, task long")
    again = texts.join(marks, "node").select("node", "content", "marks", "task")
    runs = again.mapInArrow(lambda it: _undecided(it, least, parts), packs)
    runs = runs.groupBy("part").applyInArrow(lambda part: _with_first(part, parts), packs)
    matches = joined.unionByName(sown).where("kind = 'matches'").unionByName(runs)
    chains = "a long, b long, a_from long, a_to long, b_from long, b_to long, runs binary"
    chained = keep(matches.groupBy("part").applyInArrow(lambda part: _chained(part, least), chains).withColumn("chain", F.monotonically_increasing_id()), "passage-chains")
    asked = None
    for side in "ab":
        block = F.explode(F.sequence(F.floor(F.col(f"{side}_from") / BLOCK), F.floor((F.col(f"{side}_to") - 1) / BLOCK)))
        own = chained.select("chain", F.lit(side).alias("side"), F.col(side).alias("node"), block.alias("block"))
        asked = own if asked is None else asked.unionByName(own)
    kind = rows.schema["doc"].dataType.simpleString()
    blocks = rows.select("node", "content", "doc").mapInArrow(_blocks, f"node long, block long, words binary, doc {kind}")
    got = blocks.join(asked, ["node", "block"]).select("chain", "side", "block", "words", "doc")
    pieces = got.unionByName(chained, allowMissingColumns=True)
    packs_of = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chained.count() // PART_CHAINS)
    pieces = pieces.withColumn("pack", F.pmod(F.xxhash64("chain"), F.lit(packs_of)))
    found = f"doc {kind}, other_id {kind}, first_word long, end_word long, other_first long, other_end long, matched long"
    return pieces.groupBy("pack").applyInArrow(lambda part: _aligned(part, least), found).withColumnRenamed("doc", key)
