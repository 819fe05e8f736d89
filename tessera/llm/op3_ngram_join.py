"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word n-grams; equal sets are one set. The
grams are put in one order, the frequent ones last, and the first grams of each
set are indexed by gram, with set sizes and positions. Entries of a list with
one size and one position are a block: two blocks whose sizes are too far apart,
or whose positions leave too few grams behind them, are skipped with all their
entries. Pairs that share as many of their first grams as the threshold demands
of sets of their sizes are candidates. The sets of a long list are put into one
family by an edge each, without pairs, already in the task that reads them.

Sets that candidates connect are highly similar, and their answers are derived
from those of one set, the grams that most of a family's first sets hold. A
member keeps only the grams in which it differs from that set: ``a`` that it
lacks and ``b`` that it adds. Two members that differ in ``c`` grams alike link
if and only if ``(100 - p) * m + (100 + p) * c >= 100 * a + p * b`` summed over
both, where m is the size of the common set and p the threshold. So with
``f = 100 * a + p * b``, all pairs with ``f + f' <= (100 - p) * m`` link
whatever they share, and are counted by the members' f alone; only pairs beyond
that are looked at, block by block, by their differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.words import Words, chunks, mix, most_frequent, shingles
from tessera.llm.workspace import keep

FREQUENT = 1 << 18
HELD_GRAMS = 1 << 20
LIST_ENTRIES = 100_000
LONG = 128
HELD_PAIRS = 1 << 20
BLOCK = 512
REFERENCES = 32
CELL_SETS = 1024
HOT_SETS = 1024
GRAMS_AT_ONCE = 4096
_ENTRY = np.dtype([("gram", "<u8"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4")])
_LEADS = np.uint32(1 << 31)  # an entry that stands for all entries of its gram in one task
_HIGH = np.uint64(1 << 63)


class _Sets:
    """The sets of some rows: ``grams`` sorted and distinct within each row."""

    def __init__(self, column: pa.Array, begin: int, end: int, size: int):
        grams, first = shingles(Words(column, begin, end), size)
        row = np.repeat(np.arange(end - begin), np.diff(first))
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        self.grams, self.row = grams[new], row[new]
        self.counts = np.bincount(self.row, minlength=end - begin)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        one = np.concatenate([[np.uint64(0)], np.cumsum(self.grams)])
        two = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.grams ^ _HIGH))])
        sums = mix(one[self.first[1:]] - one[self.first[:-1]]) ^ (two[self.first[1:]] - two[self.first[:-1]])
        self.node = mix(sums + self.counts.astype(np.uint64)).view(np.int64)

    def once(self, seen: set[int]) -> np.ndarray:
        """Which rows have a set that is not in ``seen``, which grows by them."""
        fresh = np.zeros(len(self.node), bool)
        for k, (node, n) in enumerate(zip(self.node.tolist(), self.counts.tolist(), strict=True)):
            if n and node not in seen:
                seen.add(node)
                fresh[k] = True
        return fresh

    def of(self, row: int) -> np.ndarray:
        return self.grams[self.first[row] : self.first[row + 1]]


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of grams that some of them share."""
    names = ["doc", "row", "n", "node", "gram", "times"]
    kept, total, seen = [], 0, set()

    def counted() -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(kept), return_counts=True)
        grams, times = grams[times > 1], times[times > 1]
        nothing = [pa.nulls(len(grams), key_type), *[pa.nulls(len(grams), pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], names)

    for batch in batches:
        key_type = batch.schema.field(0).type
        for begin, end in chunks(batch.column(1)):
            sets = _Sets(batch.column(1), begin, end, size)
            n = end - begin
            about = [pa.array(sets.counts.astype(np.int64)), pa.array(sets.node, mask=sets.counts == 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(2).slice(begin, n), *about, *[pa.nulls(n, pa.int64())] * 2], names)
            kept.append(sets.grams[sets.once(seen)[sets.row]])
            total += len(kept[-1])
            if total > HELD_GRAMS:
                yield counted()
                kept, total, seen = [], 0, set()
    if kept:
        yield counted()


def _ordered(grams: np.ndarray, frequent: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Order keys: a gram's own name without its lowest bit, and for frequent ones their rank above all others."""
    keys = grams >> np.uint64(1)
    some = np.flatnonzero(maybe[(grams & np.uint64(len(maybe) - 1)).astype(np.int64)])
    if len(some):
        at = np.searchsorted(frequent, grams[some])
        at[at == len(frequent)] = 0
        hit = frequent[at] == grams[some]
        keys[some[hit]] = _HIGH | at[hit].astype(np.uint64)
    return keys


def _stars(e: np.ndarray, long: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Edges from the entries of ``long`` lists to the first of each; ``e`` is sorted by gram, ``group`` numbers its lists."""
    lead = np.searchsorted(group, group[long])
    edges = np.stack([e["node"][long], e["node"][lead]], axis=1)
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)


def _grouped(e: np.ndarray) -> np.ndarray:
    """Numbers of the lists of entries that are sorted by gram."""
    return np.cumsum(np.diff(e["gram"], prepend=e["gram"][:1]) != 0) if len(e) else np.zeros(0, np.int64)


def _entries(batches: Iterator[pa.RecordBatch], size: int, percent: int, lists: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index entries of each set's first grams by the part of the index they belong to, and edges of lists that are long already here."""
    maybe = np.zeros(1 << 22, bool)
    maybe[(frequent & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    kept, total, seen = [], 0, set()

    def rows(kind: str, x: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(part, kind="stable")
        x, cuts = x[order], np.searchsorted(part[order], np.arange(lists + 1))
        full = np.flatnonzero(np.diff(cuts))
        for k in range(0, len(full), 256):
            some = full[k : k + 256]
            blobs = [x[cuts[p] : cuts[p + 1]].tobytes() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array(blobs, pa.binary())], ["kind", "part", "entries"])

    def packed() -> Iterator[pa.RecordBatch]:
        e = np.concatenate(kept)
        e = e[np.argsort(e["gram"], kind="stable")]
        group = _grouped(e)
        long = (np.bincount(group, minlength=1) > LONG)[group]
        edges = _stars(e, long, group)
        first = np.diff(group, prepend=-1) != 0
        e["at"][long] |= _LEADS
        e = e[~long | first]
        yield from rows("entries", e, (mix(e["gram"]) % np.uint64(lists)).astype(np.int64))
        yield from rows("edges", edges, (mix(edges[:, 0].copy().view(np.uint64)) % np.uint64(lists)).astype(np.int64))

    for batch in batches:
        for begin, end in chunks(batch.column(1)):
            sets = _Sets(batch.column(1), begin, end, size)
            keys = _ordered(sets.grams, frequent, maybe)
            order = np.lexsort((keys, sets.row))
            keys, row = keys[order], sets.row[order]
            at = np.arange(len(keys)) - sets.first[:-1][row]
            n = sets.counts[row]
            used = (at < prefix(n, percent)) & sets.once(seen)[row]
            entries = np.zeros(int(used.sum()), _ENTRY)
            entries["gram"], entries["node"], entries["size"], entries["at"] = keys[used], sets.node[row[used]], n[used], at[used]
            kept.append(entries)
            total += len(entries)
            if total > HELD_GRAMS:
                yield from packed()
                kept, total, seen = [], 0, set()
    if kept:
        yield from packed()


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first grams of a set of n must be indexed."""
    return n - -(-n * percent // 100) + 1


def demanded(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of linked sets of these sizes: the least intersection, and how many of it lie in both prefixes."""
    least = -(-(a + b) * percent // (100 + percent))
    return least, np.minimum(prefix(a, percent) - a, prefix(b, percent) - b) + least


class _Counted:
    """Pairs with how often they were met, kept distinct as they grow."""

    def __init__(self) -> None:
        self.pairs = np.zeros((0, 3), np.int64)
        self.times = np.zeros(0, np.int64)
        self.fresh: list[np.ndarray] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> None:
        for low in range(0, len(a), HELD_PAIRS):
            some = slice(low, low + HELD_PAIRS)
            self.fresh.append(np.stack([np.minimum(a[some], b[some]), np.maximum(a[some], b[some]), need[some]], axis=1))
            self.waiting += len(self.fresh[-1])
            if self.waiting >= HELD_PAIRS:
                self.merge()

    def merge(self) -> None:
        whole = np.concatenate([self.pairs, *self.fresh])
        times = np.concatenate([self.times, np.ones(self.waiting, np.int64)])
        self.fresh, self.waiting = [], 0
        order = np.lexsort((whole[:, 1], whole[:, 0]))
        whole, times = whole[order], times[order]
        first = np.flatnonzero((np.diff(whole[:, 0], prepend=0) != 0) | (np.diff(whole[:, 1], prepend=0) != 0) | (np.arange(len(whole)) == 0))
        self.pairs = whole[first]
        self.times = np.add.reduceat(times, first) if len(first) else times


def block_pairs(e: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries that meet in a list, and what their pair needs; ``e`` is sorted by gram, size and position.

    A block is what has one gram, size and position. Blocks are compared with
    those behind them, one, two, three places on, until sizes are too far apart;
    of two that fit neither entry is touched unless their positions allow a link.
    """
    new = np.ones(len(e), bool)
    for c in ("gram", "size", "at"):
        new[1:] = (e[c][1:] != e[c][:-1]) | (new[1:] if c != "gram" else False)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(e)))
    gram, size, at = e["gram"][first], e["size"][first].astype(np.int64), e["at"][first].astype(np.int64)
    alive, step = np.arange(len(first)), 0
    while len(alive):
        alive = alive[alive + step < len(first)]
        other = alive + step
        inside = (gram[other] == gram[alive]) & (size[alive] * 100 >= size[other] * percent)
        alive = alive[inside]
        other = alive + step
        least, need = demanded(size[alive], size[other], percent)
        near = (at[alive] < size[alive] - least + need) & (at[other] < size[other] - least + need)
        a, b, need = alive[near], other[near], need[near]
        step += 1
        for low in range(0, len(a), 4096):
            x, y = a[low : low + 4096], b[low : low + 4096]
            met = count[x] * count[y]
            which = np.repeat(np.arange(len(x)), met)
            k = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
            i, j = first[x][which] + k // count[y][which], first[y][which] + k % count[y][which]
            once = i < j
            yield i[once], j[once], need[low : low + 4096][which[once]]


def _candidates(part: pa.Table, percent: int) -> pa.Table:
    """Pairs with shared first grams of one part of the index, and the edges of long lists."""
    is_edge = pc.equal(part.column("kind"), "edges")
    edges = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in part.filter(is_edge).column("entries")]
    e = np.concatenate([np.zeros(0, _ENTRY), *[np.frombuffer(x.as_py(), _ENTRY) for x in part.filter(pc.invert(is_edge)).column("entries")]])
    leads = e["at"] >= _LEADS
    e["at"] &= ~_LEADS
    order = np.lexsort((e["node"], e["at"], e["size"], e["gram"]))
    e, leads = e[order], leads[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["gram"][1:] != e["gram"][:-1]) | (e["node"][1:] != e["node"][:-1])
    group = _grouped(e)
    of_task = (np.bincount(group, weights=leads, minlength=1) > 0)[group]
    e, group, of_task = e[new], group[new], of_task[new]
    times = np.bincount(group, minlength=1)[group]
    long = of_task | (times > LONG)
    edges.append(_stars(e, long, group))
    e = e[~long & (times > 1)]
    counted, node = _Counted(), e["node"]
    for i, j, need in block_pairs(e, percent):
        counted.add(node[i], node[j], need)
    counted.merge()
    edges = np.concatenate(edges)
    nothing = np.zeros(len(edges), np.int64)
    columns = [(edges[:, 0], counted.pairs[:, 0]), (edges[:, 1], counted.pairs[:, 1]), (nothing, counted.times), (nothing, counted.pairs[:, 2])]
    return pa.table({name: np.concatenate(c) for name, c in zip(("a", "b", "shared", "need"), columns, strict=True)})


def consensus(sets: list[np.ndarray]) -> np.ndarray:
    """The grams of more than half of the sets, sorted."""
    grams, times = np.unique(np.concatenate(sets), return_counts=True)
    return grams[2 * times > len(sets)]


def difference(own: np.ndarray, common: np.ndarray) -> tuple[int, int, np.ndarray]:
    """How many grams of ``common`` a set lacks, how many it adds, and all of these grams."""
    apart = np.setxor1d(own, common, assume_unique=True)
    added = (len(apart) + len(own) - len(common)) // 2
    return len(apart) - added, added, apart


def alike(apart: list[np.ndarray]) -> np.ndarray:
    """How many grams any two of these differences have in common; grams of one of them alone add nothing."""
    grams = np.concatenate(apart)
    who = np.repeat(np.arange(len(apart)), [len(x) for x in apart])
    _, name, times = np.unique(grams, return_inverse=True, return_counts=True)
    everywhere = int((times == len(apart)).sum())
    some = (times > 1) & (times < len(apart))
    rank = np.cumsum(some) - 1
    who, name = who[some[name]], rank[name[some[name]]]
    order = np.argsort(name, kind="stable")
    name, who = name[order], who[order]
    total = np.zeros((len(apart), len(apart)), np.float32)
    last = int(name[-1]) + 1 if len(name) else 0
    for low in range(0, last, GRAMS_AT_ONCE):
        a, b = np.searchsorted(name, (low, low + GRAMS_AT_ONCE))
        held = np.zeros((len(apart), min(GRAMS_AT_ONCE, last - low)), np.float32)
        held[who[a:b], name[a:b] - low] = 1
        total += held @ held.T
    return total.astype(np.int64) + everywhere


def derived(f: np.ndarray, apart: list[np.ndarray], room: int, percent: int, sure: bool) -> np.ndarray:
    """Which members of a family link, from their differences; ``sure`` says whether to answer pairs that f alone decides."""
    both = f[:, None] + f[None, :]
    link = (both <= room) if sure else np.zeros(both.shape, bool)
    asked = np.flatnonzero((both > room).any(axis=1))
    if len(asked) > 1:
        inner = both[np.ix_(asked, asked)]
        link[np.ix_(asked, asked)] |= (inner > room) & ((100 + percent) * alike([apart[k] for k in asked]) + room >= inner)
    np.fill_diagonal(link, False)
    return link


def _reached(link: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of every member the one with the least rank that links reach."""
    a, b = np.nonzero(link)
    root, before = rank.copy(), None
    while before is None or (before != root).any():
        before = root.copy()
        np.minimum.at(root, a, root[b])
    return np.argsort(rank)[root]


def _ranks(cell: pa.Table) -> np.ndarray:
    """Places of the rows by key, null keys last, then by node."""
    order = pc.sort_indices(cell, sort_keys=[("doc", "ascending"), ("node", "ascending")]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task without repeats of a set in a cell."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "pack", "cell")], strict=True)
        fresh = []
        for key in keys:
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))


_ANSWER = "links long, root_doc {kind}, root long, m long, a long, b long, apart binary"
_ANSWERS = ("node", "doc", "family", "copies", "links", "root_doc", "root", "m", "a", "b", "apart")


def _answers(cell: pa.Table, rows: np.ndarray, **values: pa.Array) -> pa.Table:
    some = cell.take(pa.array(rows))
    given = {c: some.column(c) for c in ("node", "doc", "family", "copies")} | values
    kinds = {"root_doc": cell.schema.field("doc").type, "apart": pa.binary()}
    return pa.table({c: given[c] if c in given else pa.nulls(len(rows), kinds.get(c, pa.int64())) for c in _ANSWERS})


def _answered(cell: pa.Table, size: int, percent: int) -> pa.Table:
    """Links of the families of a cell, or of one large family's share what each of its sets differs in."""
    large = cell.column("large")[0].as_py()
    texts = cell.column("content").combine_chunks()
    sets = _Sets(texts, 0, len(texts), size)
    node, family, copies, reference, block = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("node", "family", "copies", "reference", "block"))
    order = np.lexsort((node, family))
    order = order[sets.node[order] == node[order]]
    order = order[np.diff(node[order], prepend=node[order][:1] - 1) != 0]
    if large:
        of_all = [sets.of(r) for r in order if reference[r]]
        common = consensus(of_all) if of_all else np.zeros(0, np.uint64)
        own = order[block[order] == cell.column("cell")[0].as_py()]
        found = [difference(sets.of(r), common) for r in own]
        columns = {"a": pa.array([x for x, _, _ in found], pa.int64()), "b": pa.array([x for _, x, _ in found], pa.int64())}
        return _answers(cell, own, m=pa.array([len(common)] * len(own), pa.int64()), apart=pa.array([x.tobytes() for _, _, x in found], pa.binary()), **columns)
    rank = _ranks(cell)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(family[order])) + 1, [len(order)]])
    out = [_answers(cell, order[:0])]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        rows = order[begin:end]
        if len(rows) < 2:
            continue
        common = consensus([sets.of(r) for r in rows[:REFERENCES]])
        found = [difference(sets.of(r), common) for r in rows]
        f = np.array([100 * a + percent * b for a, b, _ in found])
        link = derived(f, [x for _, _, x in found], (100 - percent) * len(common), percent, True)
        out.append(_told(cell, rows, link, copies[rows], rank[rows]))
    return pa.concat_tables(out)


def _told(cell: pa.Table, rows: np.ndarray, link: np.ndarray, copies: np.ndarray, rank: np.ndarray) -> pa.Table:
    """Numbers of links of the rows that have some, and whom they reach."""
    links = link.astype(np.int64) @ copies
    place = np.argsort(np.argsort(rank))
    root = rows[_reached(link, place)]
    some = np.flatnonzero(links > 0)
    reached = cell.take(pa.array(root[some]))
    return _answers(cell, rows[some], links=pa.array(links[some]), root_doc=reached.column("doc"), root=reached.column("node"))


def _unsure(cell: pa.Table, percent: int) -> pa.Table:
    """Links of pairs of a large family that f alone does not decide, of two blocks or within one."""
    one = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    f, copies, block = (cell.column(c).to_numpy() for c in ("f", "copies", "block"))
    apart = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("apart")]
    link = derived(f, apart, cell.column("room")[0].as_py(), percent, False)
    if not one:
        link &= block[:, None] != block[None, :]
    return _told(cell, np.arange(len(f)), link, copies, _ranks(cell))


def _vertex(node: str, doc: str) -> F.Column:
    """A set as a vertex: ordered by its smallest key, sets without one last."""
    return F.struct(F.col(doc).isNull().alias("no_key"), F.col(doc).alias("doc"), F.col(node).alias("node"))


def ngram_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``key``, n_shingles, component_id and n_links of every row.

    Two documents link when 100 times the size of their sets' intersection is at
    least ``percent`` times that of the union. A text with fewer words than
    ``size`` has its whole sequence as its one gram; null texts and texts without
    words have an empty set and link with nothing. Equal sets always link.
    component_id is the smallest key reachable by links, n_links the number of
    other rows linked. Rows are told apart by key and text: a repeated row counts
    as often as it occurs, and a key with several texts is in as many places. Rows
    with a null key have a null component, but connect and count as others do.
    Other columns are left out. An empty table gives no rows. What is broadcast
    is a list of about ``FREQUENT`` grams, which only bends the order and no
    result, and the labels of at most ``HOT_SETS`` sets that hold one in
    ``HOT_SETS`` of all rows each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    rows = rows.withColumn("row", F.xxhash64("doc", "content"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, row long, n long, node long, gram long, times long"
    described = keep(rows.mapInArrow(lambda it: _described(it, size), schema), "gram-sets")
    sets = described.where("times is null").select("doc", "row", "n", "node")
    counts = keep(described.where("times is not null").groupBy("gram").agg(F.sum("times").alias("times")), "gram-counts")
    often = most_frequent(counts, "gram", "times", FREQUENT).toPandas()["gram"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(often.astype(np.int64).view(np.uint64)))
    total = sets.agg(F.sum("n")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = max(2 * width, -(-total * (100 - percent) // 100 // LIST_ENTRIES))
    entries = rows.select("doc", "content").mapInArrow(lambda it: _entries(it, size, percent, lists, frequent.value), "kind string, part long, entries binary")
    found = entries.groupBy("part").applyInArrow(lambda part: _candidates(part, percent), "a long, b long, shared long, need long")
    pairs = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.min("need").alias("free"))
    families = components(pairs.where("shared >= need or free = 0"), "a", "b")
    nodes = keep(sets.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.min("row").alias("row"), F.count("*").alias("copies")), "sets")
    verified = _verified(rows, nodes, families, size, percent)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    edges = verified.where("root is not null").select(_vertex("node", "doc").alias("one"), _vertex("root", "root_doc").alias("other"))
    labels = components(edges, "one", "other").select(F.col("vertex.node").alias("node"), F.col("component.doc").alias("least"))
    of_node = nodes.join(labels, "node", "left").join(links, "node", "left").where("copies > 1 or links is not null")
    of_node = of_node.select("node", "copies", F.coalesce("least", "doc").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_node = keep(of_node, "set-labels")
    hot = F.col("copies") * HOT_SETS > sets.count()  # so at most HOT_SETS of them
    common, others = F.broadcast(of_node.where(hot).drop("copies")), of_node.where(~hot).drop("copies")
    alone = sets.where("node is null").withColumns({"component": F.lit(None).cast(rows.schema["doc"].dataType), "n_links": F.lit(None).cast("long")})
    rest = sets.where("node is not null").join(common, "node", "left_anti").join(others, "node", "left")
    joined = sets.join(common, "node").unionByName(rest).unionByName(alone)
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return joined.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _verified(rows: DataFrame, nodes: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """Numbers of links of every set with others of its family, and edges that connect what links.

    A small family is answered whole in a cell of some families. A large one is
    dealt to cells of about BLOCK sets, each with the family's reference sets.
    """
    members = keep(families.select(F.col("vertex").alias("node"), F.col("component").alias("family")).join(nodes, "node"), "family-members")
    sizes = members.groupBy("family").agg(F.count("*").alias("of_family"))
    packs = max(1, members.count() // CELL_SETS)
    blocks = F.ceil(F.col("of_family") / BLOCK).cast("int")
    placed = members.join(sizes, "family").withColumns({"large": F.col("of_family") > BLOCK, "blocks": blocks})
    placed = placed.withColumns({
        "block": F.when(F.col("large"), F.pmod(F.xxhash64("node"), "blocks").cast("int")).otherwise(0),
        "pack": F.when(F.col("large"), F.col("family")).otherwise(F.pmod("family", F.lit(packs))),
        "reference": F.col("large") & (F.pmod(F.xxhash64("node", F.lit(1)), "of_family") < REFERENCES),
    })
    cells = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    wanted = placed.select("row", "doc", "node", "family", "copies", "large", "pack", "block", "reference", F.explode(cells).alias("cell"))
    asked = rows.select("row", "content").join(wanted.hint("shuffle_hash"), "row").drop("row")
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"node long, doc {kind}, family long, copies long, " + _ANSWER.format(kind=kind)
    met = asked.mapInArrow(_once, asked.schema).groupBy("large", "pack", "cell").applyInArrow(lambda cell: _answered(cell, size, percent), schema)
    met = keep(met, "links")
    small = met.where("apart is null").select("node", "doc", "links", "root_doc", "root")
    apart = met.where("apart is not null")
    if not apart.limit(1).count():
        return small
    return small.unionByName(_of_large(apart, percent, kind))


def _of_large(apart: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links within large families, from what their sets differ in.

    Pairs that f decides are counted by the family's sums over f, and connected
    through the set with the least f, which links to all that have such a pair.
    The others have one set at least with more than half of the room ("far"):
    its block meets the blocks of all that could make a pair with it.
    """
    d = apart.withColumns({"room": (100 - percent) * F.col("m"), "f": 100 * F.col("a") + percent * F.col("b"), "g": percent * F.col("a") + 100 * F.col("b")})
    d = d.drop("links", "root_doc", "root").withColumn("far", 2 * F.col("f") > F.col("room"))
    far_f = F.when(F.col("far"), F.col("f"))
    stats = d.groupBy("family").agg(
        F.min(F.struct("f", F.col("doc").isNull(), F.col("doc").alias("doc"), F.col("node").alias("node"))).alias("lead"),
        F.min(far_f).alias("far_from"), F.max(far_f).alias("far_to"), F.count(far_f).alias("n_far"),
    )
    d = keep(d.join(stats, "family"), "family-differences")
    sums = d.groupBy("family", "f", "room").agg(F.sum("copies").alias("copies"))
    held = sums.select("family", F.col("f").alias("x"), F.col("copies").alias("n"), F.lit(None).cast("long").alias("asks"))
    asks = sums.select("family", (F.col("room") - F.col("f")).alias("x"), F.lit(0).cast("long").alias("n"), F.col("f").alias("asks"))
    upto = Window.partitionBy("family").orderBy("x", F.col("asks").isNotNull(), "asks").rowsBetween(Window.unboundedPreceding, 0)
    told = held.unionByName(asks).withColumn("upto", F.sum("n").over(upto)).where("asks is not null").select("family", F.col("asks").alias("f"), "upto")
    itself = F.when(~F.col("far"), F.col("copies")).otherwise(0)
    sure = d.join(told, ["family", "f"]).withColumn("links", F.col("upto") - itself)
    near_lead = (F.col("f") + F.col("lead.f") <= F.col("room")) & (F.col("node") != F.col("lead.node"))
    sure = sure.where("links > 0").select("node", "doc", "links", F.when(near_lead, F.col("lead.doc")).alias("root_doc"), F.when(near_lead, F.col("lead.node")).alias("root"))
    could = F.col("far") | ((F.col("f") + F.col("far_to") > F.col("room")) & (F.col("g") >= F.col("far_from") - F.col("room")))
    open_ = d.where((F.col("n_far") > 0) & could)
    n_open = open_.groupBy("family").agg(F.count(F.when(~F.col("far"), 1)).alias("n_near"))
    open_ = open_.join(n_open, "family").withColumns({"far_blocks": F.ceil(F.col("n_far") / BLOCK).cast("int"), "near_blocks": F.ceil(F.col("n_near") / BLOCK).cast("int")})
    open_ = open_.withColumn("block", F.when(F.col("far"), F.pmod(F.xxhash64("node"), "far_blocks")).otherwise(-1 - F.pmod(F.xxhash64("node"), "near_blocks")).cast("int"))
    ends = F.when(F.col("far"), F.sequence(-F.col("near_blocks"), F.col("far_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("far_blocks") - 1))
    open_ = open_.withColumn("end", F.explode(ends))
    open_ = open_.withColumns({"i": F.least("block", "end"), "j": F.greatest("block", "end")})
    open_ = open_.select("node", "doc", "family", "copies", "room", "f", "block", "i", "j", "apart")
    schema = f"node long, doc {kind}, family long, copies long, " + _ANSWER.format(kind=kind)
    unsure = open_.groupBy("family", "i", "j").applyInArrow(lambda cell: _unsure(cell, percent), schema)
    return sure.unionByName(keep(unsure.select("node", "doc", "links", "root_doc", "root"), "links-unsure"))
