"""Near copies by Jaccard similarity of word shingles: the SimHash operator's form with a similarity in place of a radius.

Two texts are linked when the sets of their `size`-word shingles (ASCII lower case) have similarity 4/5 or more;
components of links are groups. Fingerprints alone cannot decide this (at 64 bits such pairs differ in 5 to 13 bits), so
the Gray-order index gives the first candidates, a filter that loses no pair gives the others, and the sets decide:

* Equal sets are one set (64-bit key). Fingerprint links (simhash.py) are candidates.
* Shingles have one global order, those frequent in a sixteenth of the sets last; the order decides cost only. A set of n
  shingles lacks at most n - ceil(4n/5) of them in a linked one, so the first COMMON shingles that two linked sets share lie
  among the first n - ceil(4n/5) + COMMON of each. A set is filed under these, and a pair that meets less often than COMMON
  times (than its overlap, if smaller) is no candidate, nor is one whose sizes or positions leave too little overlap.
* A shingle with few such pairs (PAIRS for each of its sets) has them all compared. A shingle with more of them, or so
  frequent in the sample that it may have more than BOUND sets, is hot: while the sets outside the shingles' largest
  components have more than FEW partners, the sets are first compared with one of each shingle (a hub, another in each
  round). Then all sets of hot shingles that have one hub form a class, whose sets that are not in one component yet are
  compared, however often they meet. A class beyond BLOCK sets (MEMBERS shingles) is dealt in pairs of blocks, none
  gathered in one task. A task settles its components as it goes, so a group of near copies costs a few searches rather
  than all pairs, and reports a spanning star for each component, never pairs.
* Each set has a sketch: the counts of its shingles over 2^k cells, k by its size. The cells' least counts add up to at
  least the common shingles, so a pair whose sketches leave too little overlap is dropped before its texts are read again.
* A comparison counts the common shingles of both sets.

Defined results: null or empty text: the empty set, all linked. Fewer words than a shingle: the whole word sequence is
the one shingle. Null doc_id and repeated rows as in simhash.py. Extra columns stay, whatever their names. Empty table:
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bpe import slices
from docaudit.llm.common import broadcast_within, materialise
from docaudit.llm.graph import stars
from docaudit.llm.simhash import _settle, fingerprint, links
from docaudit.llm.substring import Suffixes, _mix, _out, _runs

SIZE, COMMON = 5, 4
_PART = 1 << 19
#: A shingle counts as frequent from so many sets of the sixteenth; at most so many are told to the tasks.
FREQUENT, TOLD = 4, 200_000
#: Sets, and candidate pairs for each set, beyond which a shingle is hot; rounds of hubs at most, and pairs of hot shingles
#: that may be compared without further hubs.
BOUND, PAIRS, HUB_ROUNDS, FEW = 100_000, 32, 4, 3e7
#: Sets and shingles that a block of a class should hold at most; cells of a task's tables and elements it looks up at a time.
BLOCK, MEMBERS, _CELLS = 2_000, 1_000_000, 1 << 22
_ROWS = "s bigint, key bigint, n bigint, pos bigint"


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and shingle of each set member (sorted by both), and key and size of each text's set."""
    s = Suffixes(pa.compute.ascii_lower(column), size, size)
    s.index()
    counts = np.diff(s.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = s.path(s.first[short], counts[short]) if len(short) else np.zeros(0, np.uint64)
    text, shingle = np.concatenate([s.text, short]), np.concatenate([s.anchors, whole])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[fresh], shingle[fresh]
    keys = np.zeros(len(counts), np.uint64)
    np.add.at(keys, text, _mix(shingle ^ np.uint64(0x9E3779B97F4A7C15)))
    return text, shingle, keys, np.bincount(text, minlength=len(counts))


def sketches(text: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> pa.Array:
    """One byte for each cell: how many shingles of the set fall into it. Two to four shingles a cell on average; null for a
    set with 255 or more in one cell."""
    cells = 1 << np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - 2, 0)
    first = np.concatenate([[0], np.cumsum(cells)])
    at = first[text] + (_mix(shingle) & (cells[text] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(at, minlength=first[-1])
    found = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.minimum(counts, 255).astype(np.uint8))])
    over = np.maximum.reduceat(counts, first[:-1]) > 254 if len(n) else np.zeros(0, bool)
    return pa.compute.if_else(pa.array(over), pa.scalar(None, pa.binary()), found)


def _folded(counts: np.ndarray, cells: int) -> np.ndarray:
    return counts.reshape(-1, cells).sum(axis=0, dtype=np.int64)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch of a, sketch of b) -> a, b of those that may have similarity 4/5."""
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].as_buffer() for c in (2, 3))
            if x is not None and y is not None:
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                cells = min(len(x), len(y))
                x, y = _folded(x, cells), _folded(y, cells)
                keep[i] = 9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum())
        yield batch.select([0, 1]).filter(pa.array(keep))


def _marked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, _PART):
                text, shingle, keys, n = shingle_sets(part.column(2), size)
                fps = np.array([fingerprint(x.as_py(), size) for x in part.column(2)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64)), sketches(text, shingle, n)], names=["doc_id", "text_key", "key", "fp", "sketch"])

    return run


def _members(size: int):
    """key and shingles of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _PART):
                _, shingle, keys, n = shingle_sets(part.column(0), size)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(shingle.view(np.int64)))], names=["key", "members"])

    return run


def _within(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def _filed(size: int, frequent: np.ndarray, hot: np.ndarray, want_hot: bool):
    """The first shingles of each set in the global order (of the hot shingles, or the others), with the set's size and the
    shingle's position. A task files a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for part in slices(batch, 0, _PART):
                text, shingle, keys, n = shingle_sets(part.column(0), size)
                new = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in known:
                        known.add(k)
                        new[i] = True
                mine = new[text]
                text, shingle = text[mine], shingle[mine]
                if not len(text):
                    continue
                start = np.concatenate([[True], text[1:] != text[:-1]])
                order = np.lexsort((shingle, _within(frequent, shingle), text))
                pos = np.arange(len(text)) - np.maximum.accumulate(np.where(start, np.arange(len(text)), 0))
                first = pos < (n - (4 * n + 4) // 5 + COMMON)[text]
                text, shingle, pos = text[order][first], shingle[order][first], pos[first]
                side = _within(hot, shingle) == want_hot
                text, shingle, pos = text[side], shingle[side], pos[side]
                yield from _out({"s": shingle, "key": keys[text], "n": n[text].astype(np.int64), "pos": pos.astype(np.int64)})

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle and set -> those whose shingle another set has, each set once. Rows stream through."""
    held, kept = None, False  # the last row so far, and whether its shingle was met before it
    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        s, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if not len(s):
            continue
        fresh_ = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
        rows = rows.filter(pa.array(fresh_))
        s = s[fresh_]
        same = s[1:] == s[:-1]
        yes = np.concatenate([[kept], same]) | np.concatenate([same, [False]])
        if len(s) > 1:
            kept = bool(same[-1])
            out = rows.slice(0, len(s) - 1).filter(pa.array(yes[:-1]))
            if out.num_rows:
                yield out
        held = rows.slice(len(s) - 1)
    if held is not None and kept:
        yield held


def _may_link(n, pos, m, place):
    """Whether sets of n and m shingles that share one at these positions may reach similarity 4/5."""
    return 9 * (np.minimum(pos, place) + np.minimum(n - pos, m - place)) >= 4 * (n + m)


def _cold_pairs(per_set: int):
    """All pairs of the shingles that have few, with how often they meet and how often they must; the shingles that have
    more, as rows with s alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            s, key, n, pos = (rows.column(i).to_numpy() for i in range(4))
            head = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.cumsum(head) - 1
            size = np.bincount(group)
            end = np.cumsum(size)[group]
            count = np.zeros(len(size), np.int64)
            held: list[np.ndarray] = []
            at, step = np.flatnonzero(end > np.arange(len(s)) + 1), 1
            while len(at):
                yes = at[_may_link(n[at], pos[at], n[at + step], pos[at + step])]
                held.append(np.stack([yes, yes + step]))
                count += np.bincount(group[yes], minlength=len(size))
                step += 1
                at = at[(end[at] > at + step) & (count[group[at]] <= per_set * size[group[at]])]
            many = count > per_set * size
            a, b = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            cold = ~many[group[a]]
            a, b = a[cold], b[cold]
            x, y = key[a], key[b]
            need = np.minimum(COMMON, (4 * np.maximum(n[a], n[b]) + 4) // 5)
            found, times = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), need], 1), axis=0, return_counts=True)
            hot = s[head][many]
            none = pa.nulls(len(hot), pa.int64())
            low, high, need = (np.ascontiguousarray(found[:, i]) for i in range(3))
            yield from _out({"a": low, "b": high, "times": times.astype(np.int64), "need": need, "s": pa.nulls(len(found), pa.int64())})
            yield from _out({"a": none, "b": none, "times": none, "need": none, "s": hot})

    return run


def _sets(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """key and members of the sets of texts(w_text)."""
    texts = materialise(texts, "compared-texts")
    found = docs.join(broadcast_within(texts, 500_000), F.xxhash64("text") == F.col("w_text"), "left_semi").select("text")
    return materialise(found.mapInArrow(_members(size), "key bigint, members array<bigint>").dropDuplicates(["key"]), "compared-sets")


def _linked(docs: DataFrame, marked: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs of keys whose sets have similarity 4/5 or more."""
    wanted = broadcast_within(pairs.select(F.explode(F.array("a", "b")).alias("w_key")).distinct(), 500_000)
    known = marked.join(wanted, F.col("key") == F.col("w_key")).groupBy("key").agg(F.min("text_key").alias("text_key"), F.any_value("sketch").alias("sketch"))
    known = materialise(known, "sketches")
    one, two = (known.select(F.col("key").alias(f"{x}_key"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("a_key")).join(two, F.col("b") == F.col("b_key"))
    pairs = materialise(both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(_possible, "a bigint, b bigint"), "possible-pairs")
    left = pairs.select(F.explode(F.array("a", "b")).alias("w_key")).distinct()
    texts = known.join(left, F.col("key") == F.col("w_key"), "left_semi").select(F.col("text_key").alias("w_text")).distinct()
    sets = _sets(docs, texts, size)
    one, two = (sets.select(F.col("key").alias(f"{x}_key"), F.col("members").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("a_key")).join(two, F.col("b") == F.col("b_key"))
    return both.where(9 * F.size(F.array_intersect("a_set", "b_set")) >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b")


def _between(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Candidate pairs of rows and others (s, key, n, pos, root) that share a hot shingle and are in different components."""
    o = others.select("s", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "pos", "root")])
    able = 9 * (F.least("pos", "o_pos") + F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos"))) >= 4 * (F.col("n") + F.col("o_n"))
    met = rows.join(o, "s").where((F.col("root") != F.col("o_root")) & able)
    return met.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b")).distinct()


def _spanning(root: np.ndarray, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets (members ids[first[i] : first[i + 1]], component root[i]), smallest first -> stars (member, centre) that join the
    components which links between the sets bring together."""
    n, wide = np.diff(first), int(ids.max()) + 1
    _, head, back = np.unique(root, return_index=True, return_inverse=True)
    labels = head[back]
    # sets from i + 1 to reach[i] - 1 are not too large for i
    reach = np.searchsorted(4 * n, 5 * n, "right")
    at, step = 0, 8
    while at < len(n):
        last = min(len(n), at + step)
        who = np.arange(at, last)
        x = np.repeat(who, reach[at:last] - who - 1)
        y = np.arange(len(x)) - np.repeat(np.cumsum(reach[at:last] - who - 1) - reach[at:last], reach[at:last] - who - 1)
        other = labels[x] != labels[y]
        x, y = x[other], y[other]
        if len(x):
            has = np.zeros((last - at, wide), bool)
            has[np.repeat(who - at, n[at:last]), ids[first[at] : first[last]]] = True
            common, ends = np.zeros(len(x), np.int64), np.cumsum(n[y])
            part = 0
            while part < len(x):
                end = max(part + 1, int(np.searchsorted(ends, (ends[part - 1] if part else 0) + _CELLS, "right")))
                m = n[y[part:end]]
                starts = np.cumsum(m) - m
                hit = has[np.repeat(x[part:end] - at, m), ids[np.repeat(first[y[part:end]] - starts, m) + np.arange(m.sum())]]
                common[part:end] = np.add.reduceat(hit, starts, dtype=np.int64)
                part = end
            linked = 9 * common >= 4 * (n[x] + n[y])
            labels = _settle(labels, x[linked], y[linked])
        at, step = last, max(1, min(2 * step, 64, 8 * _CELLS // wide, _CELLS // len(n)))
    moved = head[labels[head] != head]
    return moved, labels[moved]


def _class_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, key, root, members) sorted by g -> stars (a, b) over the links of each g."""
    for rows in _runs(batches):
        rows = rows.combine_chunks()
        g, key, root = (rows.column(i).to_numpy() for i in range(3))
        members = rows.column(3).combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        offsets, values = members.offsets.to_numpy(), members.values.to_numpy()
        found = []
        cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low > 1 and (root[low:high] != root[low]).any():
                n = np.diff(offsets[low : high + 1]).astype(np.int64)
                order = np.argsort(n, kind="stable")
                first = np.concatenate([[0], np.cumsum(n[order])])
                take = np.repeat(offsets[low:high][order] - first[:-1], n[order]) + np.arange(first[-1])
                a, b = _spanning(root[low:high][order], first, np.unique(values[take], return_inverse=True)[1])
                found.append((key[low:high][order][a], key[low:high][order][b]))
        if found:
            yield from _out({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def _within_classes(docs: DataFrame, marked: DataFrame, placed: DataFrame, size: int, block: int) -> DataFrame:
    """Stars over the links between rows of placed (s, key, n, root) that share an s and are in different components."""
    hubs = placed.groupBy("s").agg(F.min_by("key", F.xxhash64("key")).alias("hub"))
    classes = materialise(placed.join(hubs, "s").select("hub", "key", "n", "root").distinct(), "classes")
    sizes = classes.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"), F.countDistinct("root").alias("roots")).where("roots > 1")
    blocks = sizes.select("hub", F.ceil(F.greatest(F.col("sets") / block, F.col("shingles") / MEMBERS)).cast("bigint").alias("blocks"))
    classes = classes.join(broadcast_within(blocks, 500_000), "hub")
    wanted = broadcast_within(classes.select(F.col("key").alias("w_key")).distinct(), 500_000)
    sets = _sets(docs, marked.join(wanted, F.col("key") == F.col("w_key")).groupBy("key").agg(F.min("text_key").alias("w_text")).select("w_text").distinct(), size)
    own, other = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")), F.col("other")
    dealt = classes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("blocks = 1 OR own <> other")
    dealt = dealt.select(F.xxhash64("hub", F.least("own", other), F.greatest("own", other)).alias("g"), "key", "root")
    rows = dealt.join(sets, "key").select("g", "key", "root", "members").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(_class_links, "a bigint, b bigint")


def near_copies(docs: DataFrame, *, size: int = SIZE, bound: int = BOUND, per_set: int = PAIRS, few: float = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, group (a set's key) for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    marked = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_marked(size), "doc_id bigint, text_key bigint, key bigint, fp bigint, sketch binary"), "sets")
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text")
    members = sample.mapInArrow(_members(size), "key bigint, members array<bigint>").dropDuplicates(["key"])
    counted = members.select(F.explode("members").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    told = counted.orderBy(F.desc("count"), "s").limit(TOLD).select("s", "count").toArrow()
    shingles, often = told.column("s").to_numpy().astype(np.int64).view(np.uint64), told.column("count").to_numpy()
    frequent, hot = np.sort(shingles), np.sort(shingles[16 * often > bound])
    filed = lambda want_hot: docs.select("text").mapInArrow(_filed(size, frequent, hot, want_hot), _ROWS)
    met = materialise(filed(False).repartition("s").sortWithinPartitions("s", "key").mapInArrow(_met, _ROWS), "met")

    # fingerprint links: of the sets of one fingerprint the least stands for all
    prints = materialise(marked.groupBy("fp").agg(F.min("key").alias("least"), F.max("key").alias("most")), "fingerprints")
    stands = prints.select("fp", "least")
    near = links(prints.select("fp"), prints.count()).join(stands.toDF("a", "x"), "a").join(stands.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = marked.join(prints.where("least <> most").select("fp", "least"), "fp").select(F.col("least").alias("a"), F.col("key").alias("b"))
    first = near.unionByName(same).where("a <> b").distinct()

    found = materialise(met.repartition("s").sortWithinPartitions("s").mapInArrow(_cold_pairs(per_set), "a bigint, b bigint, times bigint, need bigint, s bigint"), "pairs")
    often = found.where("s IS NULL").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need")
    edges = _linked(docs, marked, materialise(often.select("a", "b").unionByName(first).distinct(), "pairs"), size)
    edges = materialise(edges, "links")
    roots = stars(edges)

    crowded = found.where("s IS NOT NULL").select("s")
    rows = met.join(broadcast_within(crowded, 500_000), "s", "left_semi") if crowded.limit(1).count() else None
    if len(hot):
        more = filed(True).dropDuplicates(["s", "key"])
        rows = more if rows is None else rows.unionByName(more)
    if rows is not None:
        rows = materialise(rows, "hot-rows")
        for salt in range(HUB_ROUNDS + 1):
            placed = rows.join(roots, F.col("key") == F.col("node"), "left").select("s", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
            largest = placed.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
            left = largest.agg(F.sum((F.col("all") - F.col("most")).cast("double") * F.col("all"))).first()[0] or 0.0
            last = salt == HUB_ROUNDS or left <= few
            if last:
                new = _within_classes(docs, marked, placed.join(largest.where(F.col("all") > F.col("most")).select("s"), "s"), size, block)
            else:
                hub = placed.groupBy("s").agg(F.min_by(F.struct("key", "n", "pos", "root"), F.xxhash64("key", F.lit(salt))).alias("h")).select("s", "h.*")
                new = _linked(docs, marked, materialise(_between(placed, hub), "pairs"), size)
            new = materialise(new, "links")
            if new.limit(1).count():
                edges = edges.unionByName(new)
                roots = stars(edges)
            if last:
                break
    return marked.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "key").alias("group"))
