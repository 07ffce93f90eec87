"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints (64 bits, majority of the XXH64 bits of word shingles) that differ in at most `radius` bits are linked;
components of links are groups. Only distinct fingerprints are compared. Their bits are cut into `bands`; two linked
fingerprints agree in at least bands - radius of them, so all fingerprints that agree in some such choice of bands
meet in one bucket and no link is lost; the number of bands grows with the number of fingerprints so that buckets stay
small, and the fingerprints of buckets that hold more than HOT (counted first) are filed again by more bands. Within a bucket the fingerprints are sorted by Gray rank and indexed: neighbours form groups, whose shared bits
(mask and pattern) are factored into their parent node, level over level. A search goes down with the difference
accumulated so far and drops a whole group once it exceeds the radius. It also drops groups that are wholly in the
searcher's component already, so a bucket of near copies costs a few searches rather than all pairs. The trees of many
buckets are built and searched side by side, small buckets no otherwise than large ones; a bucket reports a spanning star for each component rather than its pairs. Components over all buckets come from
distributed star contraction (graph.py).

Defined results: null or empty text: fingerprint 0, linked like any other. Fewer words than a shingle: the whole word
sequence is the one shingle. Null doc_id: gets its group's id; a group of null ids only has component_id null. Repeated
rows: one result each. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docaudit.llm.common import broadcast_within, fresh, materialise, table
from docaudit.llm.graph import stars

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a bucket should hold at most on average; decides the number of bands.
BUCKET = 2_000
#: Fingerprints of one bucket beyond which they are filed by more bands, up to radius + MORE of them.
HOT, MORE = 50_000, 8
_FAN = 8
#: Open nodes of a search that a step should not exceed.
_FRONT = 1 << 18


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[part : part + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp bigint (the fingerprint's bits) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), size, seed) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the components of a[i] and b[i]; a label is the least position of its component."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


class GrayIndex:
    """Trees over the fingerprints of buckets, in Gray order. levels[0] are the fingerprints, bucket by bucket; a node of level k
    has up to _FAN nodes of level k - 1, all of its bucket. Every bucket has at most _FAN nodes at the top."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray) -> None:
        """fps: distinct within each bucket; bucket: the number of each one's bucket."""
        order = np.lexsort((gray_rank(fps), bucket))
        self.fps, seg = fps[order], bucket[order]
        masks, patterns, self.first, self.end = [np.full(len(fps), ~np.uint64(0))], [self.fps], [], [np.arange(1, len(fps) + 1)]
        while True:
            head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sizes = np.diff(np.append(head, len(seg)))
            if sizes.max() <= _FAN:
                break
            starts = np.flatnonzero((np.arange(len(seg)) - np.repeat(head, sizes)) % _FAN == 0)
            both, some = np.bitwise_and.reduceat(patterns[-1], starts), np.bitwise_or.reduceat(patterns[-1], starts)
            same = np.bitwise_and.reduceat(masks[-1], starts) & ~(some ^ both)
            self.first.append(starts)
            self.end.append(self.end[-1][np.append(starts[1:], len(seg)) - 1])
            masks.append(same)
            patterns.append(both & same)
            seg = seg[starts]
        self.top = np.repeat(head, sizes), np.repeat(sizes, sizes)
        # what a node tests beyond the bits that its parent shares
        self.own = [m & ~np.repeat(up, np.diff(np.append(at, len(m)))) for m, up, at in zip(masks, masks[1:], self.first, strict=False)] + [masks[-1]]
        self.patterns = patterns
        # the top nodes of each fingerprint's bucket: first and number
        node = np.arange(len(self.patterns[-1]))
        leaves = np.diff(np.concatenate([[0], self.end[-1]]))
        self.roots, self.width = np.repeat(self.top[0][node], leaves), np.repeat(self.top[1][node], leaves)

    def _search(self, first: int, last: int, labels: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs (searcher, found) within the radius, found behind the searcher and outside its component; the widest front."""
        pure = [labels]
        for starts in self.first:
            low, high = np.minimum.reduceat(pure[-1], starts), np.maximum.reduceat(pure[-1], starts)
            pure.append(np.where((low != high) | (low < 0), -1, low))
        width = self.width[first:last]
        who = np.repeat(np.arange(first, last), width)
        node = np.repeat(self.roots[first:last] - np.cumsum(width) + width, width) + np.arange(len(who))
        far, widest = np.zeros(len(who), np.uint8), 0
        for level in range(len(self.first), -1, -1):
            live = (self.end[level][node] > who + 1) & (pure[level][node] != labels[who])
            who, node, far = who[live], node[live], far[live]
            far = far + np.bitwise_count((self.fps[who] ^ self.patterns[level][node]) & self.own[level][node])
            live = far <= radius
            who, node, far = who[live], node[live], far[live]
            widest = max(widest, len(who))
            if level:
                starts = self.first[level - 1]
                n = np.append(starts[1:], len(self.own[level - 1]))[node] - starts[node]
                at = starts[node]
                who, far = np.repeat(who, n), np.repeat(far, n)
                node = np.repeat(at - np.cumsum(n) + n, n) + np.arange(len(who))
        return who, node, widest

    def components(self, radius: int) -> np.ndarray:
        """For each fingerprint (in the order of fps) the least position of its component."""
        labels, first, step = np.arange(len(self.fps)), 0, 64
        while first < len(labels):
            last = min(len(labels), first + step)
            who, found, widest = self._search(first, last, labels, radius)
            labels = _settle(labels, who, found)
            first, step = last, min(2 * step, 1 << 14) if widest < _FRONT else max(1, step // 4)
        return labels


def link_stars(fps: np.ndarray, radius: int = RADIUS, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, distinct within their buckets -> spanning stars (member, centre) of the components of each bucket's links."""
    if not len(fps):
        return fps, fps
    bucket = np.zeros(len(fps), np.int64) if bucket is None else bucket
    _, bucket, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    members, centres = [], []
    # buckets of equal height stand side by side
    height = np.ceil(np.log(np.maximum(sizes, 2)) / np.log(_FAN)).astype(int)[bucket]
    for h in np.unique(height[sizes[bucket] > 1]):
        here = (height == h) & (sizes[bucket] > 1)
        index = GrayIndex(fps[here], bucket[here])
        labels = index.components(radius)
        moved = labels != np.arange(len(labels))
        members.append(index.fps[moved])
        centres.append(index.fps[labels[moved]])
    return (np.concatenate(members), np.concatenate(centres)) if members else (fps[:0], fps[:0])


def band_plan(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[int, list[tuple[int, ...]]]:
    """Number of bands, and the choices of bands that make a bucket key; enough bits for n fingerprints."""
    bands = radius + 1
    while bands < radius + 4 and n / 2 ** (64 * (bands - radius) // bands) > bucket:
        bands += 1
    return bands, list(combinations(range(bands), bands - radius))


def bucket_keys(fp: Column, bands: int, choices: list[tuple[int, ...]]) -> Column:
    edges = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for k, choice in enumerate(choices):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask).cast("bigint"))))
    return F.array(*keys)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, values) of many whole groups at a time; rows (key, value) come sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        size += batch.num_rows
        if size >= rows:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield keys[:cut], values[:cut]
            held, size = [(keys[cut:], values[cut:])], len(keys) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _whole_groups(batches):
            again = keys[1:] == keys[:-1]
            shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            a, b = link_stars(values[shared].view(np.uint64), radius, keys[shared])
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, n: int, radius: int = RADIUS, hot: int | None = None) -> DataFrame:
    """distinct(fp), n rows -> edges(a, b) that span all components of links."""
    bands, _ = band_plan(n, radius)
    edges, limit = None, HOT if hot is None else hot
    while True:
        keyed = distinct.select(F.explode(bucket_keys(F.col("fp"), bands, list(combinations(range(bands), bands - radius)))).alias("key"), "fp")
        again = None
        if n > limit and bands < radius + MORE:
            full = materialise(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"), "hot-buckets")
            if full.limit(1).count():
                full = broadcast_within(full, 1_000_000)
                again = materialise(keyed.join(full, "key", "left_semi").select("fp").distinct(), "hot-fingerprints")
                keyed = keyed.join(full, "key", "left_anti")
        found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(radius), "a bigint, b bigint")
        edges = found if edges is None else edges.unionByName(found)
        if again is None:
            return edges
        distinct, n, bands = again, again.count(), bands + 1


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp bigint, group (a fingerprint), component_id for each row of docs."""
    marked = materialise(fingerprints(docs, size=size, seed=seed), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    n = distinct.count()
    joined = stars(links(distinct.select("fp"), n, radius))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    groups = rooted.groupBy(F.col("root").alias("g_root")).agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, rooted["root"] == groups["g_root"]).select(F.col("fp").alias("n_fp"), F.col("root").alias("group"), "component_id")
    return marked.join(named, marked["fp"] == named["n_fp"]).select("doc_id", "text_key", "fp", "group", "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group of found(doc_id, text_key, group) the one with the
    least doc_id (null last, then by a hash of the text); rows repeated with that doc_id and text stay once."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    an_id, a_key = fresh(docs, "__id"), fresh(docs, "__key")
    kept = found.groupBy("group").agg(first.alias("kept")).select(F.col("kept.doc_id").alias(an_id), F.col("kept.text_key").alias(a_key))
    key = F.xxhash64("text")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(an_id)) & (key == F.col(a_key)), "left_semi")
    repeated = found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return out.withColumn(a_key, key).dropDuplicates(["doc_id", a_key]).drop(a_key) if repeated else out


def keep_one(docs: DataFrame, *, by_similarity: bool = False, **options: int) -> DataFrame:
    """The rows of docs that stay: of each group the first. Groups are those of near_duplicates, or, by similarity, of texts
    whose shingle sets have similarity 4/5 or more (similar.py: fingerprint links are its first candidates)."""
    if by_similarity:
        from docaudit.llm.similar import near_copies as groups
    else:
        groups = near_duplicates
    return keep_first(docs, materialise(groups(docs.select("doc_id", "text"), **options), "groups"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
