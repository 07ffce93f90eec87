"""Substring deduplication over prefix-partitioned suffix subtrees.

A window is `window` consecutive words of one document; a word is removed if it lies in a window whose word sequence also
starts earlier (smaller doc_id, or the same document further left).

The suffixes of all documents are dealt into groups by a prefix, and every group's subtree is evaluated down to the
window's depth, where an inner node (two suffixes or more with the same first `window` words) is a repeat:

* Every window holds one anchor, the least hash among its `gram`-word sequences, at the same place in every copy. The
  suffixes of a window are filed under their anchor, so about one suffix in seven stands for its neighbours.
* Anchors that occur once in the corpus are leaves high up and end there. A task first compares its own anchors and
  sends one suffix for each; a shared prefix thus reaches its group as at most one row from each task.
* For the anchors that occur again, the suffixes' windows (path labels, as 64-bit hashes below a 64-bit prefix) are
  filed by anchor. Labels that a task has already seen are repeats at once and only the earliest one travels.
* Occurrences of an anchor are counted over all tasks. Where they exceed `bound`, the prefix grows to the whole window:
  windows are filed by anchor and label, and such a group has one row from each task at most. All other groups have at
  most window - gram + 1 windows for each of `bound` occurrences, so each group fits in memory.
* In each group, sorted by label and place, all but the first suffix of a label are repeats; neighbouring repeats in a
  document merge into maximal repeated spans, which are cut from the text.

A hashed path can only be mistaken within one prefix group (the 64 bits of the anchor and those of the label both
collide), so no text comparison follows.

Defined results: null or empty text: no words. Null doc_id: after all others. Rows with the same doc_id and text are one
document: each gets the same result and does not count as a copy of the other; rows with the same doc_id and other text are
documents of their own, told apart by a 64-bit hash of the text. Extra columns are kept, whatever their names, unless they
are named n_words, n_removed or kept_text, which the results replace. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.bpe import slices
from docaudit.llm.common import materialise, split_words, table

WINDOW, GRAM = 20, 8
#: Occurrences of an anchor beyond which its windows are filed by their labels too.
BOUND = 20_000
_LAST = (1 << 63) - 1
_PART = 1 << 19
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BASE, _PATH_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            self.up, self.down = grow(self.base), grow(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_words, _paths = _Powers(_WORD_BASE), _Powers(_PATH_BASE)


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the texts buffer[offsets[i]:offsets[i + 1]], and the first word of each text."""
    word = ~_SPACE[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets - offsets[0]] = True
    before = np.empty(len(buffer), bool)
    before[:1], before[1:] = False, word[:-1]
    after = np.empty(len(buffer), bool)
    after[-1:], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets - offsets[0])


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + _PART)))
        part = buffer[low : ends[last - 1]]
        up, down = _words.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = _mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * np.uint64(_PATH_BASE))
        first = last
    return out


class Suffixes:
    """Paths and anchors of the texts of a record batch column."""

    def __init__(self, column: pa.Array, window: int, gram: int) -> None:
        column = column.fill_null("").cast(pa.large_string()) if isinstance(column, pa.StringArray) else column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.buffer = (np.frombuffer(data, np.uint8) if data and len(data) else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.starts, self.ends, self.first = word_spans(self.buffer, offsets)
        self.window, self.gram = window, gram

    def index(self) -> None:
        hashes = word_hashes(self.buffer, self.starts, self.ends)
        n = len(hashes)
        up, down = _paths.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])
        counts = np.diff(self.first)
        text = np.repeat(np.arange(len(counts)), np.maximum(counts - self.window + 1, 0))
        skipped = np.concatenate([[0], np.cumsum(np.maximum(counts - self.window + 1, 0))])
        #: place and text of every window
        self.at = self.first[text] + np.arange(len(text)) - skipped[text]
        self.text = text
        if not len(text):
            self.anchor_at, self.anchors = self.at, np.zeros(0, np.uint64)
            return
        grams = self.path(np.arange(n - self.gram + 1), self.gram)
        width = self.window - self.gram + 1
        best, where, span = grams, np.arange(len(grams)), 1
        while span < width:
            step = min(span, width - span)
            a, b = best[:-step], best[step:]
            right = b < a
            where = np.where(right, where[step:], where[:-step])
            best = np.where(right, b, a)
            span += step
        self.anchor_at, self.anchors = where[self.at], best[self.at]

    def path(self, at: np.ndarray, words: int) -> np.ndarray:
        """Hash of the path of so many words that starts at each place."""
        return _mix((self.sums[at + words] - self.sums[at]) * _paths.get(len(self.sums))[1][at])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _later(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last three tell places apart), and which rows in it equal their predecessor but for the place."""
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = True
        for k in keys[:-3]:
            s = k[order]
            same[1:] &= s[1:] == s[:-1]
    return order, same


def _out(columns: dict[str, np.ndarray | pa.Array], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns.values()], names=list(columns))
    for start in range(0, whole.num_rows, rows):
        yield whole.slice(start, rows)


def _anchor_rows(window: int, gram: int):
    """Suffix for each anchor: route (group), d, t, place, known (the anchor was met before in this task), n (how often
    this task has the anchor; on the one row that meets its group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, 2, _PART):
                s = Suffixes(part.column(2), window, gram)
                s.index()
                fresh = np.ones(len(s.at), bool)
                fresh[1:] = (s.anchor_at[1:] != s.anchor_at[:-1]) | (s.text[1:] != s.text[:-1])
                text, at = s.text[fresh], s.anchor_at[fresh]
                d, t = _keys(part)
                kept.append((s.anchors[fresh], d[text], t[text], at - s.first[text]))
        if kept:
            anchors, d, t, place = (np.concatenate(x) for x in zip(*kept, strict=True))
            order, same = _later(anchors, d, t, place)
            anchors, d, t, place = anchors[order], d[order], t[order], place[order]
            known = same.copy()
            known[:-1] |= same[1:]
            # those that need not meet their group go anywhere
            route = np.where(same, _mix(place.view(np.uint64) ^ _mix(d.view(np.uint64) ^ t.view(np.uint64))), anchors)
            meets = np.flatnonzero(~same)
            n = np.zeros(len(same), np.int64)
            n[meets] = np.diff(np.concatenate([meets, [len(same)]]))
            yield from _out({"route": route, "d": d, "t": t, "place": place, "known": known, "n": n})

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by their first column, in tables that end where a value of it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and len(keys) and held[-1].column(0)[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _repeated_anchors(bound: int):
    """Places of the anchors that occur again; in rows of their own, the anchors that occur more than `bound` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            route, d, t, place, known, n = (rows.column(i).to_numpy() for i in range(6))
            again = np.zeros(len(route), bool)
            m = np.flatnonzero(n)
            equal = route[m][1:] == route[m][:-1]
            again[m[1:][equal]] = again[m[:-1][equal]] = True
            yes = again | known
            none = pa.nulls(int(yes.sum()), pa.int64())
            yield from _out({"d": d[yes], "t": t[yes], "place": place[yes], "hot": none})
            if len(m):
                starts = np.flatnonzero(np.concatenate([[True], ~equal]))
                hot = route[m][starts][np.add.reduceat(n[m], starts) > bound]
                none = pa.nulls(len(hot), pa.int64())
                yield from _out({"d": none, "t": none, "place": none, "hot": hot})

    return run


def _ranges(d: np.ndarray, t: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Neighbouring places of one document as (d, t, start, n)."""
    order = np.lexsort((place, t, d))
    d, t, place = d[order], t[order], place[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return {"d": d[first], "t": t[first], "start": place[first], "n": np.diff(np.concatenate([first, [len(d)]]))}


def _label_rows(window: int, gram: int, hot: np.ndarray):
    """Windows of the repeated anchors of each text, by anchor (of the anchors in `hot`, sorted, by anchor and label);
    those that this task has met earlier already as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, 2, _PART):
                s = Suffixes(part.column(2), window, gram)
                s.index()
                wanted = np.zeros(len(s.starts) + 1, bool)
                lists = part.column(3)
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                wanted[s.first[of] + lists.flatten().to_numpy()] = True
                here = wanted[s.anchor_at]
                text, at = s.text[here], s.at[here]
                d, t = _keys(part)
                kept.append((s.anchors[here], s.path(at, window), d[text], t[text], at - s.first[text]))
        if not kept:
            return
        anchors, labels, d, t, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        order, same = _later(anchors, labels, d, t, place)
        # the same place twice is a repeated row, not a repeat
        anchors, labels, d, t, place = anchors[order], labels[order], d[order], t[order], place[order]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        gone = same & ~((d == d[first]) & (t == t[first]) & (place == place[first]))
        found = _ranges(d[gone], t[gone], place[gone])
        none = pa.array([None] * len(found["d"]), pa.binary())
        yield from _out({"route": _mix(found["d"].view(np.uint64)), **found, "labels": none})
        rest = ~same
        anchors, labels, d, t, place = anchors[rest], labels[rest], d[rest], t[rest], place[rest]
        order = np.lexsort((place, t, d, anchors))
        anchors, labels, d, t, place = anchors[order], labels[order], d[order], t[order], place[order]
        split = hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors if len(hot) else np.zeros(len(d), bool)
        route = np.where(split, _mix(anchors ^ labels), anchors)
        new = np.ones(len(d), bool)
        new[1:] = (route[1:] != route[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        bounds = np.concatenate([first, [len(d)]]).astype(np.int64) * 8
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(labels.tobytes())]).cast(pa.binary())
        yield from _out({"route": route[first], "d": d[first], "t": t[first], "start": place[first], "n": np.diff(bounds) // 8, "labels": packed})

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of the groups: suffixes sorted by label; all but the first of each label are repeats."""
    for rows in _runs(batches):
        found = rows.column("labels").is_valid().to_numpy()
        ready = rows.filter(pa.array(~found)).select(["d", "t", "start", "n"])
        if ready.num_rows:
            yield from ready.combine_chunks().to_batches()
        rows = rows.filter(pa.array(found))
        if not rows.num_rows:
            continue
        route, d, t, start, n = (rows.column(i).to_numpy() for i in range(5))
        labels = np.frombuffer(b"".join(rows.column("labels").to_pylist()), np.uint64)
        of = np.repeat(np.arange(len(n)), n)
        place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order, same = _later(route[of], labels, d[of], t[of], place)
        d, t, place = d[of][order], t[of][order], place[order]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        gone = same & ~((d == d[first]) & (t == t[first]) & (place == place[first]))
        yield from _out(_ranges(d[gone], t[gone], place[gone]))


def _cut(window: int, rest: int):
    """The texts without the spans of their repeats; rest: number of columns before d, tag, text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rest, _PART):
                s = Suffixes(part.column(rest), window, GRAM)
                drop = np.zeros(len(s.starts) + 1, np.int32)
                lists = part.column(rest + 1).fill_null([]) if part.column(rest + 1).null_count else part.column(rest + 1)
                spans = lists.flatten()
                if len(spans):
                    of = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                    low = s.first[of] + spans.field(0).to_numpy()
                    np.add.at(drop, low, 1)
                    np.add.at(drop, low + spans.field(1).to_numpy() + window - 1, -1)
                gone = np.cumsum(drop[:-1]) > 0
                counts = np.diff(s.first)
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[s.first[1:]] - sums[s.first[:-1]]
                texts = part.column(rest)
                if removed.any():
                    texts = texts.to_pylist()
                    for i in np.flatnonzero(removed):
                        texts[i] = _keep(s, int(s.first[i]), int(s.first[i + 1]), gone)
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:rest], pa.array(counts), pa.array(removed.astype(np.int64)), texts], names=[*part.schema.names[:rest], "n_words", "n_removed", "kept_text"])

    return run


def _keep(s: Suffixes, first: int, last: int, gone: np.ndarray) -> str:
    """The kept runs of words as they stand in the text, joined by line feeds."""
    kept = np.flatnonzero(~gone[first:last]) + first
    if not len(kept):
        return ""
    breaks = np.flatnonzero(np.diff(kept) > 1)
    starts, ends = s.starts[kept[np.concatenate([[0], breaks + 1])]], s.ends[kept[np.concatenate([breaks, [len(kept) - 1]])]]
    return b"\n".join(s.buffer[a:b].tobytes() for a, b in zip(starts, ends, strict=True)).decode()


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, bound: int = BOUND) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the text without the repeated spans; unchanged where none is)."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "text")]
    inner = [f"c{i}" for i in range(len(names))]  # no name of a column of docs can clash with those below
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    hashed = docs.select(d.alias("d"), F.xxhash64("text").alias("h"))
    mixed = hashed.groupBy("d").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count()
    # texts of one doc_id have a key of their own; where every doc_id has one text, it would only be carried along
    t = F.xxhash64("text") if mixed else F.lit(0).cast("bigint")
    whole = docs.select(d.alias("__d"), t.alias("__t"), F.col("text").alias("text"), *[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)])
    texts = whole.select("__d", "__t", "text")
    anchors = texts.mapInArrow(_anchor_rows(window, gram), "route bigint, d bigint, t bigint, place bigint, known boolean, n bigint")
    again = anchors.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated_anchors(bound), "d bigint, t bigint, place bigint, hot bigint")
    again = materialise(again, "anchors")
    # at most one for `bound` suffixes
    hot = again.where("hot IS NOT NULL").select("hot").toArrow().column("hot").to_numpy().astype(np.int64)
    hot = np.sort(hot.view(np.uint64))
    again = again.where("hot IS NULL")
    listed = again.groupBy(F.col("d").alias("l_d"), F.col("t").alias("l_t")).agg(F.array_distinct(F.collect_list("place")).alias("places"))
    met = whole.join(listed, (whole["__d"] == listed["l_d"]) & (whole["__t"] == listed["l_t"]))
    # every column comes along, so that both joins shuffle the same table and Spark shuffles it once
    met = met.select("__d", "__t", "text", "places", *inner)
    labels = met.mapInArrow(_label_rows(window, gram, hot), "route bigint, d bigint, t bigint, start bigint, n bigint, labels binary")
    ranges = labels.repartition("route").sortWithinPartitions("route").mapInArrow(_repeats, "d bigint, t bigint, start bigint, n bigint")
    spans = ranges.groupBy(F.col("d").alias("s_d"), F.col("t").alias("s_t")).agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    full = whole.join(spans, (whole["__d"] == spans["s_d"]) & (whole["__t"] == spans["s_t"]), "left")
    plain = T.StructType([T.StructField(i, docs.schema[c].dataType) for c, i in zip(names, inner, strict=True)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return full.select(*inner, "text", "__spans").mapInArrow(_cut(window, len(inner)), plain).toDF(*names, "n_words", "n_removed", "kept_text")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated spans of their texts; n_chars counts the text that is left. Every row stays;
    nulls, repeated rows, empty tables and clashing names as above."""
    names = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    found = remove_repeats(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(i) for c, i in inner.items()]))
    new = {"text": F.col("kept_text"), "doc_id": F.col("doc_id"), "n_chars": F.length("kept_text").cast("bigint")}
    return found.select(*[(new[c] if c in new else F.col(inner[c])).alias(c) for c in names])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(split_words(F.col("kept_text")), " "), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS g FROM d, unnest(generate_series(1, len(w) - 19)) AS t(s)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM later, unnest(generate_series(s, s + 19)) AS t(p)
), word AS (
  SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
