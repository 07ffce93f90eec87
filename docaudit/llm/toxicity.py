"""Toxicity: class-conditional Kneser-Ney models over characters.

A text is read as its letters (lower case), every run of other characters as one gap. The chance of a character given the
ORDER - 1 before it is an interpolated Kneser-Ney estimate with three layers. The first has contexts that reach over word
borders; the second has those of the word alone, with marks before its start. Both have counts of their own for toxic and
for ordinary training documents (an n-gram counts once for each document, and what only one document of a class has is
discounted away). Below them both classes share one backoff model, whose continuation counts (how many different
characters precede an n-gram) come from all documents of the corpus, so an expression that a class has hardly seen gets the
same smoothed chance from both. A text's toxic
and ordinary log-likelihoods are compared, normalised by length: their difference for each word, over a few spans (SPANS: the
consecutive words where it is largest, so that a toxic passage in a long text counts; the words that say most; all words). A
logistic map of these differences, fitted on training documents that the counts leave out, gives the score.

N-grams are packed into 60 bits, ten for each character: Latin letters have codes of their own, those of other scripts
share codes. Counts and continuation counts are Spark aggregations over all documents. Class counts use at most SAMPLE
labelled documents of each class (the bound on labelled rows; chosen by a hash of doc_id). The model that reaches the
driver and the executors holds only n-grams of that sample.

Defined results: null, empty or wordless text: differences 0, scored by the map. No training labels of a class among the
documents: every score is the share of toxic labels among training labels (0 if there are none). Repeated rows: one result
each. Extra columns are kept if asked for; score replaces a column of that name. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docaudit.llm.bpe import slices
from docaudit.llm.common import broadcast_within, materialise, table
from docaudit.llm.labelled import fit_logistic, held_out, label_sample, sigmoid

ORDER, DISCOUNT = 6, 0.75
#: Words over which likelihoods are compared: so many consecutive ones, the three that say most, all; and all again where
#: only those on the toxic side count.
SPANS = (16, -3, 0)
#: Discount of the classes' own counts, which count documents: what one document alone has says nothing of its class.
#: Contexts over borders are many and mostly met by chance, so they are discounted more.
OWN_DISCOUNT, WIDE_DISCOUNT = 1.0, 4.0
SAMPLE = (16_000, 8_000)
#: Bits of a character; the first codes are the Latin letters', 0 is the gap, the last one stands before a word's start.
BITS, LATIN, START = 10, 0x250, 1023
WORD = regex.compile(r"[\p{L}\p{M}]+")
_PART = 1 << 20
#: Distinct n-grams that a task holds before it sends them on.
_HELD = 4_000_000


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter or mark."""
    out = np.zeros(0x110000, np.int64)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for m in regex.finditer(r"[\p{L}\p{M}]+", every):
        first, last = ord(every[m.start()]), ord(every[m.end() - 1])
        out[first : last + 1] = np.arange(first, last + 1)
    out[0xD800:0xE000] = 0
    high = (1 << BITS) - LATIN - 2
    return np.where(out == 0, 0, np.where(out < LATIN, out + 1, LATIN + 1 + out % high))


def letters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts one after another, one gap behind each word; where each text starts, and the end."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[points]
    kept = codes > 0
    kept[1:] |= codes[:-1] > 0
    at = np.concatenate([[0], np.cumsum(kept)])
    return codes[kept], at[np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])]


def grams(codes: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each place: over word borders (gaps before the text), and of its word alone (START
    before the word)."""
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    head = np.concatenate([[True], codes[:-1] == 0])[: len(codes)]
    within = np.arange(len(codes)) - np.maximum.accumulate(np.where(head, np.arange(len(codes)), 0))
    across, inner = codes.copy(), codes.copy()
    for k in range(1, order):
        shifted = np.concatenate([np.zeros(min(k, len(codes)), np.int64), codes[:-k]]) << (BITS * k)
        across |= np.where(place >= k, shifted, 0)
        inner |= np.where(within >= k, shifted, START << (BITS * k))
    return across, inner


def gram_counts(docs: DataFrame, sample: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, inner, n_toxic, n_ordinary. Rows without inner: all n-grams of words of the corpus, with the documents of the
    sample (l_id, label) that have them; rows with it: n-grams over word borders of the sample, and the n-gram of the word alone
    that each becomes."""
    marked = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(sample), F.col("id") == F.col("l_id"), "left").select("text", F.coalesce("label", F.lit(-1)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counted = np.zeros(0, np.int64), []
        for batch in batches:
            for part in slices(batch, 0, _PART):
                texts = part.column(0).to_pylist()
                codes, starts = letters(texts)
                (across, inner), label = grams(codes, starts, order), part.column(1).to_numpy()
                fresh = np.unique(inner)
                seen = np.union1d(seen, fresh) if len(seen) else fresh
                for i in np.flatnonzero(label >= 0):
                    own, one = np.unique(across[starts[i] : starts[i + 1]], return_index=True)
                    alone = inner[starts[i] : starts[i + 1]]
                    differs = own != alone[one]
                    types = letters([" ".join(set(WORD.findall((texts[i] or "").lower())))])
                    words = np.unique(grams(*types, order)[1], return_counts=True)
                    counted.append((words, own[differs], alone[one][differs], label[i]))
                if len(seen) > _HELD or len(counted) > 1000:
                    yield from _gram_rows(seen, counted)
                    seen, counted = seen[:0], []
        yield from _gram_rows(seen, counted)

    parts = marked.mapInArrow(run, "gram bigint, inner bigint, n_toxic bigint, n_ordinary bigint")
    return parts.groupBy("gram", "inner").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))


def _gram_rows(seen: np.ndarray, counted: list[tuple]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, len(seen)), np.int64)
    for (alone, times), _, _, label in counted:
        n[label, np.searchsorted(seen, alone)] += times
    yield from _gram_batches(seen, None, n)
    if counted:
        across, at = np.unique(np.concatenate([x for _, x, _, _ in counted]), return_inverse=True)
        inner = np.zeros(len(across), np.int64)
        inner[at] = np.concatenate([x for _, _, x, _ in counted])
        label = np.repeat([c for *_, c in counted], [len(x) for _, x, _, _ in counted])
        yield from _gram_batches(across, inner, np.stack([np.bincount(at[label == c], minlength=len(across)) for c in (0, 1)]))


def _gram_batches(gram: np.ndarray, inner: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(gram), 100_000):
        j = slice(i, i + 100_000)
        alone = pa.nulls(len(gram[j]), pa.int64()) if inner is None else pa.array(inner[j])
        yield pa.RecordBatch.from_arrays([pa.array(gram[j]), alone, pa.array(n[1, j].astype(np.int64)), pa.array(n[0, j].astype(np.int64))], names=["gram", "inner", "n_toxic", "n_ordinary"])


def _last(column: str, k: int):
    return F.col(column).bitwiseAND(F.lit((1 << BITS * k) - 1).cast("bigint"))


def shared_backoff(grams_: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """gram (order - 1 characters), p: interpolated Kneser-Ney chance of the last character, from continuation counts."""
    below = None
    for k in range(1, order):
        # continuation count of a k-gram: the different characters before it, over all n-grams of the corpus
        longer = grams_.select(_last("gram", k + 1).alias("longer")).distinct()
        here = longer.groupBy(_last("longer", k).alias("gram")).agg(F.count(F.lit(1)).alias("n")).withColumn("context", F.shiftright("gram", BITS))
        if k == 1:
            whole = here.agg(F.sum("n"), F.count(F.lit(1))).first()  # one row
            total, types = F.lit(float(whole[0] or 1)), F.lit(float(whole[1]))
            below = here.select("gram", (F.greatest(F.col("n") - discount, F.lit(0.0)) / total + discount * types / total / (types + 1)).alias("p"))
        else:
            context = Window.partitionBy("context")  # at most one row for each character
            known = here.withColumns({"total": F.sum("n").over(context), "types": F.count(F.lit(1)).over(context)})
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            met = known.withColumn("suffix", _last("gram", k - 1)).join(lower, "suffix")
            below = met.select("gram", ((F.col("n") - discount) / F.col("total") + discount * F.col("types") / F.col("total") * F.col("lower")).alias("p"))
    return below


def _own_chances(seen: DataFrame, own: float) -> DataFrame:
    """seen with own_c, the discounted chance that class c's counts give, and rest_c, what they leave to the layer below."""
    context = Window.partitionBy("context")  # at most one row for each character
    out = seen.withColumn("context", F.shiftright("gram", BITS))
    for c in ("toxic", "ordinary"):
        total, taken = F.sum(f"n_{c}").over(context), F.sum(F.least(F.col(f"n_{c}").cast("double"), F.lit(own))).over(context)
        chance = F.when(total > 0, F.greatest(F.col(f"n_{c}") - own, F.lit(0.0)) / total).otherwise(0.0)
        out = out.withColumns({f"own_{c}": chance, f"rest_{c}": F.when(total > 0, taken / total).otherwise(1.0)})
    return out


def ratios(counted: DataFrame, order: int = ORDER, discount: float = DISCOUNT, own: float = OWN_DISCOUNT, wide_own: float = WIDE_DISCOUNT) -> DataFrame:
    """kind, gram, llr: log ratio of the toxic to the ordinary chance. Kinds 0 and 1: of the last character of an n-gram of a
    word alone, and over word borders. Kinds 2 and 3: of what the contexts of these (order - 1 characters) leave to the layer
    below, for a character that neither class has seen there."""
    alone, across = counted.where("inner IS NULL"), counted.where("inner IS NOT NULL")
    shared = shared_backoff(alone, order, discount).select(F.col("gram").alias("suffix"), "p")
    seen = _own_chances(alone.where("n_toxic + n_ordinary > 0"), own).withColumn("suffix", _last("gram", order - 1)).join(shared, "suffix")
    for c in ("toxic", "ordinary"):
        seen = seen.withColumn(f"p_{c}", F.col(f"own_{c}") + F.col(f"rest_{c}") * F.col("p"))
    seen = materialise(seen.select("gram", "context", "rest_toxic", "rest_ordinary", "p_toxic", "p_ordinary"), "toxicity-words")
    below = seen.select(F.col("gram").alias("b_gram"), F.col("p_toxic").alias("b_toxic"), F.col("p_ordinary").alias("b_ordinary"))
    wide = _own_chances(across, wide_own).join(below, F.col("inner") == F.col("b_gram"))
    for c in ("toxic", "ordinary"):
        wide = wide.withColumn(f"p_{c}", F.col(f"own_{c}") + F.col(f"rest_{c}") * F.col(f"b_{c}"))
    out = None
    for kind, layer in enumerate((seen, wide)):
        full = layer.select(F.lit(kind).alias("kind"), "gram", F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("llr"))
        rest = layer.groupBy(F.col("context").alias("gram")).agg(F.log(F.first("rest_toxic") / F.first("rest_ordinary")).alias("llr"))
        both = full.unionByName(rest.select(F.lit(kind + 2).alias("kind"), "gram", "llr"))
        out = both if out is None else out.unionByName(both)
    return out


class _Table:
    """Numbers by packed n-gram: open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.slots = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.float32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            s, won = np.unique(slot[free], return_index=True)
            i = todo[free][won]
            self.keys[s], self.values[s] = keys[i], values[i]
            rest = np.ones(len(todo), bool)
            rest[np.flatnonzero(free)[won]] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mix = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mix >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 if it is missing) and whether it is there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        there = self.keys[slot] == keys
        return np.where(there, self.values[slot], np.float32(0)), there


@dataclass
class Scorer:
    """Keys and ratios of the four kinds (see ratios), and the logistic map; prior: the score if a class was never seen."""

    known: list[tuple[np.ndarray, np.ndarray]]
    order: int = ORDER
    weights: np.ndarray | None = None
    prior: float | None = None
    _tables: list[_Table] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    def ratios(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log ratio of the toxic to the ordinary chance at each place."""
        if self._tables is None:
            self._tables = [_Table(k, v) for k, v in self.known]
        across, inner = grams(codes, starts, self.order)
        out, there = self._tables[0].get(inner)
        new = np.flatnonzero(~there)
        out[new] = self._tables[2].get(inner[new] >> BITS)[0]
        border = np.flatnonzero(across != inner)
        value, there = self._tables[1].get(across[border])
        out[border[there]] = value[there]
        new = border[~there]
        out[new] += self._tables[3].get(across[new] >> BITS)[0]
        return out

    def differences(self, texts: Sequence[str | None]) -> np.ndarray:
        """For each text and each of SPANS: toxic less ordinary log-likelihood for each word, where it is largest."""
        codes, starts = letters(texts)
        out = np.zeros((len(texts), len(SPANS) + 1))
        if not len(codes):
            return out
        gaps = np.flatnonzero(codes == 0)
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(codes, starts).astype(np.float64))])
        ends = np.concatenate([[0.0], sums[gaps + 1]])  # up to the end of each word
        words = np.searchsorted(gaps, starts)
        for i in np.flatnonzero(np.diff(words)):
            e = ends[words[i] : words[i + 1] + 1]
            x = np.sort(np.diff(e))[::-1]
            for k, span in enumerate(SPANS):
                if span > 0:  # consecutive words
                    width = min(span, len(x))
                    out[i, k] = (e[width:] - e[:-width]).max() / span
                else:  # the words that say most, wherever they stand; all words
                    out[i, k] = x[:-span].sum() / -span if span else x.mean()
            out[i, -1] = np.maximum(x, 0.0).mean()
        return out

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return sigmoid(np.column_stack([self.differences(texts), np.ones(len(texts))]) @ self.weights)


def train(docs: DataFrame, labels: DataFrame, *, sample: tuple[int, int] = SAMPLE, order: int = ORDER) -> Scorer:
    spark = docs.sparkSession
    labelled = label_sample(labels, "toxic", sample)
    there = docs.select(F.col("doc_id").cast("bigint").alias("id")).join(F.broadcast(labelled), F.col("id") == F.col("l_id"), "left_semi").distinct()
    chosen = materialise(labelled.join(broadcast_within(there, sum(sample)), F.col("id") == F.col("l_id"), "left_semi"), "toxicity-sample")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "l_id"), F.lit(4))
    sizes = {r["label"]: (r["a"], r["b"]) for r in chosen.groupBy("label").agg(F.count_if(fold == 0).alias("a"), F.count_if(fold != 0).alias("b")).collect()}
    share = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0] or 0.0
    if any(n == 0 for c in (0, 1) for n in sizes.get(c, (0, 0))):
        return Scorer([], order, None, share)
    counted = materialise(gram_counts(docs, chosen.where(fold != 0), order), "toxicity-grams")
    model = ratios(counted, order).toArrow()  # n-grams of the bounded sample
    kind, key, llr = (model.column(c).to_numpy() for c in ("kind", "gram", "llr"))
    scorer = Scorer([(key[kind == k], llr[kind == k].astype(np.float32)) for k in range(4)], order)
    calibrate = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(chosen.where(fold == 0)), F.col("id") == F.col("l_id")).select("label", "text")
    got = statistic(calibrate, spark.sparkContext.broadcast(scorer), ["label"]).toArrow()  # a quarter of the bounded sample
    x, y = np.array(got.column("differences").to_pylist()).reshape(-1, len(SPANS) + 1), got.column("label").to_numpy().astype(float)
    by = np.lexsort([*x.T, y])
    x, y = x[by], y[by]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    scorer.weights = fit_logistic(x, y, weight, ridge=1e-3)
    return scorer


def _mapped(docs: DataFrame, keep: list[str], name: str, kind: T.DataType, values, text_col: str) -> DataFrame:
    at, into = len(keep), pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, _PART):
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(list(values(part.column(at).to_pylist())), into)], names=[*keep, name])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, kind)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def statistic(docs: DataFrame, shared, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and differences of each text. shared: a broadcast Scorer."""
    return _mapped(docs, keep, "differences", T.ArrayType(T.DoubleType()), lambda texts: shared.value.differences(texts), text_col)


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep (but for a column named score) and score, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return _mapped(docs, [c for c in keep if c != "score"], "score", T.DoubleType(), lambda texts: shared.value.scores(texts), text_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
