"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text BPE's encoding ends with one definite token. Scanning left to right, an automaton with
suffix links over the vocabulary reports the tokens that end at each position, longest first; the first one that starts
the piece, or is compatible with the last token of the prefix before it, is that prefix's last token. Following these
back-pointers from the end gives exactly the ids that BPE's merges give. Two tokens are compatible if merging their
bytes together would not have joined pieces across their border: both are taken apart in reverse order of their
merges, and no merge of the pieces at the border may rank before the merge just undone.

The vocabulary file is read on the driver and broadcast (a fixed size of a few MB). Texts are cut into pieces a batch at a
time, over byte arrays; pieces that a worker has met before take their ids from a bounded table whose keys are the piece's
bytes themselves (`Pieces`), so only new ones go through the dynamic program. Decoding joins the tokens' bytes.

Defined results: null text is encoded as empty text (no ids, empty text back). Strings of special tokens are those
tokens, as in the file's own library. Repeated rows: one result each. Extra columns are kept unless they are named ids
or decoded, which the results replace. Empty table: empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
#: The byte-level splitting pattern of the vocabulary; white space as Unicode's property has it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Slots of a worker's table of pieces (it starts afresh at half of them), and pair tests kept.
SLOTS, CACHE = 1 << 20, 400_000
#: Longest piece in bytes that the table holds; longer ones are encoded each time.
SHORT = 15
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def byte_characters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one byte-level BPE file of the tokenizers library."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        unknown = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or unknown:
            raise ValueError(f"not a plain byte-level BPE file: {unknown or split}")
        alphabet = byte_characters()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]):
            raise ValueError("special tokens that take more than their own string are not supported")
        # numbers order the tokens by the time at which merging makes them: bytes first, then one for each merge
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[int, int] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = left + right
            if made in self.number:
                raise ValueError("two merges make the same token")
            self.number[made] = 256 + i
            self.parts.append((self.number[left], self.number[right]))
            self.merged[self.number[left] << 20 | self.number[right]] = 256 + i
        self.bytes_of = {}
        self.id_of = [0] * len(self.parts)
        self.size_of = [0] * len(self.parts)
        for token, i in model["vocab"].items():
            b = raw(token) if token not in self.special else None
            if b is not None:
                self.bytes_of[i] = b
                self.id_of[self.number[b]], self.size_of[self.number[b]] = i, len(b)
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for b, no in self.number.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), no))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.table = Pieces()
        sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            sizes[i] = len(b)
        self._ends = np.cumsum(sizes)
        self._sizes = sizes
        self._joined = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), np.uint8)

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.parts) + 1
        while True:
            made = self.merged.get(a << 20 | b)
            if made is not None and made < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.parts[a][1]
            else:  # at equal ranks the merge further left comes first, so the border's merge would win here
                limit, b = b + 1, self.parts[b][0]

    def _piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        last, fits = [-1] * (len(s) + 1), self.fits
        for end, (size, no) in self.automaton.iter(s):
            if last[end + 1] < 0:
                start = end + 1 - size
                if start == 0:
                    last[end + 1] = no
                elif (before := last[start]) >= 0:
                    key = before << 20 | no
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > CACHE:
                            fits.clear()
                        ok = fits[key] = self._compatible(before, no)
                    if ok:
                        last[end + 1] = no
        ids, end = [], len(s)
        while end:
            ids.append(self.id_of[last[end]])
            end -= self.size_of[last[end]]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """One text, piece by piece; the plain form of encode_all, which alone minds special tokens."""
        ids: list[int] = []
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                ids.append(self.special[part])
            else:
                for piece in self.pieces.findall(part):
                    ids += self._piece(piece.encode("utf-8", "surrogatepass"))
        return ids

    def encode_all(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the UTF-8 texts buffer[offsets[i]:offsets[i + 1]], and the offsets of each text's ids."""
        offsets = offsets.astype(np.int64)
        buffer, offsets = buffer[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts = piece_starts(buffer, offsets)
        ids, ends = self.table.ids(buffer, starts, np.append(starts[1:], len(buffer)), self._piece)
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        raw = buffer.tobytes()
        marked = {int(np.searchsorted(offsets, at, "right")) - 1 for word in self.special for at in _places(raw, word.encode())}
        if not marked:
            return ids, bounds
        parts = []
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]].decode() if i in marked else None
            parts.append(ids[bounds[i] : bounds[i + 1]] if text is None else np.array(self.encode(text), np.int32))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        ids, bounds = self.encode_all(*utf8(pa.array(texts, pa.large_string())))
        return np.split(ids, bounds[1:-1]) if len(texts) else []

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i]:bounds[i + 1]]."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        raw = self._joined[np.repeat(self._ends[ids] - ends, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _places(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Kind of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            out[first : last + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def byte_kinds(buffer: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte belongs to."""
    table = _classes()
    kinds = table[:256][buffer]
    lead = np.flatnonzero(buffer >= 0xC0)
    if len(lead):
        size = 2 + (buffer[lead] >= 0xE0) + (buffer[lead] >= 0xF0)
        at = np.minimum(lead[:, None] + np.arange(4), len(buffer) - 1)
        b = buffer[at].astype(np.int64)
        tail = b[:, 1:] & 0x3F
        point = np.where(size == 2, (b[:, 0] & 0x1F) << 6 | tail[:, 0], np.where(size == 3, (b[:, 0] & 0xF) << 12 | tail[:, 0] << 6 | tail[:, 1], (b[:, 0] & 7) << 18 | tail[:, 0] << 12 | tail[:, 1] << 6 | tail[:, 2]))
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            here = size > k
            kinds[lead[here] + k] = kind[here]
    return kinds


def piece_starts(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of PIECES start. Runs of one kind are pieces, with the space before them; of other white space before
    a run the last character stands alone; an apostrophe alone takes one of seven endings with it."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64)
    kinds = byte_kinds(buffer)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    run = np.flatnonzero(change)
    ends = np.append(run[1:], n)
    kind = kinds[run]
    more = ~first[ends]  # another run of the same text follows
    starts = change.copy()
    # white space before a run: its last character is cut off, and if it is a space it begins that run's piece
    white = (kind == _SPACE) & more
    tail = ends[white] - 1
    wide = buffer[tail] >= 0x80
    while wide.any():  # back to the lead byte
        tail = np.where(wide & ((buffer[tail] & 0xC0) == 0x80), tail - 1, tail)
        wide = (buffer[tail] & 0xC0) == 0x80
    starts[tail] = True
    space = buffer[tail] == 0x20
    starts[ends[white][space]] = False
    # contractions: a run that is one apostrophe, begins its piece and is followed by letters
    quote = np.flatnonzero((buffer[run] == 0x27) & (ends - run == 1) & starts[run] & more)
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == _LETTER]
    if len(quote):
        at, room = run[quote], ends[np.minimum(quote + 1, len(run) - 1)] - run[quote] - 1
        one, two = buffer[at + 1], np.where(room > 1, buffer[np.minimum(at + 2, n - 1)], 0)
        pair = one.astype(np.int64) << 8 | two
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]), 2, 0))
        at, room, size = at[size > 0], room[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[(at + 1 + size)[room > size]] = True
    return np.flatnonzero(starts)


class Pieces:
    """A bounded hash table from pieces of at most SHORT bytes (keys: their bytes and length, in two words) to ids."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.n, self.at = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int64)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.int32), 0, 0

    @staticmethod
    def keys(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
        low = words[starts] & mask[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, len(buffer))] & mask[np.clip(sizes - 8, 0, 7)]
        return low, high | sizes.astype(np.uint64) << np.uint64(56)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key: where it is, or the free one where it would go; and whether it is there."""
        mix = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        slot = ((mix ^ (mix >> np.uint64(32))) & np.uint64(self.slots - 1)).astype(np.int64)
        there = (self.high[slot] == high) & (self.low[slot] == low)
        open_ = np.flatnonzero(~there & (self.high[slot] != 0))
        while len(open_):
            slot[open_] = s = (slot[open_] + 1) & (self.slots - 1)
            same = (self.high[s] == high[open_]) & (self.low[s] == low[open_])
            there[open_[same]] = True
            open_ = open_[~same & (self.high[s] != 0)]
        return slot, there

    def _store(self, low: np.ndarray, high: np.ndarray, found: list[list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        n = np.array([len(x) for x in found], np.int32)
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.held += len(n)
        todo = np.arange(len(n))
        while len(todo):  # of those that want the same free slot one gets it
            slot, _ = self.find(low[todo], high[todo])
            _, won = np.unique(slot, return_index=True)
            s, i = slot[won], todo[won]
            self.low[s], self.high[s], self.n[s], self.at[s] = low[i], high[i], n[i], at[i]
            todo = np.delete(todo, won)

    def ids(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces one after another, and where each one's end. encode: bytes -> ids of a new piece."""
        block = self.slots // 4  # so that one call's new pieces always fit
        if len(starts) > block:
            parts = [self.ids(buffer, starts[i : i + block], ends[i : i + block], encode) for i in range(0, len(starts), block)]
            before = np.cumsum([0] + [len(x) for x, _ in parts])
            return np.concatenate([x for x, _ in parts]), np.concatenate([y + b for (_, y), b in zip(parts, before, strict=False)])
        sizes = ends - starts
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        short = sizes <= SHORT
        low, high = self.keys(buffer, starts, np.minimum(sizes, SHORT))
        slot, there = self.find(low, high)
        new = np.flatnonzero(short & ~there)
        if len(new):
            _, once = np.unique(np.stack([low[new], high[new]], 1), axis=0, return_index=True)
            once = new[once]
            if self.held + len(once) > self.slots // 2:
                self.clear()
                once = np.flatnonzero(short)
                _, first = np.unique(np.stack([low[once], high[once]], 1), axis=0, return_index=True)
                once = once[first]
            raw = buffer.tobytes()
            self._store(low[once], high[once], [encode(raw[a:b]) for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)])
            slot, there = self.find(low, high)
        n, at, pool = self.n[slot].astype(np.int64), self.at[slot], self.pool
        long = np.flatnonzero(~short)
        if len(long):
            found = [encode(buffer[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            n[long] = [len(x) for x in found]
            at[long] = self.used + np.cumsum(n[long]) - n[long]
            pool = np.concatenate([pool[: self.used], np.fromiter(chain.from_iterable(found), np.int32)])
        ends_ = np.cumsum(n)
        return pool[np.repeat(at - ends_ + n, n) + np.arange(int(ends_[-1]))], ends_


@lru_cache(maxsize=2)
def _loaded(content: bytes) -> Bpe:
    return Bpe(content)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(df: DataFrame, path: str, *, text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """df with ids array<int> and decoded string. path: the vocabulary file, on the driver."""
    spark = df.sparkSession
    with open(path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rest = [c for c in df.columns if c not in ("ids", "decoded")]
    at = rest.index(text_col)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in batches:
            for part in slices(batch, at, batch_bytes):
                ids, bounds = bpe.encode_all(*utf8(part.column(at)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(bpe.decode_all(ids, bounds), pa.string())], names=[*rest, "ids", "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose strings in `column` hold about `most` bytes at most (a longer row: a part of its own)."""
    sizes = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def digests(encoded: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return encoded.select(
        *keys, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, path or vocabulary_path()))
