"""Token-ID output: one wavelet matrix for each shard of documents in ascending id order.

Documents are dealt by ranges of their id and sorted, tokenised, and their ids
written shard by shard as wavelet matrices: succinct bit planes that give access
to any token, counts and occurrences from the one compressed file.

Encoding a text is a look-up for each of its pre-tokens. They are found with
array operations by the tokenizer's own split rule; each distinct one is encoded
by the tokenizers library, once as long as it stays in the worker's table. It goes
to the library's model, spelled in the letters that stand for bytes there: the
library's own splitter, which would find it whole, takes most of the time.
Texts whose split is not certain to be the library's (characters younger than
Unicode 3.2, special tokens) are encoded by the library as a whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .succinct import WaveletMatrix
from .tables import arrow_map, only, table, written
from .textops import hash_spans, same_spans

_U = np.uint64
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
DEPTH = 16
SHARD_TOKENS = 4 << 20
CHUNK_CHARS = 1 << 20
TABLE_BITS = 21

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
# The characters of Unicode's White_Space property, and the endings that the split rule keeps with an apostrophe.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    out = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x30000):
        a, b = old(chr(c))[0], unicodedata.category(chr(c))[0]
        if old(chr(c)) != "Cn" and kind.get(a, OTHER) == kind.get(b, OTHER):
            out[c] = kind.get(a, OTHER)
    out[WHITE] = SPACE
    out[0x180E] = UNSURE  # white space in older versions only
    return out


def splits(cp: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start of every pre-token in code points, for rows at off. The rule, by Unicode class: an apostrophe ending; an optional
    space and a run of letters, of numbers or of others; white space up to the last before a word; other white space."""
    n = len(cp)
    k = classes[cp]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    space = k == SPACE
    prev_space = np.zeros(n, bool)
    prev_space[1:] = space[:-1]
    prev_space &= ~first
    change = np.ones(n, bool)
    change[1:] = k[1:] != k[:-1]
    begin = first | change  # runs of one class
    # The last white space before a word starts a token; the word itself does where that was no plain space.
    word_after = np.zeros(n, bool)
    word_after[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    begin |= word_after
    blank = cp == 32
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = blank[:-1]
    begin &= ~(~space & prev_space & prev_blank)
    # Apostrophe endings at the start of a token.
    quotes = np.flatnonzero((cp == 39) & begin)
    for q in quotes.tolist():
        stop = int(off[np.searchsorted(off, q, "right")])
        ahead = cp[q + 1 : min(q + 3, stop)]
        for e in ENDINGS:
            if len(ahead) >= len(e) and all(int(ahead[i]) == ord(c) for i, c in enumerate(e)):
                begin[q + 1 : q + 1 + len(e)] = False
                after = q + 1 + len(e)
                # What follows starts a token, but a space before a word is already handled.
                if after < stop:
                    begin[after] = True
                break
    return np.flatnonzero(begin)


def byte_letters() -> dict[int, str]:
    """For each byte the letter that stands for it in a byte-level vocabulary: itself where it is printed, else the next from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) if b in printed else chr(256 + others.index(b)) for b in range(256)}


class Encoder:
    """encode() gives all ids of some texts and the number of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.classes = _classes()
        plain = self.tok.normalizer is None and isinstance(self.tok.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.tok.pre_tokenizer.add_prefix_space
        self.model, self.letters = self.tok.model if plain else None, byte_letters()
        size = self.tok.get_vocab_size()
        if size > 1 << DEPTH:
            raise ValueError("the vocabulary does not fit the planes")
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.entry = np.zeros(1 << TABLE_BITS, np.int32)
        self.off = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint16)
        # The bytes of each known pre-token: a hash finds it, its bytes decide.
        self.spelling, self.spelled = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and where each begins."""
        ids: list[int] = []
        off = [0]
        if self.model is not None:
            tokenize = self.model.tokenize
            for p in pieces:
                ids.extend([t.id for t in tokenize(p.encode("utf-8").decode("latin-1").translate(self.letters))])
                off.append(len(ids))
            return np.array(ids, np.uint16), np.array(off, np.int64)
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            ids.extend(e.ids)
            off.extend((off[-1] + np.cumsum(n)).tolist())
        return np.array(ids, np.uint16), np.array(off, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
                size += len(texts[j])
                j += 1
            ids, n = self._chunk(texts[i:j])
            out.append(ids)
            counts[i:j] = n
            i = j
        return np.concatenate(out) if out else np.zeros(0, np.uint16), counts

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        unsure = np.flatnonzero(self.classes[cp] == UNSURE)
        odd = set((np.searchsorted(off, unsure, "right") - 1).tolist())
        odd |= {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        if odd:
            parts = [self.whole(t) if k in odd else self._chunk([t])[0] for k, t in enumerate(texts)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if not len(cp):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        start = splits(cp, off, self.classes)
        end = np.append(start[1:], len(cp))
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        # Where each code point begins in the bytes.
        begin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        low, high = begin[start], begin[end]
        entry = self._entries(hash_spans(raw, low, high), joined, start, end, raw, low, high)
        at = self.off[entry]
        n = self.off[entry + 1] - at
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
        first = np.searchsorted(start, off)
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[first])

    def _entries(self, h: np.ndarray, joined: str, start: np.ndarray, end: np.ndarray, raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The pool entry of each pre-token; unknown ones are learned. start, end: in code points; low, high: in bytes."""
        if len(self.off) > 3 << (TABLE_BITS - 2):
            self.reset()
        h = np.where(h == 0, _U(1), h)
        a, b = (h >> _U(64 - TABLE_BITS)).astype(np.int64), (h & _U((1 << TABLE_BITS) - 1)).astype(np.int64)
        entry = np.where(self.keys[a] == h, self.entry[a], -1).astype(np.int64)
        other = (entry < 0) & (self.keys[b] == h)
        entry[other] = self.entry[b[other]]
        # Spans of at most 7 bytes have hashes of their own; of others the bytes are compared.
        long = np.flatnonzero((entry >= 0) & (high - low > 7))
        e = entry[long]
        same = same_spans(raw, low[long], high[long], self.spelling, self.spelled[e], self.spelled[e + 1])
        odd = long[~same]
        entry[odd] = -1
        left = np.flatnonzero(entry < 0)
        if not len(left):
            return entry
        new, where, back = np.unique(h[left], return_index=True, return_inverse=True)
        src = left[where]
        # Pre-tokens that share a hash with another spelling are encoded one by one.
        x = src[back]
        alike = same_spans(raw, low[left], high[left], raw, low[x], high[x])
        alone = left[~alike]
        source = np.concatenate([src, alone])
        ids, off = self._learn([joined[x:y] for x, y in zip(start[source].tolist(), end[source].tolist(), strict=True)])
        base = len(self.off) - 1
        number = np.full(len(new), -1, np.int64)
        for slot in ((new >> _U(64 - TABLE_BITS)).astype(np.int64), (new & _U((1 << TABLE_BITS) - 1)).astype(np.int64)):
            free = np.flatnonzero((number < 0) & (self.keys[slot] == 0))
            _, pick = np.unique(slot[free], return_index=True)
            take = free[pick]
            number[take] = 0
            self.keys[slot[take]] = new[take]
            self.entry[slot[take]] = base + take
        # All new pre-tokens go to the pool; those without a slot are learned again when they return.
        self.pool = np.concatenate([self.pool, ids])
        self.off = np.concatenate([self.off, off[1:] + self.off[-1]])
        size = high[source] - low[source]
        ends = np.cumsum(size)
        self.spelling = np.concatenate([self.spelling, raw[np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(low[source], size)]])
        self.spelled = np.concatenate([self.spelled, ends + self.spelled[-1]])
        entry[left] = base + back
        entry[alone] = base + len(new) + np.arange(len(alone))
        return entry


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: the table of known pre-tokens outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARD_SCHEMA = "part long, shard long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, tokens binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards under the shared folder and return them as read back: part and shard (which order them), the documents'
    ids and lengths, and the wavelet matrix of their ids as bytes.

    tokenizer: path of a tokenizer file on every worker. Null and empty texts give the end id alone. Null ids come first;
    rows that repeat an id are ordered by text, null first. An empty table gives no shard. Other columns are ignored.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        shard, held = 0, [[], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            ids, lengths, tokens = held
            seq = np.concatenate(tokens)
            wm = WaveletMatrix.of(seq, DEPTH)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (part, shard, len(ids), len(seq))), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([wm.dump()], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "doc_ids", "lengths", "tokens"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids, n = enc.encode(texts)
                ids = np.insert(ids, np.cumsum(n), end_id)
                names, lengths, ends = b.column(0).to_pylist(), n + 1, np.cumsum(n + 1)
                k = done = 0
                while k < len(names):
                    # Documents up to the one that fills the shard.
                    stop = min(len(names), int(np.searchsorted(ends, done + shard_tokens - size)) + 1)
                    held[0].extend(names[k:stop])
                    held[1].extend(lengths[k:stop].tolist())
                    held[2].append(ids[done : ends[stop - 1]])
                    size += int(ends[stop - 1]) - done
                    k, done = stop, int(ends[stop - 1])
                    if size >= shard_tokens:
                        yield out()
                        shard, held, size = shard + 1, [[], [], []], 0
        if held[0]:
            yield out()

    dealt = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(docs.sparkSession, arrow_map(dealt, run, SHARD_SCHEMA), "tokens")


def manifest(shards: DataFrame) -> DataFrame:
    """part, shard, n_docs, n_tokens, and base: the number of ids of all shards before it. One row a shard: sums within a part, then over the parts."""
    sizes = shards.select("part", "shard", "n_docs", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(before), F.lit(0))).select("part", "ahead")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    return starts.select("part", "shard", "n_docs", "n_tokens", (F.col("ahead") + F.col("before")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Each document of the shards: doc_id, start, n_tokens, ids_crc32, decoded from the wavelet matrices as a whole. A row for each row that
    was written: repeated ids, null ids and empty texts (the end id alone) too; without shards there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                seq = WaveletMatrix.load(b.column("tokens")[k].as_py()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(seq[x:y]) for x, y in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column("part")[k].as_py())), pa.array(np.full(n, b.column("shard")[k].as_py())), ids, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    found = arrow_map(shards.select("part", "shard", "doc_ids", "lengths", "tokens"), run, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(manifest(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), found["n_tokens"], "ids_crc32")


def tokens_of(shards: DataFrame, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, ids of some documents, by random access: nothing but their positions is decoded. Rows that repeat an id each have theirs."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                held = np.flatnonzero(pc.is_in(ids, pa.array(wanted)).to_numpy(zero_copy_only=False))
                if not len(held):
                    continue
                wm, ends = WaveletMatrix.load(b.column("tokens")[k].as_py()), np.cumsum(lengths)
                got = [wm.access(np.arange(ends[x] - lengths[x], ends[x])) for x in held.tolist()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(held)), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return arrow_map(shards.filter(F.exists("doc_ids", lambda x: x.isin(wanted.tolist()))).select("doc_ids", "lengths", "tokens"), run, "doc_id long, ids array<long>")


def token_counts(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """token, n: how often each stands in all shards, by rank."""
    asked = np.array(sorted(set(tokens)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                wm = WaveletMatrix.load(b.column("tokens")[k].as_py())
                n = wm.rank(asked, np.full(len(asked), wm.n))
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(n.astype(np.int64))], names=["token", "n"])

    return arrow_map(shards.select("tokens"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place (from 0, in the document) of every occurrence of a token, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                at, ends = WaveletMatrix.load(b.column("tokens")[k].as_py()).occurrences(token), np.cumsum(lengths)
                for x in range(0, len(at), 1 << 17):
                    part = at[x : x + (1 << 17)]
                    doc = np.searchsorted(ends, part, "right")
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(part - (ends - lengths)[doc])], names=["doc_id", "place"])

    return arrow_map(shards.select("doc_ids", "lengths", "tokens"), run, "doc_id long, place long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what write_tokens and read_documents say of nulls, empty and repeated rows and empty tables holds."""
    return read_documents(write_tokens(only(table(spark, sf_dir, "documents"), "doc_id", "text"), tokenizer_path()))
