r"""Phrase collocation mining with broadcast double-array tries.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and at spaces into words; everything is per language. Phrases of two to
`LONGEST` words with at least `min_count` occurrences inside pieces are candidates of the report; each is scored by its weakest cut.

1. *Codes.* One pass turns texts into sequences of 64-bit word codes (a zero between pieces) and counts the words. Two words with one code, of which
   one may matter, are found in the word counts, and the pass is repeated with another seed.
2. *Buckets.* Level by level, tasks count the hashed phrases of k words whose two shorter parts lie in frequent buckets; the tasks' arrays are summed and
   a bit says whether a bucket reached `min_count`. A frequent phrase always lies in a frequent bucket, so this is safe in the sense of Apriori.
3. *Candidates* are the distinct phrases of the corpus that pass all buckets.
4. *Tries.* Candidates are dealt to double-array tries of about `TRIE_ROWS` phrases. One trie at a time is broadcast; tasks move the states of all text
   positions one word further at a time, count the accepting states, and the tasks' counts are summed. More candidates make more tries, not larger ones.

Bounds: a task holds one array of `BUCKETS` counters at most, the driver one bit per bucket and one trie. With more words the buckets fill up; then
more candidates pass and more tries are run, and the counts stay exact.

Defined results: a null text is empty, a null language is `und`; words of any length; a piece without words gives nothing; phrases never cross pieces or
documents; repeated rows count each; an empty table, or one without a candidate, gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.llm import query
from scorefold.llm.common import arrow_rows, ship, small, stored, table

MIN_COUNT = 100
LONGEST = 5
TOP = 2_000
#: Least and most counters of one level; in between four for every `min_count` words.
BUCKETS = (1 << 16, 1 << 26)
TRIE_ROWS = 1 << 18
#: Counters of one row of a task's array; bytes of text, and codes, handled at once; codes of one row; words that a task counts before it hands them out.
BLOCK, CHUNK, SPAN, VOCABULARY = 1 << 13, 1 << 20, 1 << 15, 1 << 17
#: Parts of the hash range in which candidates are merged (a power of two).
PARTS = 256
#: Texts, and rows of codes, that Spark hands to a task's Python at once.
TEXTS, ROWS = 1_000, 32
#: Stretches of slots in which a state with several children looks for room before it goes behind all others.
WINDOWS = 32
#: Tables of the final joins may be broadcast up to so many rows; the longest rows hold ten numbers or five words.
SMALL_ROWS = 100_000

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ENCODED = "lang string, codes binary, word binary, code bigint, n bigint"

ship(__name__)


# ---- codes ----------------------------------------------------------------------------------------------------------------------------------------


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased, and for each whether it opens a piece."""
    a = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = KIND[a]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[a[kind == 0]])])
    piece = np.cumsum(kind == 2, dtype=np.int64)[start]
    return words, np.concatenate([[True], piece[1:] != piece[:-1]])[: len(start)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, CHUNK bytes or one text at a time."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield lang, texts[at:i]
                at, size = i, 0
            size += len(t)
        yield lang, texts[at:]


def _encoder(seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bytes], list[int]] = {}

        def vocabulary():
            rows = [(k[0], None, k[1], v[0], v[1]) for k, v in known.items()]
            known.clear()
            return _batch(rows)

        for b in batches:
            for lang, texts in _groups(b):
                words, opens = words_of(texts)
                if not len(words):
                    continue
                found = words.dictionary_encode()
                own = xxhash.xxh64_intdigest(lang.encode(), seed)
                names = found.dictionary.to_pylist()
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, own) or 1 for w in names), np.uint64, len(names))
                index = found.indices.to_numpy(zero_copy_only=False)
                for w, h, n in zip(names, hashes.view(np.int64).tolist(), np.bincount(index, minlength=len(names)).tolist()):
                    seen = known.get((lang, w))
                    if seen is None:
                        known[lang, w] = [h, n]
                    else:
                        seen[1] += n
                place = np.arange(len(index)) + np.cumsum(opens)
                codes = np.zeros(place[-1] + 1, np.uint64)
                codes[place] = hashes[index]
                ends = np.flatnonzero(codes == 0)  # cut between pieces, at the first end after every SPAN words
                cuts = [0, *np.unique(ends[np.searchsorted(ends, np.arange(SPAN, ends[-1] + 1, SPAN))]).tolist(), len(codes)]
                yield _batch([(lang, codes[x:y].tobytes(), None, None, None) for x, y in zip(cuts, cuts[1:])])
                if len(known) >= VOCABULARY:
                    yield vocabulary()
            pa.default_memory_pool().release_unused()
        yield vocabulary()

    return task


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "codes", "word", "code", "n"])


def encoded(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(codes) sequences of word codes, and (lang, code, word, n) of all words, without a collision that could matter."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for seed in range(42, 52):
        with arrow_rows(docs.sparkSession, TEXTS):
            rows = stored(texts.mapInArrow(_encoder(seed), ENCODED), "phrase-codes")
        words = stored(rows.where("word IS NOT NULL").groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "phrase-words")
        twice = words.groupBy("code").agg(F.count("*").alias("words"), F.sum("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= min_count))
        if not twice.limit(1).count():
            return rows.where("codes IS NOT NULL").select("codes"), words.select("lang", "code", F.col("word").cast("string").alias("word"), "n")
    raise ValueError("word codes collide with ten seeds")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of the rows, half a million at a time; every row begins with a zero."""
    held, size = [], 0
    for b in batches:
        for x in b.column("codes"):
            c = np.frombuffer(x.as_buffer(), np.uint64)
            held.append(c)
            size += len(c)
            if 2 * size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


# ---- summed arrays --------------------------------------------------------------------------------------------------------------------------------


def _summed(shards: DataFrame, finish: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """The tasks' arrays (block, counts as little-endian longs or bytes) added up, block by block, one row at a time, and what finish makes of each block.

    Sums are finished where they are made: a second step on their rows would keep a second Python beside each task, and its memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, width, data in zip(b.column("block").to_pylist(), b.column("width").to_pylist(), b.column("counts")):
                part = np.frombuffer(data.as_buffer(), f"<u{width}")
                if block in total:
                    total[block] += part.astype(np.int64)
                else:
                    total[block] = part.astype(np.int64)
        for k in sorted(total):
            yield finish(k, total.pop(k))

    return shards.repartition("block").mapInArrow(add, schema)


def _shard(counts: np.ndarray) -> pa.RecordBatch:
    """One task's array as rows of BLOCK counters; rows of zeros are left out."""
    rows = [(k, part) for k in range(0, len(counts), BLOCK) if (part := counts[k : k + BLOCK]).any()]
    return pa.RecordBatch.from_arrays([pa.array([k // BLOCK for k, _ in rows], pa.int32()), pa.array([counts.itemsize] * len(rows), pa.int32()), pa.array([p.tobytes() for _, p in rows], pa.binary())], names=["block", "width", "counts"])


SHARD = "block int, width int, counts binary"


# ---- buckets --------------------------------------------------------------------------------------------------------------------------------------


def _levels(codes: np.ndarray, bits: int, frequent: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ..: positions of phrases of k words whose shorter parts are in frequent buckets, their hashes and buckets.

    frequent: for each level passed, a bit per bucket; one level more than there are bits is given."""
    at = np.flatnonzero(codes)
    h = codes[at] * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    yield at, h, (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift
    for k, bit in enumerate(frequent, 2):
        bucket = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)
        good = (bit[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0
        at, h = at[good], h[good]
        both = np.flatnonzero(at[1:] == at[:-1] + 1)  # the part one word on is good, too
        h = (h[both] ^ (h[both] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[at[both] + (k - 1)] * np.uint64(0x9E3779B97F4A7C15)
        at = at[both]
        yield at, h, (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift


def frequent_buckets(codes: DataFrame, bits: int, min_count: int, longest: int) -> list[np.ndarray]:
    """For each level a bit per bucket: whether min_count phrases fall into it."""
    sc, out = codes.sparkSession.sparkContext, []
    kind = np.uint8 if min_count <= 255 else np.uint32
    for level in range(longest):
        known = sc.broadcast(list(out))

        def count(batches: Iterator[pa.RecordBatch], level: int = level, known=known) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << bits, np.uint32)
            for c in _sequences(batches):
                for k, (_, _, bucket) in enumerate(_levels(c, bits, known.value)):
                    if k == level:
                        np.add.at(n, bucket.astype(np.int64), np.uint32(1))
                np.minimum(n, min_count, out=n)  # enough for the question; sums of cut counts reach it whenever the counts do
            yield _shard(n.astype(kind))

        def flags(block: int, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(n >= min_count).tobytes()], pa.binary())], names=["block", "bits"])

        answer = np.zeros(1 << (bits - 3), np.uint8)
        rows = _summed(codes.mapInArrow(count, SHARD), flags, "block int, bits binary").toArrow()  # one bit per bucket
        for block, data in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
            answer[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(data, np.uint8)
        out.append(answer)
    return out


def candidates(codes: DataFrame, bits: int, frequent: list[np.ndarray], longest: int) -> DataFrame:
    """c1, c2, ..: the distinct phrases of two and more words that lie, with all their parts, in frequent buckets; zeros behind short ones.

    A task packs what it has found into one row for each length and part of the hash range, and the parts are merged one row at a time."""
    known = codes.sparkSession.sparkContext.broadcast(list(frequent))
    shift = np.uint64(64 - PARTS.bit_length() + 1)

    def packed(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for k, (h, phrases) in found.items():
            cuts = [0, *np.searchsorted(h, np.arange(1, PARTS, dtype=np.uint64) << shift).tolist(), len(h)]
            rows += [(i, k, phrases[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["part", "k", "phrases"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {k: (np.zeros(0, np.uint64), np.zeros((0, k), np.uint64)) for k in range(2, longest + 1)}
        found = dict(none)  # hashes in order, and codes
        for c in _sequences(batches):
            for k, (at, h, bucket) in enumerate(_levels(c, bits, known.value[:-1]), 1):
                if k == 1:
                    continue
                bit = known.value[k - 1]
                bucket = bucket.astype(np.int64)
                good = (bit[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0
                at, h = at[good], h[good]
                own, first, of = np.unique(h, return_index=True, return_inverse=True)
                other = np.zeros(len(at), bool)  # phrases of one hash that differ
                for j in range(k):
                    other |= c[at + j] != c[at[first][of] + j]
                own, one = np.concatenate([own, h[other]]), np.concatenate([at[first], at[other]])
                words = np.stack([c[one + j] for j in range(k)], 1)
                hashes, phrases = found[k]
                if len(hashes):
                    fresh = (phrases[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] != words).any(1)
                    own, words = own[fresh], words[fresh]
                own, words = np.concatenate([hashes, own]), np.concatenate([phrases, words])
                order = np.argsort(own, kind="stable")
                found[k] = own[order], words[order]
            if sum(len(h) for h, _ in found.values()) > VOCABULARY:
                yield packed(found)
                found = dict(none)
        yield packed(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for part, k, data in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), b.column("phrases")):
                more = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, k)
                parts[part, k] = np.unique(np.concatenate([parts[part, k], more]) if (part, k) in parts else more, axis=0)
        for (_, k), phrases in sorted(parts.items()):
            yield pa.RecordBatch.from_arrays([pa.array(phrases[:, j] if j < k else np.zeros(len(phrases), np.int64)) for j in range(longest)], names=names)

    names = [f"c{j}" for j in range(1, longest + 1)]
    rows = codes.mapInArrow(task, "part int, k int, phrases binary").repartition("part")
    return rows.mapInArrow(merge, ", ".join(f"{c} bigint" for c in names))


# ---- tries ----------------------------------------------------------------------------------------------------------------------------------------


class Trie:
    """A double-array trie over phrases of word codes: the child of state s by symbol x is slot base[s] + x if check[slot] = s."""

    def __init__(self, phrases: np.ndarray):
        """phrases: rows of codes (uint64), zeros behind short ones; distinct."""
        self.alphabet = np.unique(phrases[phrases > 0])
        self.bits = max(1, int(len(self.alphabet)).bit_length() + 1)
        self.start = np.searchsorted(self.alphabet, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(self.alphabet)))
        x = self.symbols(phrases.ravel()).reshape(phrases.shape)
        order = np.lexsort(x.T[::-1])
        self.phrases, x = phrases[order], x[order]
        n, depth = self.size, self.depth = x.shape
        # states of a level: the first rows of equal prefixes
        parent, symbol, rows_of, level_of = [], [], [], []
        node = np.zeros(n, np.int64)  # state number of each row's prefix; the root is 0
        total = 1
        fresh = np.zeros(n, bool)
        for d in range(depth):
            live = x[:, d] > 0
            fresh = fresh | (np.concatenate([[True], x[1:, d] != x[:-1, d]]) if n else np.zeros(0, bool))
            head = np.flatnonzero(fresh & live)
            parent.append(node[head])
            symbol.append(x[head, d])
            number = total + np.cumsum(fresh & live) - 1
            node = np.where(live, number, node)
            total += len(head)
        parent, symbol = np.concatenate(parent), np.concatenate(symbol).astype(np.int64)
        base, slot = self._place(parent, symbol, total)
        size = int(max(slot.max(initial=0), base.max(initial=0))) + len(self.alphabet) + 2
        self.base, self.check, self.final = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.final[slot[node]] = np.arange(n)

    @staticmethod
    def _place(parent: np.ndarray, symbol: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """base and slot of every state: first fit for states with several children, then free slots for single ones."""
        base, slot = np.zeros(total, np.int64), np.zeros(total, np.int64)
        if total == 1:
            return base, slot
        by = np.argsort(parent, kind="stable")
        owners, first, many = np.unique(parent[by], return_index=True, return_counts=True)
        widest = int(symbol.max())
        used = np.zeros(2 * (total + widest) + 2, bool)
        used[0] = True
        top, places = 0, np.random.default_rng(0)
        for i in np.concatenate([[0], 1 + np.argsort(-many[1:], kind="stable")]):  # the root (owner 0) first: its base is 0
            if many[i] == 1 and owners[i] != 0:
                break
            children = by[first[i] : first[i] + many[i]]
            x = symbol[children]
            least, span = int(x.min()), int(x.max()) - int(x.min())
            at = 0 if owners[i] == 0 else None
            for begin in places.integers(least, top + 1, WINDOWS).tolist() if at is None and top >= least else []:
                free = begin + np.flatnonzero(~used[begin : begin + 512])
                free = free[free + span < len(used)]
                fits = ~used[(free - least)[:, None] + x[None, :]].any(1)
                if fits.any():
                    at = int(free[np.argmax(fits)]) - least
                    break
            if at is None:  # crowded: behind all others
                at = max(top + 1 - least, 0)
            if at + widest + 1 >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + at + widest, bool)])
            used[at + x] = True
            top = max(top, at + int(x.max()))
            base[owners[i]] = at
            slot[1 + children] = at + x
        single = (many == 1) & (owners != 0)
        children = by[first[single]]
        if len(children):
            room = np.flatnonzero(~used[widest:])[: len(children)] + widest  # a slot is no smaller than the symbol
            more = len(children) - len(room)
            room = np.concatenate([room, np.arange(max(len(used), widest), max(len(used), widest) + more)])
            slot[1 + children] = room
            base[owners[single]] = room - symbol[children]
        return base, slot

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """1 + the place of each code in the alphabet, 0 for others."""
        top = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[top], self.start[top + 1]
        out = np.zeros(len(codes), np.int32)
        left = np.flatnonzero((at < stop) & (codes != 0))
        at, stop, want = at[left], stop[left], codes[left]
        while len(left):
            hit = self.alphabet[at] == want
            out[left[hit]] = at[hit] + 1
            go = ~hit & (at + 1 < stop)
            left, at, stop, want = left[go], at[go] + 1, stop[go], want[go]
        return out

    def count(self, codes: np.ndarray) -> np.ndarray:
        """How often each phrase occurs in a sequence of codes; all positions take one step at a time."""
        x = np.append(self.symbols(codes), np.zeros(self.depth, np.int32))
        n = np.zeros(self.size, np.int64)
        at = np.flatnonzero(x)
        state = np.zeros(len(at), np.int32)
        for d in range(self.depth):
            step = x[at + d]
            to = self.base[state] + step
            good = (step > 0) & (self.check[to] == state)
            at, state = at[good], to[good]
            ends = self.final[state]
            n += np.bincount(ends[ends >= 0], minlength=len(n))
        return n


def counted(codes: DataFrame, found: DataFrame, min_count: int, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """codes (array) and a of the candidates that occur min_count times."""
    spark, names = codes.sparkSession, found.columns
    total = found.count()
    shards = max(1, -(-total // trie_rows))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    out = None
    for i in range(shards):
        rows = dealt.where(F.col("shard") == i).select(*names).toArrow()  # about trie_rows rows
        phrases = np.stack([c.to_numpy() for c in rows.columns], 1).view(np.uint64) if rows.num_rows else np.zeros((0, len(names)), np.uint64)
        trie = Trie(phrases)
        named_by = spark.sparkContext.broadcast(trie.phrases)
        shared = spark.sparkContext.broadcast({k: v for k, v in trie.__dict__.items() if k != "phrases"})  # plain values

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = Trie.__new__(Trie)
            trie.__dict__ = shared.value
            n = np.zeros(trie.size, np.int64)
            for c in _sequences(batches):
                n += trie.count(c)
            yield _shard(n)

        def named(block: int, n: np.ndarray, named_by=named_by) -> pa.RecordBatch:
            keep = np.flatnonzero(n >= min_count)
            own = named_by.value[block * BLOCK + keep].view(np.int64)
            size = (own != 0).sum(1)
            flat = pa.array(own[own != 0])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), flat), pa.array(n[keep])], names=["codes", "a"])

        part = stored(_summed(codes.mapInArrow(count, SHARD), named, "codes array<bigint>, a bigint"), "phrase-counts")
        out = part if out is None else out.unionByName(part)
        shared.unpersist()
        named_by.unpersist()
    return out


# ---- report ---------------------------------------------------------------------------------------------------------------------------------------


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases that no longer candidate of equal count contains."""
    codes, words = encoded(docs, min_count)
    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(max(4 * total // min_count, BUCKETS[0]).bit_length(), BUCKETS[1].bit_length() - 1)
    with arrow_rows(docs.sparkSession, ROWS):
        frequent = frequent_buckets(codes, bits, min_count, longest)
        found = stored(candidates(codes, bits, frequent, longest), "phrase-candidates")
        known = stored(counted(codes, found, min_count, trie_rows), "phrase-frequent")
    return _report(known, words.where(F.col("n") >= min_count), sizes, longest, top)


def _report(known: DataFrame, words: DataFrame, sizes: DataFrame, longest: int, top: int) -> DataFrame:
    words = stored(words.select("lang", "code", "word", F.col("n").alias("f")), "phrase-frequent-words")
    every = stored(known.select("codes", "a").unionByName(words.select(F.array("code").alias("codes"), F.col("f").alias("a"))), "phrase-parts")
    size = F.size("codes")
    # the weakest cut
    cut = lambda k: F.array(F.struct(F.lit(k).alias("k"), F.lit(True).alias("front"), F.slice("codes", 1, k).alias("part")), F.struct(F.lit(k).alias("k"), F.lit(False).alias("front"), F.slice("codes", F.lit(k + 1), size - k).alias("part")))
    cuts = F.flatten(F.array_compact(F.array(*(F.when(size > k, cut(k)) for k in range(1, longest)))))
    halves = known.select("codes", "a", F.explode(cuts).alias("c")).select("codes", "a", "c.*")
    halves = halves.join(small(every.select(F.col("codes").alias("part"), F.col("a").alias("f")), SMALL_ROWS), "part")
    halves = halves.groupBy("codes", "a", "k").agg(F.max(F.when(F.col("front"), F.col("f"))).alias("l"), F.max(F.when(~F.col("front"), F.col("f"))).alias("r"))
    # words of the phrases
    named = known.select("codes", F.posexplode("codes").alias("i", "code")).join(small(words, SMALL_ROWS), "code")
    named = named.groupBy("codes").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    # what a longer candidate of the same count contains
    inner = [F.when(size >= i + n + (i == 0), F.slice("codes", i + 1, n)) for n in range(2, longest) for i in range(longest - n + 1)]
    covered = known.where(size > 2).select(F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("codes"), "a").groupBy("codes").agg(F.max("a").alias("longer"))
    rows = halves.join(named, "codes").join(small(sizes, SMALL_ROWS), "lang")
    over, under = _wide(F.lit(1000)) * _wide(F.col("a")) * _wide(F.col("n")), _wide(F.col("l")) * _wide(F.col("r"))
    rows = rows.withColumns({"over": _wide(over), "under": _wide(under)})
    rows = rows.withColumn("score", ((F.col("over") - F.col("over") % F.col("under")) / F.col("under")).cast("bigint"))
    worst = rows.groupBy("codes", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    worst = worst.join(covered, "codes", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    worst = stored(worst.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score"), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = worst.withColumn("rank", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # 64 x top rows of a language at most
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), q AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM q, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), size AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM q GROUP BY lang
), c AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1
), cut AS (
  SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < m
), scored AS (
  SELECT cut.lang, cut.phrase, cut.m, cut.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN size ON size.lang = cut.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + w - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS w) WHERE w < m AND i + w - 1 <= m GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", SQL)
def op11(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents").select("lang", "text"))
