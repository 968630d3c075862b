"""Language-model scores of whole texts: prediction by partial matching over bytes, and a unigram word base.

The model knows every byte n-gram of the training rows: ``DEPTH`` bytes of context and a symbol (texts begin after zero
bytes and end with one), at any size of the corpus. A context escapes with one for each symbol seen after it; below it,
these symbols are excluded and the rest renormalised. A text's score is the sum of log10 probabilities of its bytes and
its end. Word counts are exact over all rows.

Documents are dealt in blocks of about ``BLOCK_BYTES`` by a hash. A block gives each of its distinct n-grams and words with
their training counts to buckets, n-grams by their nearest ``NEAR`` bytes of context: all longer contexts that end alike are
in one bucket, which sums them over all blocks and makes its part of the model. Every block gets back the probabilities and
counts of what it asked for, and sums them per document. Levels below ``NEAR`` (at most 256^NEAR n-grams) are broadcast. A bucket
holds what the corpus has of its contexts, so that its memory grows with the distinct n-grams of the most frequent context
of ``NEAR`` bytes. Numbers of blocks and buckets follow from the size of the texts; no result depends on them.

Defined cases: null or empty texts have one token, the end; very long texts are scored in one piece; repeated rows get
equal scores, and repeated training rows count each time; without training rows counts are zero and scores come from the
uniform floor; words are equal if their 64-bit hashes are; probabilities travel in single precision; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import fold, materialise, release, table, tidy

DEPTH, NEAR = 6, 3
#: Bytes of text whose n-grams are summed together before they are shuffled.
BLOCK_BYTES = 48 << 20
#: Counts that are held unmerged at most.
HELD = 4_000_000
#: The end of a text as a word.
END_WORD = np.uint64(0x2545F4914F6CDD1D)


def byte_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the DEPTH bytes before and the symbol, for each symbol and end; where each row's codes begin, rows + 1)."""
    rows = len(off) - 1
    pad = DEPTH + 1
    x = np.zeros(len(data) + pad * rows, np.uint64)
    x[np.arange(len(data)) + np.repeat(np.arange(rows) * pad + DEPTH, np.diff(off))] = data
    code = x.copy()
    for i in range(1, pad):
        code[i:] |= x[:-i] << np.uint64(8 * i)
    real = np.ones(len(x), bool)
    begin = off[:-1] + np.arange(rows) * pad
    for i in range(DEPTH):
        real[begin + i] = False
    # what lies before a row's padding is not its context; the padding is as long as the context, so nothing leaks
    return code[real], off + np.arange(rows + 1)


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    begin, end, before = B.words(low, off, B.NOT_SPACE)
    return B.span_hashes(low, begin, end), before


class Counts:
    """Sums of counts of n-gram codes: sorted runs are merged when many are held."""

    def __init__(self):
        self.parts, self.large, self.held = [], [], 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        """Counts above a byte are kept apart, others travel in the low byte of their code through the sort."""
        large = np.flatnonzero(n > 255)
        if len(large):
            self.large.append((code[large], n[large].astype(np.int64)))
            n = n.copy()
            n[large] = 0
        self.parts.append((code << np.uint64(8)) | n.astype(np.uint64))
        self.held += len(code)
        if self.held > HELD:
            code, n = self.result()
            large = n > 255
            self.large = [(code[large], n[large])]
            self.parts = [(code << np.uint64(8)) | np.where(large, 0, n).astype(np.uint64)]
            self.held = 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct codes in order, their counts)."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        x = np.sort(np.concatenate(self.parts))
        key = x >> np.uint64(8)
        first = _firsts(key)
        code, n = key[first], np.add.reduceat((x & np.uint64(255)).astype(np.int64), first) if len(x) else np.zeros(0, np.int64)
        for c, m in self.large:
            np.add.at(n, np.searchsorted(code, c), m)
        return code, n


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def _packed(values: np.ndarray) -> bytes:
    """How many values there are, and their bytes, lowest first, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else b""
    return len(values).to_bytes(4, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[4:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _slices(batches, keys: int):
    """(values of the first ``keys`` columns, the rows) of neighbouring rows that are equal there."""
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            of = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            for c in of:
                new[1:] |= c[1:] != c[:-1]
            begin = np.flatnonzero(new).tolist()
            for a, z in zip(begin, [*begin[1:], batch.num_rows], strict=True):
                yield tuple(int(c[a]) for c in of), batch.slice(a, z - a)


def _word_sums(parts) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    u, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(of, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)


_ASKED = "block int, bucket int, codes binary, n binary, words binary, t binary, train_tokens long"


def _ask_batches(buckets: int):
    """(block, train, text), sorted by block, to a block's distinct codes and words with training counts, by bucket.

    Bucket -1 has the block's training codes below level ``NEAR``.
    """
    names = [x.split()[0] for x in _ASKED.split(", ")]

    def rows(block: int, codes: Counts, words: list):
        code, n = codes.result()
        low = Counts()
        seen = code[n > 0] & np.uint64((1 << 8 * NEAR) - 1)
        order = np.argsort(seen, kind="stable")
        first = _firsts(seen[order])
        if len(first):
            low.add(seen[order][first], np.add.reduceat(n[n > 0][order], first))
        low_code, low_n = low.result()
        word, t = _word_sums(words)
        of = (B.mix((code >> np.uint64(8)) & np.uint64((1 << 8 * NEAR) - 1)) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        at, code, n = np.searchsorted(of[order], np.arange(buckets + 1)), code[order], n[order].astype(np.uint32)
        of = (word % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        to, word, t = np.searchsorted(of[order], np.arange(buckets + 1)), word[order], t[order]
        out = [(block, -1, _packed(low_code), _packed(low_n), _packed(word[:0]), _packed(t[:0]), 0)]
        for b in range(buckets):
            c, w = slice(at[b], at[b + 1]), slice(to[b], to[b + 1])
            if at[b] < at[b + 1] or to[b] < to[b + 1]:
                out.append((block, b, _packed(code[c]), _packed(n[c]), _packed(word[w]), _packed(t[w]), int(t[w].sum())))
            if len(out) == 64 or b == buckets - 1:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out = []

    def go(batches):
        now, codes, words, held = None, Counts(), [], 0
        for (block,), part in _slices(batches, 1):
            if block != now:
                if now is not None:
                    yield from rows(now, codes, words)
                now, codes, words, held = block, Counts(), [], 0
            data, off = B.buffers(part.column(2))
            train = np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
            for i, j in B.runs(off):
                d, o, tr = data[off[i] : off[j]], off[i : j + 1] - off[i], train[i:j]
                code, begin = byte_codes(d, o)
                x = np.sort((code << np.uint64(1)) | np.repeat(tr, np.diff(begin)))
                first = _firsts(x >> np.uint64(1))
                codes.add(x[first] >> np.uint64(1), np.add.reduceat((x & np.uint64(1)).astype(np.int64), first))
                h, before = word_codes(d, o)
                h, known = np.append(h, END_WORD), np.append(np.repeat(tr, np.diff(before)), tr.sum())
                u, of = np.unique(h, return_inverse=True)
                words.append((u, np.bincount(of, known, len(u)).astype(np.int64)))
                held += len(u)
                if held > HELD // 4:
                    words, held = [_word_sums(words)], 0
        if now is not None:
            yield from rows(now, codes, words)

    return go


def _low_batches(batches):
    """Packed codes and counts to rows (code, n)."""
    for batch in batches:
        for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(codes, np.uint64).view(np.int64)), pa.array(_unpacked(n, np.int64))], names=["code", "n"])


_TOLD = "block int, codes binary, logp binary, words binary, counts binary, v long"


def _tell(low):
    """A bucket's part of the model: (block, codes, their log10 probabilities, words, their training counts) for each block that asked; ``v``: trained words, once."""

    def go(asked: pa.Table) -> pa.Table:
        raw = {c: asked.column(c).to_pylist() for c in ("block", "codes", "n", "words", "t")}
        codes, words = Counts(), []
        for c, n, w, t in zip(raw["codes"], raw["n"], raw["words"], raw["t"], strict=True):
            codes.add(_unpacked(c, np.uint64), _unpacked(n, np.uint32))
            words.append((_unpacked(w, np.uint64), _unpacked(t, np.int64)))
        code, n = codes.result()
        word, count = _word_sums(words)
        del codes, words
        seen, m = code[n > 0], n[n > 0]
        levels = [_level(seen, m, k) for k in range(NEAR, DEPTH + 1)]
        logp = Trie(levels, low.value).score(code).astype(np.float32)
        told = [_packed(logp[np.searchsorted(code, _unpacked(c, np.uint64))]) for c in raw["codes"]]
        counts = [_packed(count[np.searchsorted(word, _unpacked(w, np.uint64))]) for w in raw["words"]]
        v = [int((count > 0).sum()), *[0] * (len(told) - 1)]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64()]
        cols = [raw["block"], raw["codes"], told, raw["words"], counts, v]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _TOLD.split(", ")])

    return go


def _level(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``k`` bytes of context and their counts, in order."""
    short = code & np.uint64((1 << 8 * (k + 1)) - 1)
    order = np.argsort(short, kind="stable")
    short = short[order]
    first = _firsts(short)
    return short[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


class Trie:
    """Levels 0..DEPTH: sorted codes (context and symbol) with log10 probability; sorted contexts with escape weight.

    With ``low``, its levels come first and ``levels`` are those after them.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], low: Trie | None = None):
        self._tables: list[tuple[Lookup, Lookup]] | None = None
        if low is not None:
            self.codes, self.logp, self.ctx, self.back, self.prob = ([*x] for x in (low.codes, low.logp, low.ctx, low.back, low.prob))
            self._tables = [*low.tables()]
            self._grow([low.last, *levels])
            return
        self.codes, self.logp, self.ctx, self.back, self.prob = [], [], [], [], []
        n0 = np.zeros(256)
        if len(levels[0][0]):
            n0[levels[0][0].astype(int)] = levels[0][1]
        p = (n0 + 0.5) / (n0.sum() + 128)
        self.codes.append(np.arange(256, dtype=np.uint64))
        self.prob.append(p)
        self.logp.append(np.log10(p))
        self.ctx.append(np.zeros(1, np.uint64))
        self.back.append(np.zeros(1))
        self._grow(levels)

    def _grow(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adds a level for each but the first of ``levels``, which is the last that is there."""
        self.last, prob = levels[-1], self.prob
        for (below, count), (c, n) in zip(levels, levels[1:], strict=False):
            k = len(self.codes)
            ctx = c >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(c) else np.zeros(0, np.int64)
            u = ctx[first]
            q = np.diff(np.append(first, len(c))).astype(float)
            kept = np.add.reduceat(n, first).astype(float) if len(c) else np.zeros(0)
            # a context was seen as often as the string it is, but for the starts of texts
            at = np.minimum(np.searchsorted(below, u), max(len(below) - 1, 0))
            seen = np.where(below[at] == u, count[at], 0) if len(below) and len(u) else np.zeros(len(u))
            total = np.maximum(kept, seen)
            of = np.repeat(np.arange(len(u)), q.astype(int))
            p = n / (total + q)[of] if len(c) else np.zeros(0)
            escape = (total - kept + q) / (total + q)
            lower = prob[k - 1][np.searchsorted(self.codes[k - 1], c & np.uint64((1 << 8 * k) - 1))] if len(c) else np.zeros(0)
            rest = 1 - (np.add.reduceat(lower, first) if len(c) else np.zeros(0))
            self.codes.append(c)
            prob.append(p)
            self.logp.append(np.log10(p))
            self.ctx.append(u)
            self.back.append(np.log10(escape / np.maximum(rest, 1e-9)))

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}  # tasks build them anew

    def tables(self) -> list[tuple[Lookup, Lookup]]:
        have = self._tables or []
        self._tables = [*have, *((Lookup(c), Lookup(x)) for c, x in zip(self.codes[len(have) :], self.ctx[len(have) :], strict=True))]
        return self._tables

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        tables = self.tables()
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(len(self.codes) - 1, 0, -1):
            own = code[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            hit, at = tables[k][0].find(own)
            out[todo[hit]] += self.logp[k][at[hit]]
            todo, own = todo[~hit], own[~hit] >> np.uint64(8)
            known, at = tables[k][1].find(own)
            out[todo[known]] += self.back[k][at[known]]
        out[todo] += self.logp[0][(code[todo] & np.uint64(255)).astype(np.int64)]
        return out


class Lookup:
    """Places of 64-bit keys: a hash table with linear probing, at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place) of each wanted key."""
        at = self._home(wanted)
        place = self.slots[at]
        if not len(self.keys):
            return np.zeros(len(wanted), bool), place
        hit = (self.keys[place] == wanted) & (place >= 0)
        left = np.flatnonzero(~hit & (place >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            now = self.slots[at[left]]
            place[left] = now
            ok = (now >= 0) & (self.keys[now] == wanted[left])
            hit[left[ok]] = True
            left = left[~ok & (now >= 0)]
        return hit, place


_ROW_BITS = np.uint64(8)


def _score_batches(batches):
    """(block, kind, doc_id, train, text, codes, logp, words, counts), sorted by block and kind: what a block was told (kind 0), then
    its documents (kind 1), to one row per document: doc_id, train, n_tokens, n_known, log10 of counts + 1, score."""
    now, told, model = None, [], None
    for (block, kind), part in _slices(batches, 2):
        if block != now:
            now, told, model = block, [], None
        if kind == 0:
            told.append([part.column(c).to_pylist() for c in range(5, 9)])
            continue
        if model is None:
            code, logp, word, count = (
                np.concatenate([_unpacked(x, k) for p in told for x in p[c]] or [np.zeros(0, k)]) for c, k in enumerate((np.uint64, np.float32, np.uint64, np.int64))
            )
            by, to = np.argsort(code), np.argsort(word)
            model = code[by], logp[by], word[to], np.log10(count[to] + 1.0), count[to] > 0
            told = []
        code, logp, word, logc, known = model
        end = int(np.searchsorted(word, END_WORD))
        data, off = B.buffers(part.column(4))
        figures = []
        for i, z in B.runs(off):
            for a in range(i, z, 1 << int(_ROW_BITS)):
                j = min(z, a + (1 << int(_ROW_BITS)))
                d, o, size = data[off[a] : off[j]], off[a : j + 1] - off[a], j - a
                own, begin = byte_codes(d, o)
                # a row's number in the low byte: sorted, equal codes lie together and are looked up once
                x = np.sort((own << _ROW_BITS) | np.repeat(np.arange(size, dtype=np.uint64), np.diff(begin)))
                key = x >> _ROW_BITS
                first = _firsts(key)
                each = np.repeat(logp[np.searchsorted(code, key[first])], np.diff(np.append(first, len(x))))
                score = np.bincount((x & np.uint64(255)).astype(np.int64), each, size)
                h, before = word_codes(d, o)
                row, place = np.repeat(np.arange(size), np.diff(before)), np.searchsorted(word, h)
                s, m = (np.bincount(row, v[place], size) + v[end] for v in (logc, known))
                figures.append((np.diff(before) + 1, m.astype(np.int64), s.astype(float), score))
        cols = [pa.array(np.concatenate([f[c] for f in figures])) for c in range(4)]
        yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), *cols], names=["doc_id", "train", "n_tokens", "n_known", "s", "score"])


def language_model_scores(docs: DataFrame, train: F.Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score and score. ``train``: rows to learn from."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blocks = max(1, math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    buckets = min(4096, max(64, 16 * blocks))
    own = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "*")
    texts = own.select("block", "train", "text").repartitionById(blocks, "block").sortWithinPartitions("block")
    asked = materialise(texts.mapInArrow(tidy(_ask_batches(buckets)), _ASKED), "asked", clean=True)
    below = asked.filter("bucket < 0").select("codes", "n").mapInArrow(tidy(_low_batches), "code long, n long")
    below = below.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = below.column("code").to_numpy().view(np.uint64), below.column("n").to_numpy()
    low = spark.sparkContext.broadcast(Trie([_level(code, n, k) for k in range(NEAR)]))
    told = asked.filter("bucket >= 0").groupBy("bucket").applyInArrow(_tell(low), _TOLD)
    told = materialise(told, "told", clean=True)
    n_train = asked.agg(F.sum("train_tokens")).first()[0] or 0
    distinct = told.agg(F.sum("v")).first()[0] or 0
    release(spark, asked)
    missing = lambda of, names: [F.lit(None).cast(of.schema[c].dataType).alias(c) for c in names]
    packed = ["codes", "logp", "words", "counts"]
    told = told.select("block", F.lit(0).alias("kind"), *missing(own, ("doc_id", "train", "text")), *packed)
    both = told.unionByName(own.select("block", F.lit(1).alias("kind"), "doc_id", "train", "text", *missing(told, packed)))
    both = both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    scored = both.mapInArrow(tidy(_score_batches), "doc_id long, train boolean, n_tokens long, n_known long, s double, score double")
    base = F.col("s") - F.col("n_tokens") * F.lit(math.log10(n_train + distinct + 1))
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = language_model_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
