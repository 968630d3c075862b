"""Phrase collocations by dynamic itemset counting.

Texts are cut into pieces and words, and written once as ``SHARDS`` shards of 32-bit word codes. Shards are scanned in a
cycle. Single words are counted from the first scan on; a longer phrase becomes active in the scan after both its
subphrases (all words but the last, all but the first) have reached the threshold, and is counted in every scan until it
has seen each shard once: one full cycle, wherever it began. So lengths are counted interleaved, and what frequent words
already promise need not wait for the rare ones.

Active phrases are not listed: a table of ``SLOTS`` bytes per length at any corpus has at the hash of each
phrase that has reached the threshold the scan of that event (tables of smaller corpora are smaller, by the bound of
words / threshold). The scans of both subphrases give a phrase's first scan.
Phrases that share a slot begin no later than they must, and count for a full cycle all the same: shared slots cost
work and change no count. Tasks count what is active by sorted hashes and hand on packed blocks, one per length and
``bucket`` of hashes, which are merged with the counts so far; a phrase that has ended its cycle below the threshold goes.

Hashes of 64 bits may fall together, so the phrases that are left are counted again by their words; that also gives
their text. Scores, containment and ranks are DataFrame operations on exact numbers.

Defined cases: null texts are empty, null languages ``und``; very long texts are one piece of work of their own; repeated
rows count again; ties are broken as the query says; languages without a candidate have no rows; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, shared_dir, table, tidy

#: Words of the longest phrase, and how often a phrase must occur.
LONGEST, LEAST = 4, 30
#: Shards of a cycle.
SHARDS = 4
#: Bytes of the table of reached phrases of one length at most, and slots for each that there can be (words / LEAST).
SLOTS, ROOM = 1 << 24, 16
#: Keys that a task holds before it hands on a block.
HELD = 2_000_000
#: Bytes of text in which phrases are told apart by hashes before they are counted by their text.
GATHER_BYTES = 6 << 20

_END = B._byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (10, 13))
_WORD = ~(_END | B._byte_set((32, 32), (9, 9)))
_NEVER = 255


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one run of lower-cased texts: begins and ends of words, hashes, rows, and whether a word continues its piece."""
    begin, end, before = B.words(data, off, _WORD)
    row = np.repeat(np.arange(len(off) - 1), np.diff(before))
    piece = np.cumsum(_END[data])[begin] if len(begin) else begin
    joins = np.zeros(len(begin), bool)
    joins[1:] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return begin, end, B.span_hashes(data, begin, end), row, joins


def codes_of(hashes: np.ndarray) -> np.ndarray:
    """32-bit word codes; 0 is no word."""
    return np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def keys_of(codes: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the phrase of ``n`` words that begins at each place, within its language."""
    m = max(len(codes) - n + 1, 0)
    h = lang[:m] + np.uint64(n)
    for i in range(n):
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m].astype(np.uint64))
    return h


def lang_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return B.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]


def _code_batches(shards: int):
    """(lang, text, shard) to rows of (shard, lang, codes): the words of a run's texts of one language, pieces apart by 0."""

    def go(batches):
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            langs, shard = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs]) * shards + shard
            for i, j in B.runs(off):
                _, _, h, row, joins = words_of(B.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i])
                group = of[i:j][row]
                for g in np.unique(group).tolist():
                    at = np.flatnonzero(group == g)
                    stop = ~joins[at]
                    # a 0 before each word that begins a piece
                    place = np.arange(len(at)) + np.cumsum(stop)
                    codes = np.zeros(len(at) + int(stop.sum()), np.uint32)
                    codes[place] = codes_of(h[at])
                    yield pa.RecordBatch.from_arrays([pa.array([names[g // shards]]), pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([g % shards], pa.int32())], names=["lang", "codes", "shard"])

    return go


class Reached:
    """For each length below the longest: by slot, the scan after which a phrase had reached the threshold."""

    def __init__(self, longest: int, slots: int):
        self.longest, self.slots = longest, slots
        self.scan = [np.full(slots, _NEVER, np.uint8) for _ in range(longest - 1)]

    def first_scans(self, keys: list[np.ndarray], n: int) -> np.ndarray:
        """The first scan of each phrase of ``n`` words, from the keys of its subphrases at the same places; _NEVER: not active."""
        s = self.scan[n - 2][(keys[n - 2] % np.uint64(self.slots)).astype(np.int64)]
        later = np.maximum(s[:-1], s[1:])
        return np.where(later == _NEVER, _NEVER, later + 1)


def _count_batches(known, scan: int, shards: int, buckets: int, longest: int):
    """(lang, codes) of one shard to packed blocks of (n, bucket, keys, counts, first scans)."""

    def go(batches):
        reached = known.value
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(longest)]

        def flush():
            for n, parts in enumerate(held, 1):
                if not parts:
                    continue
                keys, first = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                parts.clear()
                keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
                yield from _blocks(n, keys, counts, first[at], buckets)

        size = 0
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.frombuffer(raw, "<u4")
                seed = np.full(len(codes), lang_hash(lang))
                keys, ok = [], codes != 0
                for n in range(1, longest + 1):
                    if n > 1:
                        ok = ok[:-1] & (codes[n - 1 :] != 0) if len(codes) >= n else ok[:0]
                    if n == 1:
                        first = np.zeros(len(codes), np.uint8)
                    else:
                        first = reached.first_scans(keys, n)
                    begun = ok & (first <= scan)
                    if not begun.any():  # nor can any longer phrase be active here
                        break
                    keys.append(keys_of(codes, seed, n))
                    now = np.flatnonzero(begun & (first.astype(np.int64) + shards > scan))
                    if len(now):
                        held[n - 1].append((keys[-1][now], first[now]))
                        size += len(now)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return go


_BLOCK = "n int, bucket int, keys binary, counts binary, first binary"


def _blocks(n: int, keys: np.ndarray, counts: np.ndarray, first: np.ndarray, buckets: int):
    """Sorted keys cut by their upper bits; a block's keys are written as differences."""
    edge = [(b << 64) // buckets for b in range(buckets)]
    cut = [*np.searchsorted(keys, np.array(edge, np.uint64)).tolist(), len(keys)]
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if s < e]
    packed = lambda x, kind: pa.array([x[s:e].astype(kind).tobytes() for _, s, e in rows], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), n, np.int32)), pa.array(np.array([b for b, _, _ in rows], np.int32)), packed(keys, "<u8"), packed(counts, "<u4"), packed(first, np.uint8)],
        names=["n", "bucket", "keys", "counts", "first"],
    )


def _merge_blocks(scan: int, shards: int, least: int):
    """All blocks of one length and bucket: the counts so far, and the slots' news.

    Counts are kept in 64 bits with the scan after which they reached the threshold (255: not yet).
    """

    def go(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        old = blocks[blocks["reached"].notna()]
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in blocks["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u4" if r is None else "<u8").astype(np.int64) for x, r in zip(blocks["counts"], blocks["reached"], strict=True)])
        first = np.concatenate([np.frombuffer(x, np.uint8) for x in blocks["first"]])
        keys, of = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, of, counts)
        begun = np.zeros(len(keys), np.uint8)
        begun[of] = first
        reached = np.full(len(keys), _NEVER, np.uint8)
        for k, r in zip(old["keys"], old["reached"], strict=True):
            reached[np.searchsorted(keys, np.frombuffer(k, "<u8"))] = np.frombuffer(r, np.uint8)
        reached[(total >= least) & (reached == _NEVER)] = scan
        stay = (reached != _NEVER) | (begun.astype(np.int64) + shards - 1 > scan)
        out = [x[stay] for x in (keys, total, begun, reached)]
        return pd.DataFrame({"n": [int(key[0])], "bucket": [int(key[1])], "keys": [out[0].astype("<u8").tobytes()], "counts": [out[1].astype("<u8").tobytes()], "first": [out[2].tobytes()], "reached": [out[3].tobytes()]})

    return go


def _slots_of(slots: int, scan: int | None):
    """State blocks to (n, slot) of the phrases that reached the threshold after ``scan`` (None: ever)."""

    def go(batches):
        for batch in batches:
            for n, keys, reached in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                r = np.frombuffer(reached, np.uint8)
                got = np.frombuffer(keys, "<u8")[r == scan if scan is not None else r != _NEVER]
                slot = np.unique(got % np.uint64(slots)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), n, np.int32)), pa.array(slot)], names=["n", "slot"])

    return go


def frequent_slots(docs: DataFrame, least: int, longest: int, shards: int, slots: int) -> list[np.ndarray]:
    """Dynamic itemset counting over (lang, text): per length, which slots hold phrases that occur ``least`` times."""
    spark = docs.sparkSession
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")  # written at once, so that any deal will do
    coded = docs.select("lang", "text", shard.alias("shard")).mapInArrow(tidy(_code_batches(shards)), "lang string, codes binary, shard int")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    coded.write.partitionBy("shard").parquet(path)
    written = spark.read.schema("lang string, codes binary, shard int").parquet(path)
    size = written.agg(F.sum(F.octet_length("codes")).alias("n")).first()["n"] or 0
    buckets = 1 + int(size) // (4 << 20)
    slots = min(slots, 1 << (ROOM * int(size) // 4 // least + 1).bit_length())
    reached = Reached(longest, slots)
    state, scan, active_until = None, 0, shards  # words are counted in the first cycle
    while scan < active_until and size:
        known = spark.sparkContext.broadcast(reached)
        part = written.filter(F.col("shard") == scan % shards).select("lang", "codes")
        counted = part.mapInArrow(tidy(_count_batches(known, scan, shards, buckets, longest)), _BLOCK).withColumn("reached", F.lit(None).cast("binary"))
        both = counted if state is None else counted.unionByName(state)
        state = materialise(both.groupBy("n", "bucket").applyInPandas(_merge_blocks(scan, shards, least), _BLOCK + ", reached binary"), "state")
        known.destroy()
        news = state.filter(F.col("n") < longest).select("n", "keys", "reached").mapInArrow(_slots_of(slots, scan), "n int, slot long").distinct().toArrow()
        n, slot = news.column("n").to_numpy(), news.column("slot").to_numpy()
        for k in range(1, longest):
            at = slot[n == k]
            at = at[reached.scan[k - 1][at] == _NEVER]
            reached.scan[k - 1][at] = scan
            if len(at):
                active_until = max(active_until, scan + 1 + shards)
        scan += 1
    out = [np.zeros(slots, bool) for _ in range(longest)]
    if state is not None:
        ever = state.select("n", "keys", "reached").mapInArrow(_slots_of(slots, None), "n int, slot long").distinct().toArrow()
        n, slot = ever.column("n").to_numpy(), ever.column("slot").to_numpy()
        for k in range(longest):
            out[k][slot[n == k + 1]] = True
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, near ``GATHER_BYTES`` at most, or one."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GATHER_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _text_batches(known, longest: int):
    """(lang, text) to (lang, phrase, words, count, n): phrases whose slots are set, and per language one row with all words."""

    def go(batches):
        bits = known.value
        for batch in _gathered(batches):
            data, off = B.buffers(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in B.runs(off, GATHER_BYTES):
                low = B.LOWER[data[off[i] : off[j]]]
                begin, end, h, row, joins = words_of(low, off[i : j + 1] - off[i])
                if not len(h):
                    continue
                names, of = np.unique(np.array(langs[i:j], object), return_inverse=True)
                lang, codes = of[row], codes_of(h)
                seed = np.array([lang_hash(x) for x in names], np.uint64)[lang]
                counts = np.bincount(lang, minlength=len(names))
                have = np.flatnonzero(counts)
                yield _phrases([names[k] for k in have], ["" for _ in have], 0, counts[have])
                raw, ok = low.tobytes(), np.ones(len(h), bool)
                for n in range(1, longest + 1):
                    if n > 1:
                        ok = ok[:-1] & joins[n - 1 :]
                    key, exact = keys_of(codes, seed, n), keys_of(h, seed, n)
                    at = np.flatnonzero(ok & bits[n - 1][(key % np.uint64(len(bits[0]))).astype(np.int64)])
                    at = at[np.argsort(exact[at], kind="stable")]
                    if not len(at):
                        continue
                    e = exact[at]
                    head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                    counts = np.diff(np.append(head, len(at)))
                    one = at[head]
                    texts = [b" ".join([raw[begin[p + k] : end[p + k]] for k in range(n)]).decode() for p in one.tolist()]
                    yield _phrases([names[k] for k in lang[one]], texts, n, counts)

    return go


def _phrases(langs: list, texts: list, n: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(np.full(len(texts), n, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "k", "f"])


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, phrase, k, f): all phrases of up to ``longest`` words that occur ``least`` times; k = 0: all words of a language."""
    own = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bits = own.sparkSession.sparkContext.broadcast(frequent_slots(own, least, longest, shards, slots))
    found = own.mapInArrow(tidy(_text_batches(bits, longest)), "lang string, phrase string, k int, f long")
    return materialise(found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= least)), "phrases")


def collocations(counts: DataFrame, longest: int = LONGEST, top: int = 2000, share: int = 80) -> DataFrame:
    """Ranked candidates from ``phrase_counts``: lang, rank, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    whole = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    joined = lambda x: F.array_join(x, " ")
    cuts = whole.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.slice("w", F.lit(1), F.col("cut"))).alias("left"), joined(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    part = lambda side, f: counts.filter("k > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = whole.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", joined(F.slice("w", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(F.expr("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * " + str(share)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents
), p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM d, unnest(ps) AS u(x)),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM p, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, s.q, fl.f AS l, fr.f AS r, (2000000::HUGEINT * c.a) // (fl.f + fr.f) AS score
  FROM c, unnest(range(1, c.k)) AS s(q)
  JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(c.w[1 : s.q], ' ')
  JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(c.w[s.q + 1 : c.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, q) = 1),
inside AS (
  SELECT c.lang, array_to_string(c.w[i : i + z - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c, unnest(range(2, c.k)) AS s(z), unnest(range(1, c.k - z + 2)) AS t(i) GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
