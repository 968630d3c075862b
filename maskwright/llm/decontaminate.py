"""Benchmark decontamination with suffix arrays over the training documents.

The documents of a task are cut into shards (runs of whole rows). Each shard sorts its word suffixes into a suffix array
and every benchmark suffix is binary-searched in it; the equal range gives the locations of its verbatim matches, which
chains of neighbouring hits extend to the longest match. Only suffixes that begin with words of the benchmark for a whole
window can match, so only those enter the array: that loses nothing.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``; each further block is one more pass over the
documents, which carry their hits along.

Defined cases: null or empty text has no words, no hits and is kept; null benchmark texts and items without words match
nothing; equal item ids count once; repeated document rows are judged row by row; very long texts make a shard of their
own; an empty benchmark or table gives no hits; other columns pass through ``decontaminate`` untouched, whatever their
names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, table, tidy

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Bytes of document text in a shard.
SHARD_BYTES = 4 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    begin, end, before = B.words(low, offsets, B.LETTERS_DIGITS)
    return B.span_hashes(low, begin, end), before


def index_items(ids: list, texts: pa.Array) -> dict:
    """The benchmark's windows: distinct word sequences (rows padded with -1), and the items that hold each."""
    data, offsets = B.buffers(texts)
    h, before = word_hashes(data, offsets)
    vocab, code = np.unique(h, return_inverse=True)
    n = np.diff(before)
    count = np.where(n > WINDOW, n - WINDOW + 1, (n > 0).astype(np.int64))
    if not count.sum():
        return {"vocab": vocab, "windows": np.zeros((0, WINDOW), np.int64)}
    owner = np.repeat(np.arange(len(ids)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (before[:-1][owner] + place)[:, None] + np.arange(WINDOW)
    rows = np.where(np.arange(WINDOW) < n[owner][:, None], code[np.minimum(at, len(code) - 1)], -1)
    windows, cls = np.unique(rows, axis=0, return_inverse=True)
    cls = cls.ravel()
    order = np.argsort(cls, kind="stable")
    return {
        "vocab": vocab, "windows": windows, "length": (windows >= 0).sum(1), "ids": np.array([str(x) for x in ids], object),
        "of": owner[order], "place": place[order], "first": np.searchsorted(cls[order], np.arange(len(windows) + 1)),
    }


def suffix_array(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` sorted by the WINDOW codes that follow them, and those codes. Codes under 0 are foreign words or ends."""
    padded = np.concatenate([codes, np.full(WINDOW, -2, codes.dtype)])
    keys = padded[starts[:, None] + np.arange(WINDOW)]
    order = np.lexsort(keys.T[::-1])
    return starts[order], keys[order]


def search(keys: np.ndarray, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal range of every window in the sorted suffix keys: one binary search for all of them at a time."""
    bounds = []
    for after in (False, True):
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(keys), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            k = keys[np.minimum(mid, len(keys) - 1)]
            differs = (k != windows) & (np.arange(WINDOW) < length[:, None])
            at = differs.argmax(1)
            row = np.arange(len(windows))
            less = np.where(differs.any(1), k[row, at] < windows[row, at], after)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def hits_of_run(data: np.ndarray, offsets: np.ndarray, index: dict) -> tuple[np.ndarray, dict[int, tuple]]:
    """Words per row, and for each row with hits: (covered word positions, {item number: (words of the longest match, minus its place)})."""
    h, before = word_hashes(data, offsets)
    n_words, found = np.diff(before), {}
    if not len(h) or not len(index["windows"]):
        return n_words, found
    at = np.searchsorted(index["vocab"], h)
    codes = np.where(index["vocab"][np.minimum(at, len(index["vocab"]) - 1)] == h, at, -1)
    # codes of a row never run into the next one: how many known words follow within the row
    foreign = np.flatnonzero(codes < 0)
    stop = np.concatenate([foreign, [len(codes)]])[np.searchsorted(foreign, np.arange(len(codes)), "left")]
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    known = np.minimum(stop, before[1:][row_of]) - np.arange(len(codes))
    least = int(index["length"].min())
    starts = np.flatnonzero(known >= least)
    if not len(starts):
        return n_words, found
    sa, keys = suffix_array(codes, starts)
    lo, hi = search(keys, index["windows"], index["length"])
    count = hi - lo
    win = np.repeat(np.arange(len(count)), count)
    pos = sa[np.repeat(lo, count) + np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)]
    ok = known[pos] >= index["length"][win]  # the window ends within its row
    win, pos = win[ok], pos[ok]
    if not len(win):
        return n_words, found
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + index["length"][win], -1)
    covered = np.cumsum(cover[:-1]) > 0
    # each (row, window) pair names its items; chains of hits on one diagonal make the longest match
    rows = row_of[pos]
    n_of = np.diff(index["first"])[win]
    item = index["of"][np.repeat(index["first"][win], n_of) + np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)]
    place = index["place"][np.repeat(index["first"][win], n_of) + np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)]
    rows, p, size = np.repeat(rows, n_of), np.repeat(pos, n_of), np.repeat(index["length"][win], n_of)
    order = np.lexsort((p, p - place, item, rows))
    rows, item, p, d, size = rows[order], item[order], p[order], (p - place)[order], size[order]
    new = np.ones(len(p), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    longest = np.diff(np.append(head, len(p))) - 1 + size[head]
    for r, i, n, at in zip(rows[head].tolist(), item[head].tolist(), longest.tolist(), (p[head] - before[rows[head]]).tolist(), strict=True):
        items = found.setdefault(r, (np.flatnonzero(covered[before[r] : before[r + 1]]), {}))[1]
        items[i] = max(items.get(i, (0, 0)), (n, -at))  # the first of equally long ones
    return n_words, found


OUT = "n_words long, hit binary, items array<struct<item_id:string,longest:long,at:long>>"


def _search_batches(column: str, index, schema):
    def go(batches):
        known = index.value
        for batch in batches:
            data, offsets = B.buffers(batch.column(column))
            n_words, hit, items = [], [], []
            for i, j in B.runs(offsets, SHARD_BYTES):
                n, found = hits_of_run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known)
                n_words.append(n)
                for r in range(j - i):
                    where, of = found.get(r, (None, {}))
                    hit.append(where.astype(np.int32).tobytes() if where is not None else b"")
                    items.append([{"item_id": known["ids"][k], "longest": n, "at": -at} for k, (n, at) in of.items()])
            words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            own = [pa.array(words, pa.int64()), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.struct([("item_id", pa.string()), ("longest", pa.int64()), ("at", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_own"), *own], names=[*(n for n in batch.schema.names if n != "_own"), "n_words", "hit", "items"])

    return go


def blocks_of(bench: DataFrame, item_id: str, text: str):
    """The benchmark in blocks: [(ids, texts)] one after the other, each near BLOCK_BYTES at most."""
    own = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null and i is not null")
    total = own.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = 1 + total // (BLOCK_BYTES // 2)
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.toArrow()
        yield got.column("i").to_pylist(), got.column("t"), k == n - 1


def find_matches(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, n_words, n_hit and items (item_id, words of the longest verbatim match, the word it is at)."""
    spark = docs.sparkSession
    inner = [f"_k{i}" for i in range(len(keep))]
    now = docs.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keep, inner, strict=True)), F.col(f"`{text}`").alias("_text"))
    base, first = now.schema, True
    for ids, texts, last in blocks_of(bench, item_id, item_text):
        index = spark.sparkContext.broadcast(index_items(ids, texts))
        if first:
            kept = [*inner, "_text"] if not last else inner
            source, first = now.select(*inner, "_text"), False
            out = ", ".join([*(f"`{c}` {base[c].dataType.simpleString()}" for c in [*inner, "_text"]), OUT])
            found = source.mapInArrow(tidy(_search_batches("_text", index, out)), out).select(*kept, "n_words", "hit", "items")
        else:
            # a further block: the earlier hits travel under other names and are merged after the search
            moved = materialise(found.withColumnsRenamed({"hit": "hit0", "items": "items0"}).drop("n_words"), "blocks")
            out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema), OUT])
            found = moved.mapInArrow(tidy(_search_batches("_text", index, out)), out)
            found = found.withColumn("hit", F.concat("hit0", "hit")).withColumn("items", F.concat("items0", "items")).drop("hit0", "items0")
            found = found.drop("_text") if last else found
    # positions are 4 bytes each; more than one block may cover a word twice
    four = F.expr("transform(sequence(1, cast(octet_length(hit) / 4 as int)), i -> substring(hit, i * 4 - 3, 4))")
    n_hit = F.when(F.octet_length("hit") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(four))).cast("long")
    return found.select(*(F.col(a).alias(k) for k, a in zip(keep, inner, strict=True)), "n_words", n_hit.alias("n_hit"), "items")


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns as they were."""
    plain = [f"_c{i}" for i in range(len(docs.columns))]  # so that no name clashes with the figures
    found = find_matches(docs.toDF(*plain), bench, text=plain[docs.columns.index(text)], keep=tuple(plain), **names)
    return found.filter("n_hit = 0").select(*plain).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"])))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_query(spark, sf_dir: str) -> DataFrame:
    return digest(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[q : q + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(q) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(p) WHERE len(w) >= n
), h AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
