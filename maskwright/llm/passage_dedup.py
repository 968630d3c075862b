"""Removes repeated passages, found by automata over recurring phrases.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window over it also starts earlier: in a
document of smaller id (then text hash), or earlier in the same one. Windows are judged on the input.

1. Confirming: each window selects the least hash of its ``GRAM``-word phrases, so equal windows select equal phrases. Runs
   of windows that select one phrase, ``WINDOW - GRAM + 1`` at most, are one row; phrases of two rows (or of a row that
   repeats a window itself) recur, no other window can.
2. Passages: the words under each run of windows whose phrase recurs, cut out of the documents. Equal passages are one,
   with the first place that has it; all windows of its other places start earlier. A phrase with more than ``HOT`` rows
   gives passages of one window each, keyed by the window instead, so that no key's passages are many.
3. Automata: tasks take whole keys, shard by shard of ``SHARD`` passages. Windows that several passages of a shard have are
   compiled into an Aho-Corasick automaton over words (pyahocorasick), and each distinct passage, which stands for all
   documents that hold it, is streamed through it. Of each window found, the occurrences after its first one go.
4. The spans come together per document, and the words under them are deleted.

Nothing is broadcast. What is shuffled is the selected hashes (about one for six words), recurring passages, and the texts.

Defined cases: null and empty texts have no words; white space alone neither; null ids come first; equal rows that share
an id are one document and get equal results; rows that share an id with different texts are ordered by a hash of the
text; very long texts are worked on one at a time; extra columns pass through, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, release, table, tidy

#: Words of a window and of the phrases that are its fingerprints.
WINDOW, GRAM = 20, 8
#: Rows of a phrase from which its passages are told apart by windows.
HOT = 2000
#: Passages whose windows are compiled into one automaton, but for those of one key.
SHARD = 40_000
_NULL_ID = -(1 << 62)


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over word hashes, and the inverse powers that shift a run's sum to its start."""
    up, down = B._power(len(h) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)]), down


def _runs_hash(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the words in each run, wherever it stands."""
    return B.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def selected(h: np.ndarray, row: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a run of texts: (phrase hash, first window, windows, whether a window repeats within) of each row."""
    m = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.view(np.uint64), none, none, np.zeros(0, bool)
    ok = row[:m] == row[window - 1 :]
    sums, down = _sums(h)
    at = np.arange(len(h) - gram + 1)
    g = _runs_hash(sums, down, at, at + gram)
    width = window - gram + 1  # phrases of a window
    least, have = g, 1
    while have < width:  # minima of doubling width
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    least = least[:m]
    start = np.ones(m, bool)
    start[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    start &= ok
    # longer runs (texts that repeat themselves) are cut
    head = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    start[ok] = (np.arange(m)[ok] - head[run[ok]]) % width == 0
    head = np.flatnonzero(start)
    size = np.bincount((np.cumsum(start) - 1)[ok], minlength=len(head)) if len(head) else none
    w = _runs_hash(sums, down, np.arange(m), np.arange(m) + window)
    again = np.zeros(m, bool)
    for k in range(1, min(width, m)):
        again[k:] |= w[k:] == w[:-k]
    again = np.concatenate([[0], np.cumsum(again & ok)])
    return least[head], head, size, again[head + size] > again[head]


def _select_batches(window: int, gram: int):
    """(d, th, text) to (phrase, d, th, first window in the document, windows, weight)."""

    def go(batches):
        for batch in batches:
            data, off = B.buffers(batch.column(2))
            d, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in B.runs(off):
                part = data[off[i] : off[j]]
                begin, end, before = B.words(part, off[i : j + 1] - off[i], B.NOT_SPACE)
                row = np.repeat(np.arange(j - i), np.diff(before))
                phrase, head, size, again = selected(B.span_hashes(part, begin, end), row, window, gram)
                if len(head):
                    r = row[head]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(phrase.view(np.int64)), pa.array(d[i:j][r]), pa.array(th[i:j][r]), pa.array((head - before[r]).astype(np.int32)), pa.array(size.astype(np.int8)), pa.array((1 + again).astype(np.int8))],
                        names=["f", "d", "th", "s", "n", "weight"],
                    )

    return go


_PASSAGES = "key long, h1 long, h2 long, d long, th long, s int, n int, words binary"


def _cut_batches(window: int):
    """(d, th, text, places) to passages: places are (s, n, f, hot) with the first window, how many, the phrase, and whether by window."""

    def go(batches):
        for batch in batches:
            data, off = B.buffers(batch.column(2))
            d, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            places = lists.flatten()
            s, n, f, hot = (places.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            for i, j in B.runs(off):
                part = data[off[i] : off[j]]
                begin, end, before = B.words(part, off[i : j + 1] - off[i], B.NOT_SPACE)
                if not len(begin):
                    continue
                h = B.span_hashes(part, begin, end)
                at = np.flatnonzero((of >= i) & (of < j))
                split = hot[at].astype(bool)
                # a hot phrase's windows one by one
                times = np.where(split, n[at], 1)
                which = np.repeat(at, times)
                step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                by_window = hot[which].astype(bool)
                size = np.where(by_window, 1, n[which])
                first = s[which] + np.where(by_window, step, 0)
                r = of[which] - i
                a = before[r] + first
                z = a + size - 1 + window
                (sums, down), (other, down2) = _sums(h), _sums(B.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                h1, h2 = _runs_hash(sums, down, a, z), _runs_hash(other, down2, a, z)
                key = np.where(by_window, h1.view(np.int64), f[which])
                yield from _with_words(key, h1, h2, d[i:j][r], th[i:j][r], first, size, part, begin[a], end[z - 1])

    return go


def _with_words(key, h1, h2, d, th, s, n, part, begin, end):
    """Passages with their words, a bounded number of bytes at a time."""
    raw = part.tobytes()
    sizes = np.concatenate([[0], np.cumsum(end - begin)])
    for a, z in B.runs(sizes):
        texts = [b" ".join(raw[x:y].split()) for x, y in zip(begin[a:z].tolist(), end[a:z].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[a:z]), pa.array(h1[a:z].view(np.int64)), pa.array(h2[a:z].view(np.int64)), pa.array(d[a:z]), pa.array(th[a:z]), pa.array(s[a:z].astype(np.int32)), pa.array(n[a:z].astype(np.int32)), pa.array(texts, pa.binary())],
            names=["key", "h1", "h2", "d", "th", "s", "n", "words"],
        )


class Shard:
    """Passages of whole keys, their recurring windows as an automaton over words, and what it finds."""

    def __init__(self, window: int):
        self.window = window
        self.letter: dict[bytes, str] = {}
        self.passages: list[tuple[tuple, str]] = []

    def add(self, place: tuple, words: bytes) -> None:
        letter, text = self.letter, []
        for w in words.split(b" "):
            c = letter.get(w)
            if c is None:
                k = len(letter) + 1
                c = letter[w] = chr(k if k < 0xD800 else k + 0x800)  # no surrogates
            text.append(c)
        self.passages.append((place, "".join(text)))

    def recurring(self) -> set[int]:
        """Hashes of the windows that the passages have more than once."""
        flat = np.frombuffer("".join([p for _, p in self.passages]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(p) for _, p in self.passages], np.int64)
        end = np.cumsum(size)
        n = np.maximum(size - self.window + 1, 0)
        begin = np.repeat(end - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sums, down = _sums(B.mix(flat))
        self.hashes = _runs_hash(sums, down, begin, begin + self.window)
        self.first = np.cumsum(n) - n
        found, count = np.unique(self.hashes, return_counts=True)
        return found[count > 1]

    def later(self) -> list[tuple[tuple, int, int]]:
        """(place of the passage, first and last of the windows that start earlier elsewhere)."""
        import ahocorasick

        often = self.recurring()
        if not len(often):
            return []
        at = np.minimum(np.searchsorted(often, self.hashes), len(often) - 1)
        again = often[at] == self.hashes
        automaton, window = ahocorasick.Automaton(ahocorasick.STORE_INTS), self.window
        of = np.searchsorted(self.first, np.flatnonzero(again), "right") - 1
        compiled, with_windows = 0, sorted(set(of.tolist()))
        for i, k in zip(of.tolist(), (np.flatnonzero(again) - self.first[of]).tolist(), strict=True):
            phrase = self.passages[i][1][k : k + window]
            if not automaton.exists(phrase):
                automaton.add_word(phrase, compiled)
                compiled += 1
        automaton.make_automaton()
        seen, out = bytearray(compiled), []
        # in the order of places, so that a window's first match is its first occurrence
        for i in sorted(with_windows, key=lambda i: self.passages[i][0]):
            place, text = self.passages[i]
            for end, which in automaton.iter(text):
                if not seen[which]:
                    seen[which] = 1
                    continue
                k = end - window + 1
                if out and out[-1][0] is place and out[-1][2] == k - 1:
                    out[-1][2] = k
                else:
                    out.append([place, k, k])
        return out


def _stream_batches(window: int, size: int):
    """Passages sorted by key to spans (d, th, first word, end)."""

    def go(batches):
        shard, last, rows = Shard(window), None, 0

        def found():
            hits = shard.later()
            for a in range(0, len(hits), 50_000):
                part = hits[a : a + 50_000]
                s = np.array([p[0][2] for p in part], np.int64)
                first, end = s + [p[1] for p in part], s + [p[2] for p in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0][0] for p in part], pa.int64()), pa.array([p[0][1] for p in part], pa.int64()), pa.array(first.astype(np.int32)), pa.array((end + window).astype(np.int32))],
                    names=["d", "th", "a", "z"],
                )

        for batch in batches:
            keys, d, th, s, words = (batch.column(k).to_pylist() for k in range(5))
            for i, key in enumerate(keys):
                if rows >= size and key != last:
                    yield from found()
                    shard, rows = Shard(window), 0
                shard.add((d[i], th[i], s[i]), words[i])
                last, rows = key, rows + 1
        if rows:
            yield from found()

    return go


def keep_words(data: np.ndarray, off: np.ndarray, spans: list[list[tuple[int, int]] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: (bytes of the kept words, joined by blanks; offsets; words; words removed)."""
    begin, end, before = B.words(data, off, B.NOT_SPACE)
    n = np.diff(before)
    change = np.zeros(len(begin) + 1, np.int64)
    for r, own in enumerate(spans):
        for a, z in own or ():
            change[before[r] + a] += 1
            change[before[r] + z] -= 1
    gone = np.cumsum(change[:-1]) > 0
    row = np.repeat(np.arange(len(n)), n)
    removed = np.bincount(row[gone], minlength=len(n))
    kept = np.flatnonzero(~gone)
    last = np.ones(len(kept), bool)
    last[:-1] = row[kept[1:]] != row[kept[:-1]]
    # the byte after a kept word is white space, which stays as one blank, but for the last word of a text
    mark = np.zeros(len(data) + 1, np.int8)
    mark[begin[kept]] += 1
    mark[end[kept]] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
    blank = end[kept[~last]]
    keep[blank] = True
    out = data.copy()
    out[blank] = 32
    size = np.bincount(row[kept], (end - begin)[kept] + ~last, len(n)).astype(np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(size)]), n, removed


def _apply_batches(text_at: int):
    def go(batches):
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(batch.num_columns - 1)
            data, off = B.buffers(texts)
            for i, j in B.runs(off):
                own = [None if x is None else [(y["a"], y["z"]) for y in x] for x in spans[i:j].to_pylist()]
                out, ends, n, removed = keep_words(data[off[i] : off[j]], off[i : j + 1] - off[i], own)
                new = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))).cast(texts.type)
                if texts.null_count:
                    import pyarrow.compute as pc

                    new = pc.if_else(texts[i:j].is_valid(), new, pa.scalar(None, texts.type))
                cols = [new if k == text_at else batch.column(k)[i:j] for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64))], names=[*batch.schema.names[:-1], "n_words", "n_removed"])

    return go


def repeated_spans(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(_d, _th, spans): per document (id, hash of its text) with repeated words, which they are: array<struct<a, z>>, z exclusive."""
    spark = docs.sparkSession
    key, body = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NULL_ID)), F.col(f"`{text}`")
    named = docs.filter(body.isNotNull()).select(key.alias("d"), F.xxhash64(body).alias("th"), body.alias("t"))
    once = "f long, d long, th long, s int, n byte, weight byte"
    rows = materialise(named.mapInArrow(tidy(_select_batches(window, gram)), once), "selected", clean=True)
    often = rows.groupBy(F.col("f").alias("_f")).agg(F.sum("weight").alias("w")).filter("w > 1").select("_f", (F.col("w") > hot).cast("byte").alias("hot"))
    often = materialise(often, "often", clean=True)
    places = rows.join(often, F.col("f") == F.col("_f")).groupBy(F.col("d").alias("_d"), F.col("th").alias("_th")).agg(F.collect_list(F.struct(F.col("s"), F.col("n").cast("int").alias("n"), F.col("f"), F.col("hot").cast("int").alias("hot"))).alias("places"))
    places = materialise(places, "places", clean=True)
    release(spark, rows, often)
    held = named.join(places.hint("merge"), (F.col("d") == F.col("_d")) & (F.col("th") == F.col("_th"))).select("d", "th", "t", "places")
    passages = materialise(held.mapInArrow(tidy(_cut_batches(window)), _PASSAGES), "passages", clean=True)
    release(spark, places)
    place = F.struct("d", "th", "s")
    firsts = passages.groupBy("key", "h1", "h2").agg(F.min(place).alias("first"), F.first("words").alias("words"), F.first("n").alias("n"))
    firsts = materialise(firsts, "firsts", clean=True)
    streamed = firsts.select("key", "first.d", "first.th", "first.s", "words").repartition("key").sortWithinPartitions("key")
    found = streamed.mapInArrow(tidy(_stream_batches(window, shard)), "d long, th long, a int, z int")
    of = [F.col(c).alias(f"_{c}") for c in ("key", "h1", "h2")]
    other = passages.select("key", "h1", "h2", "d", "th", "s", "n").join(firsts.select(*of, "first"), (F.col("key") == F.col("_key")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(place != F.col("first"))
    other = other.select("d", "th", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + window).alias("z"))
    spans = found.unionByName(other).groupBy(F.col("d").alias("_d"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    spans = materialise(spans, "spans", clean=True)
    release(spark, passages, firsts)
    return spans


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with texts as the kept words, one blank apart, and n_words, n_removed (0 for null texts, which stay null)."""
    names = docs.columns
    inner = [f"_k{i}" for i in range(len(names))]
    own = docs.select(*(F.col(f"`{n}`").alias(a) for n, a in zip(names, inner, strict=True)))
    id_at, text_at = inner[names.index(doc_id)], inner[names.index(text)]
    spans = repeated_spans(own, id_at, text_at, **options)
    both = own.withColumn("_key", F.coalesce(F.col(id_at).cast("long"), F.lit(_NULL_ID))).withColumn("_h", F.xxhash64(text_at))
    both = both.join(spans.hint("merge"), (F.col("_key") == F.col("_d")) & (F.col("_h") == F.col("_th")) & F.col(text_at).isNotNull(), "left")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "n_words long, n_removed long"])
    done = both.select(*inner, "spans").mapInArrow(tidy(_apply_batches(names.index(text))), shape)
    return done.select(*(F.col(a).alias(n) for n, a in zip(names, inner, strict=True)), "n_words", "n_removed")


def op11_query(spark, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS content FROM d, unnest(range(1, len(w) - 18)) AS r(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS o FROM win) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (
  SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS s
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
