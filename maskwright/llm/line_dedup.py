"""Deletes line runs that an earlier document, or an earlier place of the same one, already has.

A window is the least run of non-blank lines that has ``MIN_WORDS`` words, from a line on or, mirrored, up to a line.
Every line of a longer run lies in a window of that run, so the windows that repeat cover each repeated run in full, from
its first line to its last. Winnowing: each window selects its least line hash as fingerprint, so every repeated run with
a window holds a repeated fingerprint. Positions of repeated fingerprints are joined; there the matches are extended both
ways, to all windows around the fingerprint, and compared by content. Windows whose content has an earlier occurrence (by
document id, text hash, line) are joined into runs, and those lines are deleted with the blank lines between them. First
occurrences stay. Shorter repeats stay.

Defined cases: null texts stay null and empty ones empty; very long texts are worked on one at a time; equal rows that
share an id are one document and get equal results; null ids come first; documents of which nothing is left keep an
empty text (``n_left`` is 0); lines compare exactly; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, table, tidy

MIN_WORDS = 50
_NULL_ID = -(1 << 62)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, row, line number) of the non-blank lines of a run."""
    cut = np.flatnonzero(data == 10)
    row_of_cut = np.searchsorted(off, cut, "right") - 1
    per_row = np.bincount(row_of_cut, minlength=len(off) - 1)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    # a row that ends with a line feed and the next row's start are two lines that begin at one place
    first = np.concatenate([[0], np.cumsum(per_row + 1)])
    row = np.repeat(np.arange(len(off) - 1), per_row + 1)
    number = np.arange(len(begin)) - first[row]
    end = np.append(begin[1:] - 1, 0)
    last = first[1:] - 1
    end[last] = off[1:]
    word_begin, _, _ = B.words(data, off, B.NOT_SPACE)
    words = np.searchsorted(word_begin, np.maximum(end, begin)) - np.searchsorted(word_begin, begin)
    full = words > 0
    return B.span_hashes(data, begin[full], end[full]), words[full], row[full], number[full]


def windows_of(h: np.ndarray, words: np.ndarray, row: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, content hash, selected line) of every window in order; lines by their place in the arrays."""
    total = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(len(h))
    last = np.searchsorted(total[1:], total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    start, last = np.concatenate([line, start]), np.concatenate([last, line])
    ok = (start >= 0) & (last < len(h))
    ok[ok] = row[last[ok]] == row[start[ok]]
    # none lies within another but with a common end, so that sorted by start they are sorted by last line too
    both = np.unique(start[ok] * (len(h) + 1) + last[ok])
    start, last = both // (len(h) + 1), both % (len(h) + 1)
    up, down = B._power(len(h) + 1)
    poly = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    content = B.mix((poly[last + 1] - poly[start]) * down[start] + (last - start).astype(np.uint64))
    best, k, left = start.copy(), 1, np.flatnonzero(last > start)
    while len(left):
        at = start[left] + k
        less = h[at] <= h[best[left]]  # the rightmost of equal minima
        best[left[less]] = at[less]
        k += 1
        left = left[last[left] - start[left] >= k]
    return start, last, content, best


def _fingerprints(min_words: int):
    """(d, th, text) to one row per selected line: its hash, and the windows that select it."""

    def go(batches):
        for batch in batches:
            data, off = B.buffers(batch.column(2))
            d, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in B.runs(off):
                h, words, row, number = lines_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                start, last, content, best = windows_of(h, words, row, min_words)
                if not len(start):
                    continue
                # windows that select one line are neighbours, for minima move to the right
                first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
                ends = pa.array(np.append(first, len(start)).astype(np.int32))
                at = best[first]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number[start].astype(np.int32), number[last].astype(np.int32), content.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(d[i:j][row[at]]), pa.array(th[i:j][row[at]]), *lists], names=["f", "d", "th", "s", "e", "w"])

    return go


def delete_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """(text without the lines of the spans, lines deleted, words deleted, non-blank lines left)."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for a, z in spans:
        gone[a : z + 1] = True
    kept = [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
    count = [len(_WORD.findall(x)) for x, g in zip(lines, gone.tolist(), strict=True) if g]
    return "\n".join(kept), len(count), sum(count), sum(1 for x in kept if _WORD.search(x))


OUT = "n_removed long, words_removed long, n_left long"


def _apply(text_at: int):
    def go(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            texts = batch.column(text_at)
            out, stats = texts, [(0, 0, -1)] * len(texts)
            hit = [i for i, v in enumerate(spans.is_valid().to_pylist()) if v]
            if hit:
                out, stats = texts.to_pylist(), list(stats)
                for i in hit:
                    t, *s = delete_lines(out[i], [(x["s"], x["e"]) for x in spans[i].as_py()])
                    out[i], stats[i] = t, tuple(s)
                out = pa.array(out, texts.type)
            cols = [out if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([s[k] for s in stats], pa.int64()) for k in range(3))], names=[*batch.schema.names[:-1], "n_removed", "words_removed", "n_left"])

    return go


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shortened texts, and n_removed (lines), words_removed, n_left (non-blank lines; -1: text untouched)."""
    names = docs.columns
    inner = [f"_k{i}" for i in range(len(names))]
    own = docs.select(*(F.col(f"`{n}`").alias(a) for n, a in zip(names, inner, strict=True)))
    text_at = names.index(text)
    key, body = F.coalesce(F.col(inner[names.index(doc_id)]).cast("long"), F.lit(_NULL_ID)), F.col(inner[text_at])
    named = own.filter(body.isNotNull()).select(key.alias("d"), F.xxhash64(body).alias("th"), body.alias("t"))
    prints = materialise(named.mapInArrow(tidy(_fingerprints(min_words)), "f long, d long, th long, s array<int>, e array<int>, w array<long>"), "prints")
    again = materialise(prints.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("f").alias("_f")), "again")
    places = prints.join(again, F.col("f") == F.col("_f")).select("d", "th", F.explode(F.arrays_zip("s", "e", "w")).alias("x")).select("d", "th", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.w").alias("w"))
    places = materialise(places, "places")
    place = F.struct("d", "th", "s")
    firsts = materialise(places.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("w").alias("_w"), "first"), "firsts")
    later = places.join(firsts, F.col("w") == F.col("_w")).filter(place > F.col("first"))
    spans = later.groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = materialise(spans.withColumnsRenamed({"d": "_d", "th": "_th"}), "spans")
    # one plan at every size: the spans grow with the documents
    both = own.withColumn("_key", key).withColumn("_h", F.xxhash64(body)).join(spans.hint("merge"), (F.col("_key") == F.col("_d")) & (F.col("_h") == F.col("_th")) & body.isNotNull(), "left")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), OUT])
    done = both.select(*inner, "spans").mapInArrow(tidy(_apply(text_at)), shape)
    return done.select(*(F.col(a).alias(n) for n, a in zip(names, inner, strict=True)), "n_removed", "words_removed", "n_left")


def op6_query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("text").alias("kept_text"), "n_removed", "words_removed")


#: Repeated runs of 50 or more words are covered by the least windows from a line on and, mirrored, up to a line.
OP6_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, i, l[i] AS line, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS n FROM raw, unnest(range(1, len(l) + 1)) AS r(i)),
full_ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM ln WHERE n > 0),
per AS (SELECT doc_id, list(line ORDER BY k) AS lines, list(i ORDER BY k) AS nos, list(c ORDER BY k) AS cs FROM full_ln GROUP BY doc_id),
ends AS (
  SELECT f.doc_id, f.k AS a, len(list_filter(per.cs, lambda x: x < f.c - f.n + 50)) + 1 AS z FROM full_ln f JOIN per USING (doc_id)
  UNION SELECT f.doc_id, len(list_filter(per.cs, lambda x: x <= f.c - 50)) + 1 AS a, f.k AS z FROM full_ln f JOIN per USING (doc_id) WHERE f.c >= 50
),
win AS (SELECT doc_id, nos[a] AS s, nos[z] AS e, array_to_string(lines[a:z], chr(10)) AS content FROM ends JOIN per USING (doc_id) WHERE z <= len(cs)),
later AS (SELECT doc_id, s, e FROM (SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, s) AS o FROM win) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later),
kept AS (
  SELECT ln.doc_id, string_agg(line, chr(10) ORDER BY ln.i) FILTER (WHERE gone.i IS NULL) AS kept_text,
         count(gone.i) AS n_removed, coalesce(sum(n) FILTER (WHERE gone.i IS NOT NULL), 0) AS words_removed
  FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.i = ln.i GROUP BY ln.doc_id
)
SELECT raw.doc_id, CASE WHEN raw.text IS NULL THEN NULL ELSE coalesce(kept_text, '') END AS kept_text,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(words_removed, 0)::BIGINT AS words_removed
FROM raw LEFT JOIN kept USING (doc_id)
"""
