"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased and reduced to letters and single blanks. Per language, continuation counts of character n-grams up
to ``ORDER`` are gathered by a Spark aggregation over a bounded sample of labelled text: rows are cut into pieces of
``PIECE_CHARS``, and of each language's distinct pieces about ``SAMPLE_CHARS`` characters are chosen by a hash (the only
bound), so that neither one long document nor a group of copies can be all or nothing of a language. The interpolated probabilities of all n-grams of the highest
order, and the back-off weights and probabilities of the lower ones, are kept for all languages in one sorted array of
64-bit n-gram hashes per order. A text gets the language of the lowest cross-entropy per character.

Rejection is calibrated on a tenth of the chosen pieces, which is not learned from (languages of fewer than
``FEW_PIECES`` pieces learn from and are measured on all): a text is rejected when its cross-entropy exceeds its language's mean by
``REJECT_NATS`` plus ``REJECT_Z`` standard errors for its length, or when it has no letter.

Defined cases: null or empty texts and texts without letters are ``und`` with score 0 and rejected; very long texts are
scored whole, in runs; ties take the language first in alphabetical order; repeated rows get equal results; without
labelled rows every text is ``und``; null labels are not learned; other columns pass through ``keep_identified``.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import fold, table, tidy

ORDER, DISCOUNT = 4, 0.75
#: Characters of labelled text that are learned from at most, per language (about).
SAMPLE_CHARS = 1_500_000
#: Characters of a piece that is chosen as a whole, and pieces under which a language keeps none back.
PIECE_CHARS, FEW_PIECES = 2000, 20
#: Characters scored at once.
RUN_CHARS = 1 << 18
#: Rejection: nats a character over the language's mean, and standard errors.
REJECT_NATS, REJECT_Z = 1.8, 6.0
#: Sharpness of the score per character of evidence, and the characters that count at most.
SHARP, EVIDENCE = 1.0, 60

_state: dict = {}


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    if "fold" not in _state:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha() or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                t[c] = ord(low[0])
        _state["fold"] = t
    return _state["fold"]


def _mark_table() -> np.ndarray:
    """Which code points are combining marks: they belong to words but are no letters."""
    if "marks" not in _state:
        _state["marks"] = np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])
    return _state["marks"]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, one after the other, offsets): each is a blank, then words each followed by a blank."""
    raw = np.frombuffer("".join([f"\n{t}\n" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.array([0] + [len(t) + 2 for t in texts]))
    x = _fold_table()[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[ends[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], before[ends]


def _hash(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each position from n - 1 on."""
    h = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + x[i : len(x) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return B.mix(h)


def grams(x: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within rows, and the position of each one's last code point."""
    if len(x) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.arange(n - 1, len(x))
    row_start = np.repeat(off[:-1], np.diff(off))[last] if len(off) > 1 else last
    ok = last - row_start >= n - 1
    return _hash(x, n)[ok], last[ok]


def _count_batches(order: int):
    """(lang, text) to counts of (lang, order, gram, its context, its suffix)."""

    def go(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                x, off = normalise([t for t, la in zip(texts, langs, strict=True) if la == lang])
                h, last = grams(x, off, order)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                pos = last[at]
                code = np.stack([x[pos - order + 1 + i] for i in range(order)], 1).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(u)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"]
                )

    return go


class Model:
    """Kneser-Ney models of all languages over one set of n-grams.

    ``keys[k]``: sorted hashes of the k-grams; ``logp[k]``: log probability of the last character after the others, per
    language; ``back[k]``: log weight of the shorter context after this k-gram as context (k < ORDER).
    """

    def __init__(self, counts: dict[str, dict[bytes, int]], order: int = ORDER):
        rows = [(i, g, n) for i, lang in enumerate(sorted(counts)) for g, n in counts[lang].items()]
        codes = np.frombuffer(b"".join(g for _, g, _ in rows), np.uint32).reshape(len(rows), order)
        self._build(sorted(counts), np.array([r[0] for r in rows]), codes, np.array([r[2] for r in rows]), order)

    @classmethod
    def of(cls, langs: list[str], lang: np.ndarray, codes: np.ndarray, n: np.ndarray, order: int = ORDER) -> Model:
        """From rows of (number of the language in ``langs``, code points of an n-gram, count)."""
        model = cls.__new__(cls)
        model._build(langs, lang, codes, n, order)
        return model

    def _build(self, langs: list[str], lang: np.ndarray, codes: np.ndarray, n: np.ndarray, order: int) -> None:
        self.langs = langs
        self.keys, self.logp, self.back = [], [], []
        self.mean, self.sd = np.zeros(len(self.langs)), np.ones(len(self.langs))
        codes, of = np.unique(codes, axis=0, return_inverse=True)
        table = np.zeros((len(langs), len(codes)))  # languages x grams
        table[lang, of.ravel()] = n
        n = table
        # counts of each order: the highest is real, lower ones count distinct left extensions
        level = {order: (codes, n)}
        for k in range(order - 1, 0, -1):
            up, c = level[k + 1]
            cut, of = np.unique(up[:, 1:], axis=0, return_inverse=True)
            level[k] = (cut, np.stack([np.bincount(of.ravel(), (row > 0).astype(float), len(cut)) for row in c]))
        alphabet = len(level[1][0]) + 1
        prob = {}
        for k in range(1, order + 1):
            g, c = level[k]
            if k == 1:
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                p = np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1) + np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1) / alphabet
                self.floor = np.log(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1) / alphabet)[:, 0]
                back = None
            else:
                ctx, of = np.unique(g[:, :-1], axis=0, return_inverse=True)
                of = of.ravel()
                total = np.stack([np.bincount(of, row, len(ctx)) for row in c])
                kinds = np.stack([np.bincount(of, row > 0, len(ctx)) for row in c])
                weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                # the lower level holds the distinct suffixes of this one, in order
                _, suffix = np.unique(g[:, 1:], axis=0, return_inverse=True)
                suffix = suffix.ravel()
                p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[:, of], 1) + weight[:, of] * prob[k - 1][:, suffix]
                back = (ctx, np.log(weight))
            prob[k] = p
            self.keys.append(None)
            self._store(k, g, np.log(p), back, order)
        del level

    def _store(self, k, g, logp, back, order):
        h = _hash_rows(g)
        o = np.argsort(h)
        self.keys[k - 1] = h[o]
        self.logp.append(np.ascontiguousarray(logp[:, o].T.astype(np.float32)))
        if back is not None:
            hb = _hash_rows(back[0])
            ob = np.argsort(hb)
            self.back.append((hb[ob], np.ascontiguousarray(back[1][:, ob].T.astype(np.float32))))

    def score(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood per row and language, characters scored per row)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        order = len(self.keys)
        for a, z in _row_runs(off):
            xs, at = x[off[a] : off[z]], off[a : z + 1] - off[a]
            n = len(xs)
            if not n:
                continue
            start = np.repeat(at[:-1], np.diff(at))
            idx = np.arange(n)
            value = np.zeros((n, len(self.langs)), np.float32)
            todo = idx[idx > start]  # the leading blank is given
            for k in range(order, 0, -1):
                h = _hash(xs, k) if n >= k else np.zeros(0, np.uint64)
                have = todo[todo - start[todo] >= k - 1]
                short = todo[todo - start[todo] < k - 1]
                key = h[have - k + 1]
                place = np.minimum(np.searchsorted(self.keys[k - 1], key), len(self.keys[k - 1]) - 1)
                hit = self.keys[k - 1][place] == key
                value[have[hit]] += self.logp[k - 1][place[hit]]
                miss = have[~hit]
                if k > 1 and len(miss):
                    bh, bw = self.back[k - 2]
                    ck = _hash(xs, k - 1)[miss - k + 1]
                    cp = np.minimum(np.searchsorted(bh, ck), len(bh) - 1)
                    found = bh[cp] == ck
                    value[miss[found]] += bw[cp[found]]
                if k == 1:
                    value[miss] += self.floor.astype(np.float32)
                todo = np.concatenate([short, miss]) if len(short) else miss
            total = np.add.reduceat(value, np.minimum(at[:-1], n - 1), axis=0, dtype=np.float64)
            total[np.diff(at) == 0] = 0
            out[a:z] = total
        return out, np.maximum(np.diff(off) - 1, 0)


def _hash_rows(g: np.ndarray) -> np.ndarray:
    h = np.zeros(len(g), np.uint64)
    for i in range(g.shape[1]):
        h = h * np.uint64(0x100000001B3) + g[:, i].astype(np.uint64) + np.uint64(1)
    return B.mix(h)


def _row_runs(off: np.ndarray):
    return B.runs(off, RUN_CHARS)


def judge(model: Model, texts: list[str]) -> list[tuple[str, float, bool, float]]:
    """(language, score, rejected, cross-entropy) of each text."""
    x, off = normalise(texts)
    like, n = model.score(x, off)
    found = np.concatenate([[0], np.cumsum((x != 32) & ~_mark_table()[x])])
    letters = found[off[1:]] > found[off[:-1]]
    h = -like / np.maximum(n, 1)[:, None]
    best = h.argmin(1) if h.shape[1] else np.zeros(len(texts), int)
    out = []
    for i in range(len(texts)):
        if not letters[i] or not h.shape[1]:
            out.append(("und", 0.0, True, 0.0))
            continue
        b = int(best[i])
        e = np.exp(-(h[i] - h[i, b]) * min(n[i], EVIDENCE) * SHARP)
        limit = model.mean[b] + REJECT_NATS + REJECT_Z * model.sd[b] / np.sqrt(n[i])
        out.append((model.langs[b], float(1 / e.sum()), bool(h[i, b] > limit), float(h[i, b])))
    return out


def _text_chunks(batch, column: int):
    texts = [t or "" for t in batch.column(column).to_pylist()]
    a = 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and (z == a or size + len(texts[z]) < RUN_CHARS):
            size += len(texts[z])
            z += 1
        yield texts[a:z]
        a = z


def _judge_batches(model):
    def go(batches):
        known = model.value
        for batch in batches:
            rows = [r for chunk in _text_chunks(batch, batch.num_columns - 1) for r in judge(known, chunk)]
            own = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected", "entropy"])

    return go


OUT = "lang_pred string, score double, rejected boolean, entropy double"


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Models of the labels of ``labelled``, from at most about ``sample_chars`` characters of each, chosen by pieces."""
    spark = labelled.sparkSession
    own = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    pieces = own.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))).alias("text")).withColumn("h", F.xxhash64("text"))
    each = pieces.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    sizes = {r["lang"]: (r["n"], r["k"]) for r in each.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    if not sizes:
        return Model({"und": {np.full(order, 32, np.uint32).tobytes(): 1}}, order)
    by_lang = lambda f, kind: F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(f(*v)).cast(kind))]), F.col("lang"))
    share, few = by_lang(lambda n, _: min(1.0, sample_chars / max(n, 1)), "double"), by_lang(lambda _, k: k < FEW_PIECES, "boolean")
    u = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    sample = pieces.withColumn("u", u / share).filter("u < 1").withColumn("few", few).dropDuplicates(["lang", "h"])
    rows = sample.filter("few or u < 0.9").select("lang", "text").mapInArrow(tidy(_count_batches(order)), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return Model({"und": {np.full(order, 32, np.uint32).tobytes(): 1}}, order)
    lang_of = rows.column("lang").combine_chunks().dictionary_encode()
    names = lang_of.dictionary.to_pylist()
    langs = sorted(names)
    codes = np.frombuffer(b"".join(rows.column("gram").to_pylist()), np.uint32).reshape(-1, order)
    model = Model.of(langs, np.array([langs.index(x) for x in names])[lang_of.indices.to_numpy()], codes, rows.column("n").to_numpy(), order)
    # calibration: mean and spread of the cross-entropy of each language's own pieces that were kept back
    kept_back = sample.filter("few or u >= 0.9").select("lang", "text")
    seen = kept_back.mapInArrow(tidy(_judge_batches(spark.sparkContext.broadcast(model))), "lang string, " + OUT).filter("lang = lang_pred")
    for r in seen.groupBy("lang").agg(F.avg("entropy").alias("m"), F.stddev("entropy").alias("s")).collect():
        i = model.langs.index(r["lang"])
        model.mean[i], model.sd[i] = r["m"], max(r["s"] or 0, 0.3)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, rejected and entropy of each row's whole text."""
    inner = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keep, inner, strict=True)), F.col(f"`{text}`").alias("_text"))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]), OUT])
    found = own.mapInArrow(tidy(_judge_batches(docs.sparkSession.sparkContext.broadcast(model))), shape)
    return found.select(*(F.col(a).alias(k) for a, k in zip(inner, keep, strict=True)), "lang_pred", "score", "rejected", "entropy")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rejected rows; all columns as they were."""
    plain = [f"_c{i}" for i in range(len(docs.columns))]  # so that no name clashes with the results
    found = identify(docs.toDF(*plain), model, plain[docs.columns.index(text)], tuple(plain))
    return found.filter("not rejected").select(*plain).toDF(*docs.columns)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    out = identify(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
