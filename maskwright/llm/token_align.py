"""Alignment of two tokenizers' tokens by merge-path partitioning.

Every text is tokenized by A (byte-level pieces) and by B (sentence pieces); each token covers a range of the text's
bytes. The two sorted lists of token ends of a run of texts are merged: where the merge stands lie one token of A and one
of B, and each step, to the next end of either, is one link of the two. Diagonals of the merge ``PIECE`` steps apart are
found by binary search, all at once; the pieces between them are equal work and independent of each other, and advance in
lock step. Steps at which both tokens end close a group; groups that run over the border of two pieces are stitched by
numbering the closing steps over all pieces.

The corpus-wide count of an id pair needs a second look at every document: documents are dealt in ``block``s of about
``BLOCK_BYTES``, a block gives each of its distinct pairs with a count to the sum over all blocks, and gets the sums of
just these pairs back. Nothing is broadcast but the tokenizers' paths.

Defined cases: texts that are null or empty, or whose tokens do not spell the text again under A or B, have no tokens:
zeros and an empty digest; very long texts make a block of their own; repeated rows are counted again; ties for the
highest count all count as best; null ids pass through; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, table, tidy
from maskwright.llm.packing import Words

#: Steps of the merge in a piece.
PIECE = 64
#: Bytes of text aligned at once, and of the texts whose pairs are summed together before they are shuffled.
RUN_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: How B writes a blank.
BLANK = "▁"

_state: dict = {}
_SHIFT = np.int64(32)


class SentencePieces(Words):
    """Ids of texts by a sentence-piece model, each distinct word tokenized once while it is remembered.

    A word begins at a blank after another character. No piece of the model has a blank behind another character
    (``__init__`` makes sure), so that no piece can reach over such a place and words are tokenized alike alone. Texts that
    hold the model's sign for a blank themselves are tokenized in one piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.can_cut = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.special, self.blank = [BLANK.encode()], self.model.piece_to_id(BLANK)
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        #: The bytes that each id stands for.
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]

    def begins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        new = np.zeros(len(data), bool)
        if self.can_cut:
            new[1:] = (data[1:] == 32) & (data[:-1] != 32)
        new[off[:-1][off[:-1] < len(data)]] = True
        return np.flatnonzero(new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts begin with a blank, which the model adds by itself, but not to nothing."""
        return [np.asarray(x if t != " " else [self.blank], np.uint32) for t, x in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1), strict=True)]

    def fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, begin, size, used = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        for a in range(0, len(pieces), 4096):
            for i, x in enumerate(self.encode([p.decode() for p in pieces[a : a + 4096]]), a):
                begin[i], size[i] = used, len(x)
                flat.append(x)
                used += len(x)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), begin, size


class Bytes(Words):
    """Ids of texts by a byte-level tokenizer, to which all strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, special_as_text=True)
        # the printable characters of byte-level alphabets: bytes that print as they are, the rest from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()


class Spelled:
    """A tokenizer with the bytes of its ids in flat arrays."""

    def __init__(self, words: Words):
        self.words = words
        self.size = np.array([len(b) for b in words.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(words.bytes), np.uint8)

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of a run of texts, where each text's begin, which texts they spell)."""
        ids, first = self.words.ids(data, off)
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        same = np.diff(ends[first]) == np.diff(off)
        if same.all():
            spelled = self.flat[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])]
            wrong = np.flatnonzero(spelled != data)
            same[np.searchsorted(off, wrong, "right") - 1] = False
        else:
            for r in np.flatnonzero(same).tolist():
                own = b"".join([self.words.bytes[i] for i in ids[first[r] : first[r + 1]].tolist()])
                same[r] = own == data[off[r] : off[r + 1]].tobytes()
        return ids, first, same


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of two partitions of one range, given by their ascending ends: (number in a, number in b, whether both end).

    Both lists end at the same place. A step of the merge passes one end; two equal ends are two steps, a's first, of which
    the second makes no link.
    """
    n, m = len(a), len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    # where each diagonal crosses the merge: of the first d ends, i are a's (equal ends: a's come first)
    d = np.arange(0, n + m, piece)
    lo, hi = np.maximum(d - m, 0), np.minimum(d, n)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        more = open_ & (a[np.minimum(mid, n - 1)] <= b[np.clip(d - mid - 1, 0, m - 1)])
        lo, hi = np.where(more, mid + 1, lo), np.where(open_ & ~more, mid, hi)
    i, j = lo, d - lo
    steps = np.minimum(piece, n + m - d)
    # all pieces advance together, one end a step; a finished piece stands still
    far = np.int64(np.iinfo(np.int64).max)
    ends_a, ends_b, passed = np.append(a, far), np.append(b, far), np.concatenate([[0], a])
    width = int(steps.max())
    at_a, at_b = np.empty((len(d), width), np.int64), np.empty((len(d), width), np.int64)
    link, both = np.zeros((len(d), width), bool), np.zeros((len(d), width), bool)
    for s in range(width):
        x, y, go = ends_a[i], ends_b[j], s < steps
        takes_a = x <= y
        at_a[:, s], at_b[:, s] = i, j
        both[:, s] = x == y
        link[:, s] = go & (takes_a | (y != passed[i]))  # an end of b that a has as well was linked a step before
        i, j = i + (takes_a & go), j + (~takes_a & go)
    return at_a[link], at_b[link], both[link]


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Five decimal digits of every number below 100,000, right-aligned, and how many it needs."""
    v = np.arange(100_000)[:, None]
    powers = 10 ** np.arange(4, -1, -1)
    return (v // powers % 10 + 48).astype(np.uint8), np.maximum((v >= powers).sum(1), 1)


def write_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts ``a1,a2|b1;a3|b2`` of all documents: (bytes, offsets). Groups are numbered through; ids are below 100,000."""
    digits, need = _decimals()
    ids = np.concatenate([ids_a, ids_b]).astype(np.int64)
    group = np.concatenate([group_a, group_b])
    order = np.argsort(group * 2 + np.repeat([0, 1], [len(ids_a), len(ids_b)]), kind="stable")
    ids, group, of_b = ids[order], group[order], order >= len(ids_a)
    n = len(ids)
    new_group = np.ones(n, bool)
    new_group[1:] = group[1:] != group[:-1]
    new_side = np.zeros(n, bool)
    new_side[1:] = of_b[1:] & ~of_b[:-1]
    doc = doc_of_group[group]
    new_doc = np.ones(n, bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    sign = np.where(new_side, 124, np.where(new_group, 59, 44)).astype(np.uint8)  # | ; ,
    chars = np.empty((n, 6), np.uint8)
    chars[:, 0], chars[:, 1:] = sign, digits[ids]
    keep = np.arange(6) >= (6 - need[ids])[:, None]
    keep[:, 0] = ~new_doc
    size = need[ids] + ~new_doc
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, size, n_docs).astype(np.int64))])
    return chars[keep], ends


def align(data: np.ndarray, off: np.ndarray, a: Spelled, b: Spelled) -> dict:
    """All of one run of texts (each with its leading blank): figures per text, digest texts, and links as id pairs."""
    ids_a, first_a, same_a = a.tokens(data, off)
    ids_b, first_b, same_b = b.tokens(data, off)
    good = same_a & same_b & (np.diff(off) > 1)  # a blank alone is an empty text
    doc_a, doc_b = np.repeat(good, np.diff(first_a)), np.repeat(good, np.diff(first_b))
    row_a, row_b = np.repeat(np.arange(len(good)), np.diff(first_a))[doc_a], np.repeat(np.arange(len(good)), np.diff(first_b))[doc_b]
    ids_a, ids_b = ids_a[doc_a].astype(np.int64), ids_b[doc_b].astype(np.int64)
    ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])  # of the good texts, one after the other
    i, j, both = merge_path(ends_a, ends_b)
    rows = len(good)
    count = lambda x: np.bincount(x, minlength=rows)
    # a closing step is the last one of its group: tokens belong to the group of the first step that closes at or after them
    closed_a, closed_b = i[both], j[both]
    group_a, group_b = np.searchsorted(closed_a, np.arange(len(ids_a))), np.searchsorted(closed_b, np.arange(len(ids_b)))
    doc_of_group = row_a[closed_a]
    chars, ends = write_groups(ids_a, ids_b, group_a, group_b, doc_of_group, rows)
    return {
        "n_a": count(row_a), "n_b": count(row_b), "n_groups": count(doc_of_group), "n_links": count(row_a[i]),
        "chars": chars, "ends": ends, "row": row_a[i], "pair": ids_a[i] << _SHIFT | ids_b[j],
    }


def _tokenizers(path_a: str, path_b: str) -> tuple[Spelled, Spelled]:
    if _state.get("paths") != (path_a, path_b):
        _state.update(paths=(path_a, path_b), both=(Spelled(Bytes(path_a)), Spelled(SentencePieces(path_b))))
    return _state["both"]


def _with_blank(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(pa.scalar("", texts.type), texts.fill_null(""), pa.scalar(" ", texts.type))


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "block long, doc_id {id}, " + ", ".join(f"{n} long" for n in _FIGURES) + ", groups string, pair binary, times binary, pairs binary, counts binary"


def _align_batches(path_a: str, path_b: str, key_type):
    """(doc_id, text) to one row per document with its distinct pairs by their number in the block, and one row (without figures) per block with these."""

    def go(batches):
        a, b = _tokenizers(path_a, path_b)
        base, blocks = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0  # (ids, figures, groups, row and pair of links) of the runs of a block

        def flush():
            nonlocal blocks, size
            links = np.concatenate([x["pair"] for x in held]) if held else np.zeros(0, np.int64)
            pairs, of, counts = np.unique(links, return_inverse=True, return_counts=True)
            block, used = base + blocks, 0
            for x in held:
                n = len(x["ids"])
                of_run = of[used : used + len(x["pair"])]
                used += len(x["pair"])
                # a document's distinct pairs: ascending numbers as differences, and how often each
                key, times = np.unique(x["row"] * np.int64(len(pairs) + 1) + of_run, return_counts=True)
                row, number = key // (len(pairs) + 1), key % (len(pairs) + 1)
                step = np.diff(number, prepend=0)
                first = np.searchsorted(row, np.arange(n + 1))
                begins = first[:-1][first[:-1] < first[1:]]
                step[begins] = number[begins]
                step, times = step.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                cut = lambda raw: pa.array([raw[4 * s : 4 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(x["ids"], key_type), *(pa.array(x[f].astype(np.int64)) for f in _FIGURES), x["groups"], cut(step), cut(times), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names=["block", "doc_id", *_FIGURES, "groups", "pair", "times", "pairs", "counts"],
                )
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.nulls(1, key_type), *(pa.nulls(1, pa.int64()) for _ in _FIGURES), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())],
                    names=["block", "doc_id", *_FIGURES, "groups", "pair", "times", "pairs", "counts"],
                )
            held.clear()
            blocks, size = blocks + 1, 0

        for batch in batches:
            data, off = B.buffers(_with_blank(batch.column(1)))
            for s, e in B.runs(off, RUN_BYTES):
                x = align(data[off[s] : off[e]], off[s : e + 1] - off[s], a, b)
                groups = pa.LargeStringArray.from_buffers(e - s, pa.py_buffer(x["ends"].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x.pop("chars")))).cast(pa.string())
                held.append(x | {"ids": batch.column(0)[s:e].to_pylist(), "groups": groups})
                size += int(off[e] - off[s])
                if size >= BLOCK_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return go


def _unpack_batches(batches):
    """Blocks' packed pairs to rows (block, place in the block, pair, count)."""
    for batch in batches:
        for block, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            p, c = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            for s in range(0, len(p), 65536):
                part = p[s : s + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(s, s + len(part))), pa.array(part), pa.array(c[s : s + 65536])], names=["block", "place", "pair", "n"])


def _score(key: tuple, docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block with the sums of the block's pairs."""
    total = np.zeros(len(sums), np.int64)
    best = np.zeros(len(sums), np.int64)
    total[sums["place"].to_numpy()], best[sums["place"].to_numpy()] = sums["total"].to_numpy(), sums["best"].to_numpy()
    n_best, count_sum = [], []
    for step, times in zip(docs["pair"], docs["times"], strict=True):
        at, n = np.cumsum(np.frombuffer(step, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int((n * best[at]).sum()))
        count_sum.append(int((n * total[at]).sum()))
    return docs[["doc_id", *_FIGURES]].assign(n_best=n_best, count_sum=count_sum, groups_sha256=docs["groups_sha256"])


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the groups themselves come from
    ``aligned_texts``. Pairs: id_a, id_b, total (links that hold them), best (1: highest of id_b).
    """
    kind = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"].dataType.simpleString()
    raw = aligned_texts(docs, path_a, path_b, doc_id, text, with_pairs=True)
    hashed = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    written = materialise(raw.withColumn("groups_sha256", hashed).drop("groups"), "aligned")
    packed = written.filter("pairs is not null").select("block", "pairs", "counts")
    parts = materialise(packed.mapInArrow(_unpack_batches, "block long, place long, pair long, n long"), "pairs")
    sums = parts.groupBy("pair").agg(F.sum("n").alias("total"))
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    sums = materialise(sums.select("pair", low.alias("id_b"), "total"), "sums")
    most = materialise(sums.groupBy(F.col("id_b").alias("_b")).agg(F.max("total").alias("most")), "most")
    sums = materialise(sums.join(most, F.col("id_b") == F.col("_b")).select(F.col("pair").alias("_p"), "id_b", "total", (F.col("total") == F.col("most")).cast("long").alias("best")), "best")
    told = parts.join(sums, F.col("pair") == F.col("_p")).select("block", "place", "total", "best")
    own = written.filter("pairs is null").drop("pairs", "counts")
    shape = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in [*_FIGURES, "n_best", "count_sum"]) + ", groups_sha256 string"
    found = own.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_score, shape)
    return found, sums.select(F.shiftright("_p", 32).alias("id_a"), "id_b", "total", "best")


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_pairs: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links and groups (``a1,a2|b1;a3|b2``, empty without tokens)."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["doc_id"].dataType
    raw = own.mapInArrow(tidy(_align_batches(path_a, path_b, to_arrow_type(kind))), _ALIGNED.format(id=kind.simpleString()))
    return raw if with_pairs else raw.filter("pairs is null").select("doc_id", *_FIGURES, "groups")


def op13_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
