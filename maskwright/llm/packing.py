"""Best-fit-decreasing packing of tokenized documents into fixed windows.

Overlong documents are first cut into full windows. What remains of each document is placed, longest first, into the
open window with the least sufficient room, found by a segment tree over remaining capacities. Each task packs its own
documents in bounded groups, so packing needs no shuffle; sequence ids hold the partition number in their upper bits.

A group's windows that end up less than three quarters full are cut at the binary digits of their length: sequences
whose length is a power of two are not padded.

Defined cases: null or empty text is one end token; very long texts are cut into full windows; equal lengths are placed
in row order; repeated rows are packed again; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import table, tidy

WINDOW, END_ID = 2048, 1
#: Remainders that are packed together at most; bounds a task's memory.
GROUP = 50_000
#: Bytes of text that are tokenized at once, and of finished ids that a group holds at most.
CHUNK_BYTES, GROUP_BYTES = 1 << 20, 12 << 20
#: Bytes that are hashed at once: eight bytes for each fit a core's cache.
HASH_BYTES = 1 << 18
#: Rows of a batch that carries ids: 2 MB at most.
IDS_ROWS = 256
#: Pieces that are tokenized in one text, and texts that are tokenized at once: the tokenizer is quicker on short texts.
JOINT_PIECES, TEXTS = 128, 64
#: Pieces whose ids a worker keeps, and the bytes of one at most: longer ones are tokenized each time.
CACHE_PIECES, PIECE_BYTES = 300_000, 64

_state: dict = {}

#: Added to the uses of a piece that the chunk at hand needs, when others are forgotten.
_IN_USE = 1 << 40

#: Pieces that are a blank or a line end and a word.
_JOINT = re.compile(r"[ \n]\S+")


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Begins of the pieces of one run of texts: places where the byte-level pre-tokenizer begins a new word in any case.

    Those are white space after a byte that is surely none, and ASCII punctuation right after an ASCII letter. What comes
    after a run of white space is not cut from it, for the run's last blank may belong to the next word.
    """
    new = np.zeros(len(data), bool)
    new[off[:-1][off[:-1] < len(data)]] = True
    before, now = data[:-1], data[1:]
    # the last byte of a longer character is taken for white space if any Unicode white space could end like this
    dark = (before > 32) & (before < 127)
    wide = before >= 128
    two = np.zeros(len(before), np.uint8)
    two[1:] = data[:-2]
    three = np.zeros(len(before), np.uint8)
    three[2:] = data[:-3]
    dark |= wide & ~((two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3))
    blank = (now == 32) | ((now >= 9) & (now <= 13))
    new[1:] |= (blank & dark) | ((now > 32) & (now < 127) & ~_letter(now) & ~((now >= 48) & (now <= 57)) & _letter(before))
    return np.flatnonzero(new)


def _letter(data: np.ndarray) -> np.ndarray:
    low = data | np.uint8(32)
    return (low >= 97) & (low <= 122)


class Words:
    """Ids of texts by a byte-level tokenizer, each distinct piece (see ``cuts``) tokenized once while it is remembered.

    Pieces are known by a 64-bit hash and their ids kept in one flat array; the least used half is forgotten when
    ``CACHE_PIECES`` are held. Strings of special tokens get the ids of those tokens, as the tokenizer has it by default,
    and a text that holds one is tokenized in one piece; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        # a task has one core; threads of each worker would only wait for it, each with a heap of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin with a blank or a line end (byte-level alphabets write them as U+0120 and U+010A).
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 3), np.int64)  # begin and number of ids, uses
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def begins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return cuts(data, off)

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begins of the pieces of one run of texts, which of them are whole texts with special tokens)."""
        begin, raw, rows = self.begins(data, off), data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(off, at, "right")) - 1)
                at = raw.find(token, at + 1)
        if not rows:
            return begin, np.zeros(len(begin), bool)
        whole = np.zeros(len(off), bool)
        whole[list(rows)] = True
        whole = whole[np.searchsorted(off, begin, "right") - 1]
        stay = ~whole | np.isin(begin, off)
        return begin[stay], whole[stay]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        runs = (texts[a : a + TEXTS] for a in range(0, len(texts), TEXTS))
        return [np.asarray(e.ids, np.uint32) for run in runs for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]

    def fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of pieces, each tokenized alone; where each piece's begin there; how many they are)."""
        words = [p.decode() for p in pieces]
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        joint = np.array([_JOINT.fullmatch(p) is not None for p in words], bool)
        together, alone = np.flatnonzero(joint), np.flatnonzero(~joint)
        # pieces that are a blank or a line end and a word in one text: each begins with the only token that has its blank
        same = [words[i] for i in together.tolist()]
        texts = ["".join(same[a : a + JOINT_PIECES]) for a in range(0, len(same), JOINT_PIECES)]
        flat = np.concatenate([np.zeros(0, np.uint32), *self.encode(texts)])
        first = np.flatnonzero(self.blank[flat])
        begin[together], size[together] = first, np.diff(np.append(first, len(flat)))
        apart = self.encode([words[i] for i in alone.tolist()])
        size[alone] = [len(x) for x in apart]
        begin[alone] = len(flat) + np.cumsum(size[alone]) - size[alone]
        return np.concatenate([flat, *apart]), begin, size

    def _learn(self, keys: np.ndarray, pieces: list[bytes], in_use: np.ndarray) -> None:
        """Remember pieces; those at the places ``in_use`` are not forgotten for them."""
        if len(self.keys) + len(keys) > CACHE_PIECES:
            rank = -self.at[:, 2]
            rank[in_use] -= _IN_USE
            stay = np.sort(np.argsort(rank, kind="stable")[: max(len(in_use), CACHE_PIECES // 2 - len(keys))])
            size = self.at[stay, 1]
            ends = np.cumsum(size)
            self.flat = self.flat[np.repeat(self.at[stay, 0] - (ends - size), size) + np.arange(size.sum())]
            self.keys, self.used = self.keys[stay], len(self.flat)
            self.at = np.stack([ends - size, size, self.at[stay, 2]], 1)
        flat, begin, size = self.fresh(pieces)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 2 + len(flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, np.stack([self.used + begin, size, np.zeros(len(size), np.int64)], 1), 0)
        self.used += len(flat)

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit ids of all texts, one after the other; where each text's begin, rows + 1)."""
        begin, whole = self.pieces(data, off)
        end = np.append(begin[1:], len(data))
        key = np.empty(len(begin), np.uint64)
        for a, z in B.runs(np.append(begin, len(data)), HASH_BYTES):
            x, y = int(begin[a]), int(end[z - 1])
            key[a:z] = B.span_hashes(data[x:y], begin[a:z] - x, end[a:z] - x)
        apart = (end - begin > PIECE_BYTES) | whole
        long, short = np.flatnonzero(apart), np.flatnonzero(~apart)
        unique, of, uses = np.unique(key[short], return_inverse=True, return_counts=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        raw = data.tobytes()
        if not known.all():
            which = np.empty(len(unique), np.int64)
            which[of] = short  # one occurrence of each
            which = which[~known]
            self._learn(unique[~known], [raw[x:y] for x, y in zip(begin[which].tolist(), end[which].tolist(), strict=True)], place[known])
            place = np.searchsorted(self.keys, unique)
        self.at[place, 2] += uses
        start, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        start[short], size[short] = self.at[place, 0][of], self.at[place, 1][of]
        own = self.encode([raw[x:y].decode("utf-8") for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        size[long] = [len(x) for x in own]
        ends = np.cumsum(size)
        out = self.flat.take(np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), mode="clip")
        for i, x in zip(long.tolist(), own, strict=True):
            out[ends[i] - size[i] : ends[i]] = x
        return out, np.append(0, ends)[np.searchsorted(begin, off)]


class Room:
    """Open windows by remaining capacity: a segment tree over capacities that says which are in use."""

    def __init__(self, window: int):
        self.size = 1 << (window).bit_length()
        self.used = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.used[i] += by
            i >>= 1

    def put(self, room: int, bin_: int) -> None:
        if room:
            self.open[room].append(bin_)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with at least ``need`` left, which is then no longer open."""
        used, i = self.used, need + self.size
        if not used[i]:
            while i > 1 and (i & 1 or not used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if used[2 * i] else 2 * i + 1
        room = i - self.size
        if room >= len(self.open):
            return None
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For items of at most ``window``: the window and the offset of each, and how full each window is."""
    room, full = Room(window), []
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = room.take(n)
        if got is None:
            got = (window, len(full))
            full.append(0)
        left, b = got
        at[i], offset[i] = b, full[b]
        full[b] += n
        room.put(left - n, b)
    return at, offset, full


def pack(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given token counts."""
    pieces, sequences = [], 0
    n = np.asarray(lengths, np.int64)
    for i in np.flatnonzero(n >= window).tolist():
        for k in range(int(n[i]) // window):
            pieces.append((i, k * window, window, sequences, 0))
            sequences += 1
    rest = np.flatnonzero(n % window)
    at, offset, full = best_fit_decreasing(n[rest] % window, window)
    cuts: dict[int, list[tuple[int, int]]] = {}  # window: [(first offset, sequence)]
    for b, have in enumerate(full):
        sizes = [have] if have * 4 >= window * 3 else [1 << k for k in range(have.bit_length() - 1, -1, -1) if have >> k & 1]
        begin, cuts[b] = 0, []
        for s in sizes:
            cuts[b].append((begin, sequences))
            sequences += 1
            begin += s
        cuts[b].append((begin, -1))
    for i, b, o in zip(rest.tolist(), at.tolist(), offset.tolist(), strict=True):
        size = int(n[i]) % window
        start = int(n[i]) - size
        for (x, s), (y, _) in zip(cuts[b], cuts[b][1:], strict=False):
            a, z = max(o, x), min(o + size, y)
            if a < z:
                pieces.append((i, start + a - o, z - a, s, a - x))
    return pieces


def _pack_batches(path: str, window: int, end_id: int, with_ids: bool, key_type):
    def go(batches):
        if _state.get("path") != path:
            _state.update(path=path, words=Words(path))
        words = _state["words"]
        base, used = TaskContext.get().partitionId() << 36, 0
        keys, tokens, held = [], [], 0  # a document's ids are a view of its chunk's bytes

        def flush():
            nonlocal used
            found = pack([len(t) // 4 for t in tokens], window)
            rows = IDS_ROWS if with_ids else 4000
            for a in range(0, len(found), rows):
                part = found[a : a + rows]
                cut = [tokens[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in part]
                cols = [
                    pa.array([keys[i] for i, *_ in part], key_type), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([len(tokens[p[0]]) // 4 for p in part], pa.int64()),
                    pa.array([base + used + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in cut)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cut), np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])
            used += 1 + max((p[3] for p in found), default=-1)
            keys.clear()
            tokens.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = B.buffers(batch.column(1))
            for a, z in B.runs(off, CHUNK_BYTES):
                got, begin = words.ids(data[off[a] : off[z]], off[a : z + 1] - off[a])
                raw = memoryview(np.insert(got, begin[1:], np.uint32(end_id)).astype("<u4", copy=False).tobytes())
                begin = ((begin + np.arange(len(begin))) * 4).tolist()
                keys += ids[a:z]
                tokens += [raw[x:y] for x, y in zip(begin, begin[1:], strict=False)]
                held += len(raw)
                if len(keys) >= GROUP or held > GROUP_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return go


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``) the ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return own.mapInArrow(tidy(_pack_batches(tokenizer_path, window, end_id, with_ids, to_arrow_type(kind))), out)


def op1_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
