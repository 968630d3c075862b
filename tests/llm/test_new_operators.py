"""Passage automata, phrase mining and token alignment against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from maskwright.llm import passage_dedup, phrase_mining, token_align
from maskwright.llm.bytes_np import buffers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
ODD = ["", " ", "  ", "x", "a  b \n\t c ", "ends with blank ", "Wörter über Ümläute", "日本語のテキスト", "🙂🙂 ok", "▁ not a blank", "<|endoftext|> is text", "<s> </s> <unk>", "é   　x", "nul \x00 \r\n", "1234567890" * 9, "word" * 60]


def plain_alignment(texts):
    """The contract of the alignment, written out."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    spelled_a, out, counts = token_align.Bytes(A).bytes, [], Counter()
    for text in texts:
        ids_a, ids_b, links, groups = [], [], [], []
        if text:
            ids_a, ids_b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            by_a = [spelled_a[i] for i in ids_a]
            by_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in ids_b)]
            if b"".join(by_a) != (" " + text).encode() or b"".join(by_b) != (" " + text).encode():
                ids_a, ids_b = [], []
        if ids_a:
            span = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
            at_a, at_b = span(by_a), span(by_b)
            links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
            cut = sorted({e for _, e in at_a} & {f for _, f in at_b})
            for lo, hi in zip([0, *cut], cut, strict=False):
                groups.append((",".join(str(i) for i, (_, e) in zip(ids_a, at_a, strict=True) if lo < e <= hi), ",".join(str(i) for i, (_, e) in zip(ids_b, at_b, strict=True) if lo < e <= hi)))
        counts.update(links)
        out.append((ids_a, ids_b, links, ";".join("|".join(g) for g in groups), len(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, links, g, n in out]


def test_alignment_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(token_align, "RUN_BYTES", 700)
    r = random.Random(7)
    parts = [" ", "  ", "\n", "the", " of", "Wör", "ter", "ing", ",", ".", "12", "日本", "🙂", "é", "▁", "<|endoftext|>", "tion", "x"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(60)] + [" ".join(r.choice(["alpha", "Beta", "gamma,", "delta"]) for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (901, None), (5, texts[5])]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], DOCS + ", n_a long, pair string").repartition(3)
    got, pairs = token_align.align_documents(docs, A, B)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((x["doc_id"], *(x[n] for n in names)) for x in got.collect()) == Counter((d, *w) for (d, _), w in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert pairs.filter("best = 1").count() >= pairs.select("id_b").distinct().count()


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_merge_path_of_any_piece_size(piece):
    r = random.Random(piece)
    for _ in range(60):
        total = r.randint(1, 80)
        ends = lambda: np.array(sorted({*r.sample(range(1, total + 1), r.randint(0, total)), total}))  # noqa: B023, E731
        a, b = ends(), ends()
        i, j, both = token_align.merge_path(a, b, piece)
        steps = sorted({*a.tolist(), *b.tolist()})
        assert i.tolist() == np.searchsorted(a, steps).tolist() and j.tolist() == np.searchsorted(b, steps).tolist()
        assert both.tolist() == [x in set(a.tolist()) & set(b.tolist()) for x in steps]


def test_words_of_sentence_pieces_are_tokenized_as_the_whole_text(monkeypatch):
    monkeypatch.setattr("maskwright.llm.packing.CACHE_PIECES", 200)
    r, words = random.Random(2), token_align.SentencePieces(B)
    parts = [" ", "  ", "   ", "\n", "a", "the", "Über", ".", "🙂", "▁", "x" * 70, "12"]
    texts = [" " + "".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400)]
    for a in range(0, 400, 100):
        ids, first = words.ids(*buffers(pa.array(texts[a : a + 100])))
        assert [ids[first[k] : first[k + 1]].tolist() for k in range(100)] == [words.model.encode(t[1:]) for t in texts[a : a + 100]]


def test_alignment_of_nothing(spark):
    got, pairs = token_align.align_documents(spark.createDataFrame([], DOCS), A, B)
    assert got.count() == 0 and pairs.count() == 0


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand, kept = {p for p in count if " " in p and count[p] >= least}, []
        for p in cand:
            w = p.split(" ")
            cuts = [(2_000_000 * count[p] // (count[" ".join(w[:k])] + count[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(f" {p} " in f" {q} " and q != p and 100 * count[q] >= 80 * count[p] for q in cand):
                kept.append((-score, -count[p], p.encode(), p, count[" ".join(w[:k])], count[" ".join(w[k:])]))
        out += [(lang, i + 1, x[3], -x[1], x[4], x[5], n[lang], -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("shards", "slots"), [(1, 1 << 16), (3, 1 << 16), (4, 4)])
def test_phrases_against_brute_force(spark, shards, slots):
    r = random.Random(shards)
    vocab = ["Ab", "b", "c", "dé", "e\u00a0f", "ß", "x,y", "z.", "\n", "\t", "  "]
    rows = [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), ("fr", "..."), ("en", "Rare words Here. rare words here, " * 9), ("de", "b " * 400)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, text string, k int, f int").repartition(3)
    got = phrase_mining.collocations(phrase_mining.phrase_counts(docs, least=8, shards=shards, slots=slots), top=25)
    assert sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(rows, 8, 25)


def test_phrases_of_nothing(spark):
    counts = phrase_mining.phrase_counts(spark.createDataFrame([], "lang string, text string"))
    assert phrase_mining.collocations(counts).count() == 0
    counts = phrase_mining.phrase_counts(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string"))
    assert phrase_mining.collocations(counts).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 1 << 62
    rows = [("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 5), ("en", "a b", 2, big // 3)]
    got = phrase_mining.collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).first()
    assert got["score"] == 2_000_000 * (big // 3) // (2 * big - 5)


def plain_passages(rows, window):
    """Words and kept words by the rule of windows, of rows (id, text); equal rows are one document."""
    first, docs = {}, sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}, key=lambda x: x[:2])
    cut = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    out = {}
    for known, d, t in docs:
        w = cut(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (known, d, i)) != (known, d, i):
                gone[i : i + window] = [True] * window
        out[known and d if known else None, t] = (" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2000, 20), (3, 1)])
def test_passages_against_brute_force(spark, hot, shard):
    r = random.Random(hot)
    vocab = ["ab", "c", "dé", "日本", "x.", "A", "a", "\u00a0"]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randint(5, 60))) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(vocab) + str(r.randint(0, 30)) for _ in range(r.randint(0, 25))) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice(["  ", "\n", "\t "]).join(parts)))
    rows += [(200, rows[3][1]), (201, "one two " * 60), (202, "same " * 100), (203, "one two " * 60 + "three"), (204, ""), (205, None), (206, " \n "), (207, "x"), (None, passages[0] + " null id"), (7, rows[7][1]), (208, " lead " + passages[1] + " ")]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], DOCS + ", n_words long, spans string").repartition(4)
    names = docs.columns
    got = passage_dedup.dedup_passages(docs.withColumnRenamed("n_words", "key"), window=6, gram=3, hot=hot, shard=shard).collect()
    want = plain_passages(rows, 6)
    assert len(got) == len(rows) and len(names) == 4
    assert Counter((x["doc_id"], x["text"], x["n_words"], x["n_removed"]) for x in got) == Counter((d, *(want[d, t] if t is not None else (None, 0, 0))) for d, t in rows)


def test_passages_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text + " one"), (1, text + " two"), (2, "w")], DOCS)
    got = sorted((x["n_words"], x["n_removed"]) for x in passage_dedup.dedup_passages(docs).collect())
    assert got == [(1, 0), (41, 0), (41, 40)]
    assert passage_dedup.dedup_passages(docs.limit(0)).count() == 0
