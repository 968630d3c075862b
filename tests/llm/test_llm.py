"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import hashlib
import math
import os
import random
import re
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from maskwright.llm import chat_format, components, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, ppm_score, toxicity
from maskwright.llm.common import fold

EDGE = [(900, None), (901, ""), (902, "   \n\t "), (903, "x"), (904, "%%% !!!"), (None, "a text without id that is long enough to matter")]
DOCS = "doc_id long, text string"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    lines = [" ".join(r.choice(vocab) for _ in range(r.randint(5, 60))) for _ in range(40)]
    docs = []
    for i in range(n):
        own = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            at = r.randint(0, 35)
            own[1:1] = lines[at : at + r.randint(1, 4)]
        docs.append("\n".join(own))
    for i in range(0, n, 5):  # near and exact copies
        w = docs[i].split(" ")
        w[r.randrange(len(w))] = "changed"
        docs += [" ".join(w), docs[i]]
    return list(enumerate(docs))


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(corpus() + EDGE if rows is None else rows, schema)


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({65 + i: 97 + i for i in range(26)}))


def test_packing(spark):
    rows = corpus() + EDGE + [(905, "long " * 5000), (906, "a  b \n \n c"), (906, "a  b \n \n c")]
    out = packing.pack_documents(frame(spark, rows), TOKENS).collect()
    tok = packing.Words(TOKENS)
    pieces = {}
    for p in out:
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
    for d, text in dict(rows).items():
        want = [*tok.encode([text or ""])[0].tolist(), 1]
        got = [i for _, ids in sorted(pieces[d], key=lambda x: x[0]) for i in ids]
        assert Counter(got) == Counter(want * (2 if d == 906 else 1))
        assert d == 906 or got == want
    seq = {}
    for p in out:
        seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack_documents(frame(spark, []), TOKENS).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = random.Random(5)
    lengths = np.array([r.randint(1, 64) for _ in range(300)])
    at, offset, full = packing.best_fit_decreasing(lengths, 64)
    rooms = []  # the same by search over all windows
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [k for k in range(len(rooms)) if rooms[k] >= n]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        if k == len(rooms):
            rooms.append(64)
        rooms[k] -= n
    assert sorted(64 - f for f in full) == sorted(rooms)


def test_language_id(spark):
    en, de = "the cat and the dog ran over this hill with them ", "der hund und die katze liefen über den hügel mit ihnen "
    rows = [(i, (en if i % 2 else de) * r, "en" if i % 2 else "de") for i, r in enumerate([1, 2, 3, 4] * 20)]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in EDGE)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == la and not got[i]["rejected"] and 0 <= got[i]["score"] <= 1 for i, _, la in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und"] * 4
    odd = spark.createDataFrame([(1, "жжж щщщ ыыы ююю " * 20)], DOCS)
    assert language_id.identify(odd, model).first()["rejected"]
    assert set(language_id.keep_identified(docs.withColumn("_text", F.lit(1)), model).columns) == {"doc_id", "text", "lang", "_text"}
    assert language_id.train(docs.limit(0)) is not None and language_id.identify(docs.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    counts = Counter()
    text = " abra cadabra abra "
    for i in range(len(text) - 2):
        counts[np.array([ord(c) for c in text[i : i + 3]], np.uint32).tobytes()] += 1
    m = language_id.Model({"x": counts}, 3)
    alphabet = sorted(set(text))
    for ctx in ("ab", "ra"):
        total = 0.0
        for c in alphabet:
            x = np.array([ord(v) for v in ctx + c], np.uint32)
            one, two = m.score(x, np.array([0, 3]))[0], m.score(x[:2], np.array([0, 2]))[0]
            total += math.exp(float(one[0, 0] - two[0, 0]))
        assert 0.8 < total <= 1.0001


def brute_components(nodes, links):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp


def test_connected_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    got = {x["node"]: x["component"] for x in components.connected_components(df).collect()}
    want = brute_components({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n in got} and {n for e in links for n in e if e[0] != e[1]} <= set(got)
    assert components.connected_components(df.limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((30, 16))
    v = np.concatenate([base, base[:10] + 0.02 * r.standard_normal((10, 16)), base[:1] + 1e-4 * r.standard_normal((40, 16)), base[:2]])
    rows = [(i, x.tolist(), i % 2 if i < 30 else 0) for i, x in enumerate(v)]
    odd = [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, base[0].tolist(), None), (504, [None] * 16, 0), (505, [], 0), (506, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1))
    got = {x["vec_id"]: x for x in embedding_dedup.near_vectors(df, planes=8).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = (unit @ unit.T >= 0.98) & (np.array([x[2] for x in rows])[:, None] == np.array([x[2] for x in rows]))
    np.fill_diagonal(hit, False)
    comp = brute_components(range(len(v)), [(i, j) for i, j in zip(*np.nonzero(hit), strict=True)])
    for i in range(len(v)):
        assert got[i]["n_links"] == hit[i].sum() and got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i)
    assert all(got[i[0]]["n_links"] == 0 and got[i[0]]["kept"] for i in odd)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home {0}</a></ul></nav>
<div class="ad">Buy {0}</div><article><h1>Title {0}</h1><p>One &amp; <b>bo</b>ld {0}<br>two<p>three<div class="comments"><p>nice!</div><aside>side</aside></article><footer>&copy; x</footer></body></html>"""
PLAIN = "<html><body><div class=top>Same words</div><div class=story><p>Story {0} is told</p></div><div class=bottom>Same end</div>"


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(5)] + [(10 + i, f"https://b.example/{i}", PLAIN.format(i)) for i in range(12)]
    rows += [(50, None, None), (51, "http://a.example/z", ""), (52, "http://c.example/", "<article><p>cut &eacute"), (53, "x", "no tags  at\n all"), (53, "x", "no tags  at\n all")]
    got = [(x["page_id"], x["text"], x["n_chars"]) for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))).collect()]
    texts = dict((a, b) for a, b, _ in got)
    assert all(texts[i] == f"Title {i} One & bold {i} two three" for i in range(5))
    assert all(texts[10 + i] == f"Story {i} is told" for i in range(12))
    assert texts[50] == texts[51] == "" and texts[52] == "cut é" and texts[53] == "no tags at all" and len(got) == len(rows)
    assert all(n == len(t) for _, t, n in got)


def test_wrapper_decides_in_articles_and_under_copies(spark):
    article = "<body><article><div class=bar>Read us daily</div><p>Story {0} is told</p></article>"
    rows = [(i, f"http://a.example/{i}", article.format(i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", PLAIN.format(max(0, i - 44))) for i in range(55)]  # 45 copies
    got = {x["page_id"]: x["text"] for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is told" for i in range(12))
    assert all(got[100 + i] == f"Story {max(0, i - 44)} is told" for i in range(55))


def sets_of(text, k):
    w = words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


@pytest.mark.parametrize("shingle,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, shingle, percent):
    rows = corpus(3, 80)
    r = random.Random(9)
    for i in range(0, 60, 2):  # a ladder of ever more distant copies
        w = rows[i][1].split(" ")
        for _ in range(r.randint(1, 6)):
            w.insert(r.randrange(len(w)), f"new{r.randint(0, 99)}")
        rows.append((1000 + i, " ".join(w)))
    got = {x["doc_id"]: x for x in jaccard_join.near_duplicates(frame(spark, rows + EDGE[:5]).withColumn("n", F.lit(1)), shingle=shingle, percent=percent).collect()}
    s = {i: sets_of(t, shingle) for i, t in rows + EDGE[:5]}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    comp = brute_components(s, links)
    assert {i: (len(s[i]), comp[i]) for i in s} == {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()}
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_pigeonhole_never_misses():
    r = random.Random(4)
    bands = jaccard_join.Bands(80)
    for _ in range(300):
        n = r.randint(4, 400)
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(r.choice(sorted(c))) if r.random() < 0.5 else c.add(r.getrandbits(64))
            if not c or len(a & c) < 0.8 * len(a | c):
                break
            b = c
        keys = [set(jaccard_join.segment_keys(np.array(sorted(x), np.uint64), bands).tolist()) for x in (a, b)]
        assert a == b or keys[0] & keys[1]


def brute_runs(rows, least=50):
    """Deletes all runs of lines with at least ``least`` words that occur earlier."""
    seen, out = set(), {}
    for d, text in sorted((x for x in rows if x[1] is not None), key=lambda x: x[0]):
        lines = text.split("\n")
        full = [(k, len(words(x, r"[^\x20\x09-\x0D]+"))) for k, x in enumerate(lines)]
        full = [x for x in full if x[1]]
        gone = set()
        for a in range(len(full)):
            for z in range(a, len(full)):
                if sum(n for _, n in full[a : z + 1]) >= least:
                    content = tuple(lines[k] for k, _ in full[a : z + 1])
                    if content in seen:
                        gone |= set(range(full[a][0], full[z][0] + 1))
                    seen.add(content)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    rows = corpus(7, 80) + EDGE[:5]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumn("spans", F.lit("s"))).collect()
    want = brute_runs(rows)
    assert {x["doc_id"]: x["text"] for x in got} == {**want, 900: None} and {x["spans"] for x in got} == {"s"}
    assert sum(x["n_removed"] for x in got) > 0 and line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_deletes_whole_runs(spark):
    long, short = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(12))
    pairs = [(i, t) for i, t in enumerate([f"{long}\n{short}", f"x\n{long}\n\n{short}\ny", f"{short}\n{long}\n{short}", f"{short}\nz"])]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, pairs)).collect()}
    assert got == brute_runs(pairs) and got[1] == "x\ny" and got[2] == short and got[3] == f"{short}\nz"
    rows = corpus(7, 80)
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, rows)).collect()} == brute_runs(rows)


def test_chat(spark):
    rows = [(1, 0, "user", "a <|im_end|> b <\\|x"), (1, 1, "assistant", "ok <|im_start|>"), (1, 1, "assistant", "tie"), (2, 0, None, None), (3, 0, "a\nb\\n", "<|"), (4, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(0))
    got = {x["conv_id"]: x for x in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in (1, 2, 3, 4):
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,n_pages:int>"
    typed = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "img1", 57, 28, None, None), ("audio", None, "a1", None, None, 2.0, None), None])], f"conv_id long, turn long, role string, parts array<{part}>")
    out = chat_format.format_chats(typed, parts="parts", text="role").first()
    assert out["formatted"] == "<|im_start|>user\nsee <|image|><|audio|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in out["attachments"]] == [("image", "img1", 3), ("audio", "a1", 50)]
    assert chat_format.digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_decontaminate(spark, monkeypatch):
    rows = corpus(5, 40)
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    source = [words(t, pat) for _, t in rows]
    items = [(i, " ".join(source[i][3 : 3 + 5 * i])) for i in range(8)] + [(20, "changed"), (21, None), (22, "!!"), (23, "zz yy")]
    docs, bench = frame(spark, rows + EDGE), spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, which = words(text, pat), set(), set()
        for i, t in items:
            b = words(t, pat)
            n = min(len(b), 10)
            wins = {tuple(b[q : q + n]) for q in range(len(b) - n + 1)} if b else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    which.add(str(i))
        return len(w), len(hit), sorted(which)

    for size in (decontaminate.BLOCK_BYTES, 400):  # one block, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.find_matches(docs, bench).collect()
        for x in got:
            text = dict(rows + EDGE)[x["doc_id"]]
            assert (x["n_words"], x["n_hit"], sorted({i["item_id"] for i in x["items"]})) == brute(text)
    whole = [i for i in {i["item_id"]: i["longest"] for x in got if x["doc_id"] == 7 for i in x["items"]}.items() if i[0] == "7"]
    assert whole and whole[0][1] >= min(len(words(items[7][1], pat)), 10)
    kept = decontaminate.decontaminate(docs.withColumn("hit", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "hit"] and kept.count() == sum(brute(t)[1] == 0 for _, t in rows + EDGE)
    assert decontaminate.find_matches(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_packing_words_outside_ascii():
    """Blank and word go to the tokenizer together, whatever their letters; no threads of its own beside the task's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    w, given = packing.Words(TOKENS), []
    encode = w.encode
    w.encode = lambda texts: given.extend(texts) or encode(texts)
    text = "größer über été naïve Ἀθήνα слово " + "".join(f"x{i}ß " for i in range(300)) + "a\u00a0b \u00a0c e\u0301\u2003 d's"
    raw = np.frombuffer(text.encode(), np.uint8)
    got, _ = w.ids(raw, np.array([0, len(raw)]))
    assert got.tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(given) < 10 and os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_packing_words_at_line_starts():
    """A line's first word goes to the tokenizer with others, not alone; texts given to it are short, for it is slower on long ones."""
    w, given = packing.Words(TOKENS), []
    encode = w.encode
    w.encode = lambda texts: given.extend(texts) or encode(texts)
    text = "".join(f"\nx{i}ß y{i}\u00e4 it{i}'s" for i in range(2000)) + "\n\u00a0a \n b\n\nc\r\nd\n's\n12"
    raw = np.frombuffer(text.encode(), np.uint8)
    got, _ = w.ids(raw, np.array([0, len(raw)]))
    assert got.tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(given) < 200 and max(map(len, given)) < 2000


def test_packing_batches_are_small():
    """A batch with ids holds 2 MB of them at most; a group of 12 MB used to go out in one."""
    class Here:
        get = staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0))

    held, packing.TaskContext = packing.TaskContext, Here
    try:
        docs = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["one two three four five six seven eight " * 500] * 600)], names=["doc_id", "text"])
        sizes = [b.column("ids").nbytes for b in packing._pack_batches(TOKENS, packing.WINDOW, packing.END_ID, True, pa.int64())(iter([docs]))]
    finally:
        packing.TaskContext = held
    assert sum(sizes) > 8 << 20 and max(sizes) <= (2 << 20) + 4096


def test_ppm(spark):
    rows = corpus(6, 60) + EDGE + [(903, "x")]
    docs = frame(spark, rows)
    got = ppm_score.language_model_scores(docs, fold(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tok = [[*words(t, r"[^\x20\x09-\x0D]+"), None] for _, t in rows]
    c = Counter(w for (i, _), x in zip(rows, tok, strict=True) if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 5)) for x in tok)
    assert sorted((g["n_tokens"], g["n_known"], round(g["base_score"], 5)) for g in got) == want
    assert all(g["score"] < 0 and g["train_tokens"] == n for g in got)


def test_ppm_whole_model(spark):
    """Over a million n-grams of training text: what occurs twice counts as such, as plain partial matching has it."""
    rare = "Zyx qv-17 wobbled past eleven krakens; twice."
    texts = Counter({"the cat sat on the mat and the dog lay by the door of the old house ": 16_000, rare: 2, "": 1, "größer als je": 3})
    rows = [(i, t) for i, t in enumerate(texts.elements())]
    held = [(-1, rare), (-2, "the cat wobbled"), (-3, None), (-4, "Q" * 40)]
    docs = frame(spark, rows + held)
    got = {x["doc_id"]: x["score"] for x in ppm_score.language_model_scores(docs, F.col("doc_id") >= 0).collect()}
    seen = [{} for _ in range(ppm_score.DEPTH + 1)]
    for t, times in texts.items():
        raw = bytes(ppm_score.DEPTH) + t.encode() + b"\0"
        for at in range(ppm_score.DEPTH, len(raw)):
            for k in range(ppm_score.DEPTH + 1):
                seen[k].setdefault(raw[at - k : at], Counter())[raw[at]] += times

    def p(k, ctx, sym):
        own = seen[k].get(ctx, Counter())
        if k == 0:
            return (own[sym] + 0.5) / (own.total() + 128)
        if not own:
            return p(k - 1, ctx[1:], sym)
        if sym in own:
            return own[sym] / (own.total() + len(own))
        return len(own) / (own.total() + len(own)) * p(k - 1, ctx[1:], sym) / max(1 - sum(p(k - 1, ctx[1:], s) for s in own), 1e-9)

    for i, t in [*held, (0, rows[0][1]), (len(rows) - 1, rows[-1][1])]:
        raw = bytes(ppm_score.DEPTH) + (t or "").encode() + b"\0"
        want = sum(math.log10(p(ppm_score.DEPTH, raw[at - ppm_score.DEPTH : at], raw[at])) for at in range(ppm_score.DEPTH, len(raw)))
        assert abs(got[i] - want) < 1e-4 * abs(want) + 1e-5, (i, got[i], want)


def test_trie_is_a_distribution():
    text = b"abracadabra abracadabra"
    code, _ = ppm_score.byte_codes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    levels = []
    for k in range(ppm_score.DEPTH + 1):
        levels.append(np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True))
    trie = ppm_score.Trie(levels)
    for ctx in (b"abra", b"zzzz", b"a ab"):
        base = np.uint64(int.from_bytes(ctx, "big") << 8)
        assert abs((10 ** trie.score(base + np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-6


def test_toxicity():
    r = random.Random(8)
    vocab = ["".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 6))) for _ in range(150)]
    texts, y = [], []
    for i in range(480):
        w = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        if i % 2:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["vilewort", "grimbad", "vilegrim"])
        texts.append(" ".join(w))
        y.append(i % 2)
    net = toxicity.fit(pa.array(texts[:440]), np.array(y[:440]))
    data, off = toxicity.B.buffers(pa.array([*texts[440:], "", None, "!!", "word " * 9000]))
    s = toxicity.score_texts(net, data, off)
    assert ((s[:40] >= 0.5) == np.array(y[440:])).mean() > 0.85 and ((s >= 0) & (s <= 1)).all()


def test_gradients_match_differences():
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, off = toxicity.B.buffers(pa.array(["some small words here", "and other ones"]))
    w, idx, _ = toxicity._windows(data, off)
    x, xw = net.inputs(w)
    logit, kept = net.forward(xw, idx, keep=True)
    g = net.gradients(w, x, idx, kept, np.ones(len(idx)), np.ones(len(w.word), bool))
    for name, at in (("u0", (1, 2)), ("u1", (3, 7)), ("w", (4, 30)), ("a", (2, 1)), ("v", (3,)), ("ew", (int(w.word[0]), 1)), ("ec", (int(w.char[0]), 2))):
        old, ends = net.p[name][at], []
        for d in (1e-3, -1e-3):
            net.p[name][at] = old + d
            ends.append(net.forward(net.inputs(w)[1], idx).sum())
        net.p[name][at] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    d = str(tmp_path)
    rows = [(i, t, ["en", "de"][i % 2], "s", len(t)) for i, t in corpus(11, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[:12]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = {r[0]: r[1] for r in rows}  # all are identified
    left = {i: t for i, t in brute_runs(list(docs.items())).items() if t.strip()}
    s = {i: sets_of(t, 5) for i, t in left.items()}
    comp = brute_components(s, [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
    one = {i: t for i, t in left.items() if comp[i] == i}
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    b = words(" ".join(rows[3][1].split()[:12]), pat)
    wins = {tuple(b[q : q + 10]) for q in range(len(b) - 9)}
    clean = {i for i, t in one.items() if not any(tuple(words(t, pat)[p : p + 10]) in wins for p in range(len(words(t, pat))))}
    assert {x["doc_id"] for x in cp.run(spark, d).collect()} == clean
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "packing"]
