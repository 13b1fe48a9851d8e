"""The operators against slow and plain versions of what they compute, on small fixtures."""

import base64
import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from vellum.llm import bagminhash, bpe, decontam, fmindex, langid, ngramlm, repetition, seekable, toxicity
from vellum.llm.common import utf8_buffers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    """Documents of few words with shared passages, copies and repetition."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 70))] for _ in range(10)]
    out = []
    for d in range(140):
        ws = []
        for _ in range(rng.randint(0, 6)):
            ws += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.5:
                ws += rng.choice(passages)[rng.randint(0, 3) :]
        if out and rng.random() < 0.3:
            ws = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            ws = ws + ws
        out.append(" ".join(ws))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_repetition(texts):
    off, raw = utf8_buffers(pa.array([*texts, "a b a b a b a b", "l1 x\nl2\nl1 x\nl1 x", "é é é"]))
    got = repetition.measure(off, raw)
    for i, text in enumerate([*texts, "a b a b a b a b", "l1 x\nl2\nl1 x\nl1 x", "é é é"]):
        ws = text.split()
        total = sum(map(len, ws)) or 1
        for n in range(2, 11):
            count, cover = collections.Counter(), set()
            for k in range(len(ws) - n + 1):
                g = tuple(ws[k : k + n])
                count[g] += 1
                if count[g] > 1:
                    cover |= set(range(k, k + n))
            if n in repetition.TOP:
                want = max((min((c - 1) * sum(map(len, g)) / total, 1) for g, c in count.items()), default=0)
                assert got[f"top_{n}"][i] == pytest.approx(want)
            if n in repetition.COVER:
                assert got[f"cover_{n}"][i] == pytest.approx(sum(len(ws[k]) for k in cover) / total)
        lines = [x for x in text.split("\n") if x]
        seen, again = set(), 0
        for x in lines:
            again += len(x) * (x in seen)
            seen.add(x)
        assert got["dup_lines"][i] == pytest.approx(again / (sum(map(len, lines)) or 1))


def test_bagminhash_is_unbiased():
    a, b = pa.array(["a a a b c", "x y z", "p p p p p p p q"]), pa.array(["a a b c d", "x y z w w w w w w w w w", "p p p q q"])
    real = bagminhash.overlap(a, b, 1)
    sides = []
    for c in (a, b):
        w = bagminhash.Words(*utf8_buffers(c))
        sides.append(bagminhash.signatures(*bagminhash.weighted(*bagminhash.shingles(w, 1)), len(c), 8192))
    assert np.allclose((sides[0] == sides[1]).mean(axis=1), real, atol=0.02)


def test_duplicates(spark, texts):
    multisets = [collections.Counter(zip(w, w[1:])) if len(w) > 1 else collections.Counter([tuple(w)]) if w else None for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(multisets):
        for j in range(i):
            b = multisets[j]
            if a and b:
                both, n = sum((a & b).values()), sum(a.values()) + sum(b.values())
                if both / (n - both) >= bagminhash.THRESHOLD:
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts)) if find(i) != i}
    got = {r["doc_id"]: r["duplicate_of"] for r in bagminhash.duplicates(frame(spark, texts)).collect()}
    hit = sum(got.get(k) == v for k, v in want.items())
    assert hit >= 0.9 * len(want) and set(got) <= set(want)


def _spaced(rng, words):
    """The words with uneven white space, and where each begins and ends."""
    text, spans = rng.choice(["", " ", "\n\n"]), []
    for w in words:
        spans.append((len(text), len(text) + len(w)))
        text += w + rng.choice([" ", " ", "  ", "\n", " \t "])
    return text, spans


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("size", [800, 1 << 18])
@pytest.mark.parametrize("even", [True, False])
def test_repeats(spark, texts, earlier, size, even, monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", size)
    length, gram, rng = 10, 4, random.Random(size)
    words = [[w + "\u00e9" * (len(w) % 2) for w in t.split()] for t in texts]
    spaced = [_spaced(rng, ws) if not even else _spaced(random.Random(0), ws) if k % 2 else (" ".join(ws), [(m.start(), m.end()) for m in re.finditer("\\S+", " ".join(ws))]) for k, ws in enumerate(words)]
    occ = collections.defaultdict(list)
    for d, ws in enumerate(words):
        for p in range(len(ws) - length + 1):
            occ[tuple(ws[p : p + length])].append((d, p))
    want, kept = set(), {}
    for d, (ws, (text, spans)) in enumerate(zip(words, spaced)):
        hit = [False] * len(ws)
        for p in range(len(ws) - length + 1):
            places = occ[tuple(ws[p : p + length])]
            if min(places) < (d, p) if earlier else len(places) > 1:
                hit[p : p + length] = [True] * length
        k, out, at = 0, [], 0
        while k < len(ws):
            if hit[k]:
                j = k
                while j + 1 < len(ws) and hit[j + 1]:
                    j += 1
                want.add((d, spans[k][0], spans[j][1]))
                out.append(text[at : spans[k][0]].strip())
                k, at = j, spans[j][1]
            k += 1
        kept[d] = "\n".join(x for x in [*out, text[at:].strip()] if x) if any(hit) else text
    df = frame(spark, [t for t, _ in spaced])
    got = fmindex._union(fmindex._intervals(df, earlier, length, gram))
    assert {tuple(r) for r in got.select("doc_id", "start", "end").collect()} == want
    if earlier:
        rest = {r["doc_id"]: r["text"] for r in fmindex.remove(df, length, gram).collect()}
        assert rest == {d: t for d, t in kept.items() if t or not any(d == e for e, _, _ in want)}


def _records(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("earlier", [False, True])
def test_repeats_work_follows_the_text(spark, earlier, monkeypatch):
    """A short passage in the midst of ever other words: twice the documents take twice the rows, and all are found."""
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 800)
    length, passage, moved = 10, " ".join(f"p{i}" for i in range(12)), []
    for n in (150, 300):
        rows = [(d, " ".join([*(f"a{d}x{j}" for j in range(30)), passage, *(f"b{d}x{j}" for j in range(30))])) for d in range(n)]
        df, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), _records(spark)
        got = {tuple(r) for r in fmindex._union(fmindex._intervals(df, earlier, length, 4)).select("doc_id", "start", "end").collect()}
        moved.append(_records(spark) - before)
        assert got == {(d, t.index(passage), t.index(passage) + len(passage)) for d, t in rows[earlier:]}
    assert moved[1] < 2.3 * moved[0]


def test_remove(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(5, f"start {passage} end"), (2, f"first {passage}"), (9, passage)]
    got = {r["doc_id"]: r["text"] for r in fmindex.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: f"first {passage}", 5: "start\nend"}


def test_remove_with_uneven_spaces(spark):
    p, q = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(60)]
    rows = [(0, " ".join(p)), (1, " ".join(p[:5]) + "  " + " ".join([*p[5:], *q])), (2, " ".join(p) + "  " + " ".join(q))]
    for order in ([0, 1, 2], [2, 1, 0]):
        df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
        assert {r["doc_id"]: r["text"] for r in fmindex.remove(df).collect()} == {0: " ".join(p), 1: " ".join(q)}


def test_wavelet_and_backward_search():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 3000)
    w = fmindex.Wavelet(seq, 37)
    s, i = rng.integers(0, 37, 200), rng.integers(0, 3001, 200)
    assert (w.rank(s, i) == [(seq[:k] == c).sum() for c, k in zip(s, i)]).all()


def _distance(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


@pytest.mark.parametrize("rate", [decontam.RATE, 0.2, 0.02])
def test_decontamination(spark, rate):
    rng = random.Random(2)
    items = ["".join(rng.choice("abcdefghij klmno-\u00e9") for _ in range(rng.randint(45, 260))).strip() for _ in range(12)] + ["abcdefghij" * 8]
    docs = []
    for d in range(60):
        x = list(rng.choice(items))
        for _ in range(rng.randint(0, 30)):
            k, q = rng.randrange(len(x)), rng.random()
            if q < 0.34:
                x[k] = "z"
            elif q < 0.67 and len(x) > 20:
                del x[k]
            else:
                x.insert(k, "y")
        docs.append("Some words before " * (d % 4) + "".join(x).upper() + "\n and  after" * (d % 3))
    df = frame(spark, docs)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    norm = lambda t: " ".join(t.lower().split()).encode()
    want = {(d, n, e) for d, t in enumerate(docs) for n, i in enumerate(items) if (e := _distance(p := norm(i), norm(t))) <= int(rate * len(p))}
    assert {tuple(r) for r in decontam.matches(df, bench, rate).collect()} == want and len(want) > 5
    assert {r["doc_id"] for r in decontam.clean(df, bench, rate).collect()} == set(range(60)) - {d for d, _, _ in want}


def test_decontamination_of_short_items(spark, tmp_path):
    items = ["short", "Yes", "what is  it?", "é", "a", "(a)", "", " ", "x" * 39, "x" * 40, "of a", "of a", "zzz", None]
    docs = ["Plain words of a SHORT text", "shorter yesterday", "yes: What\nis it?", "né É", "(A) or of aa", "", None, "x" * 39, "x" * 40, "a", "it? what is", "zz z", "short"]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    norm = lambda t: " ".join((t or "").lower().split())

    def held(p, t):
        ends = [k for k in range(len(t) + 1) if not (0 < k < len(t) and t[k - 1].isalnum() and t[k].isalnum())]
        return any(t.startswith(p, k) and k + len(p) in ends for k in ends)

    want = {(d, n, 0) for d, t in enumerate(docs) for n, i in enumerate(items) if (p := norm(i)) and held(p, norm(t))}
    got = {tuple(r) for r in __spark_entry__.queries()["op7_decontamination"](spark, str(tmp_path)).collect()}
    # The item of 40 bytes has a budget: the text of 39 is one edit away.
    assert got == want | {(7, 9, 1)} and len(want) > 12
    kept = decontam.clean(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark")))
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, _, _ in got}


def test_bpe(spark, texts):
    ranks = bpe.load()
    real = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    parts = ["a", "b", "the", "ing", " ", "\n", "  ", "'s", "1", "22", "é", "日本", "🙂", "!!", "aaaaaaa", "anananan", "abab"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    df = frame(spark, [*texts, *odd])
    rows = bpe.encode(df)
    got = {r["doc_id"]: r for r in rows.collect()}
    for d, t in enumerate([*texts, *odd]):
        assert got[d]["tokens"] == real.encode_ordinary(t) and got[d]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(rows).collect()}
    assert [back[d] for d in range(len(back))] == [*texts, *odd]
    # Parts of characters, no tokens, and null.
    parts = [(0, [ranks[b"\xe6"]]), (1, []), (2, None), (3, [ranks[b"a"], ranks[b"\xc3"], ranks[b"\xa9"]])]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(parts, "doc_id long, tokens array<int>").coalesce(1)).collect()}
    assert back == {0: "\ufffd", 1: "", 2: None, 3: "a\u00e9"}
    for bad in ([60_000], [-1], [None]):
        with pytest.raises(Exception):
            bpe.decode(spark.createDataFrame([(0, bad)], "doc_id long, tokens array<int>")).collect()


def _longest_contexts(rows, asked):
    """(document, length, N, n) of each word but the first of the asked documents, by walking back through all places."""
    words = [(d, t.lower().split()) for d, t in rows]
    places = collections.defaultdict(list)
    for r, (_, ws) in enumerate(words):
        for i in range(1, len(ws)):
            places[ws[i - 1]].append((r, i))
    out = []
    for d, ws in ((d, t.lower().split()) for d, t in asked):
        for i in range(1, len(ws)):
            same, best, length = [(r, j) for r, j in places[ws[i - 1]] if words[r][0] != d], [], 0
            while same:
                best, length = same, length + 1
                same = [(r, j) for r, j in same if i > length and j > length and words[r][1][j - length - 1] == ws[i - length - 1]]
            if length:
                out.append((d, length, len(best), sum(words[r][1][j] == ws[i] for r, j in best)))
            else:
                others = [w for e, t in words if e != d for w in t]
                out.append((d, 0, len(others), others.count(ws[i])))
    return out


@pytest.mark.parametrize("shard,block,round_", [(1 << 21, 1 << 18, 1 << 24), (700, 300, 2000)])
def test_language_model(spark, texts, shard, block, round_):
    rng = random.Random(7)
    # Copies, a very frequent word, words of one document, one id in several rows, rows without an id, and no text.
    rows = [*enumerate(texts[:110]), (60, "w1 " + texts[2]), (61, texts[0]), (None, texts[4]), (None, texts[5] + " w1"), (63, None), (64, "")]
    rows += [(70 + i, " ".join(f"{rng.choice(['The', f'rare{i}x{j} the'])} w{rng.randrange(300)}" for j in range(rng.randint(1, 40)))) for i in [*range(30), *range(9)]]
    plain = [(d, t or "") for d, t in rows]
    asked = [(d, t) for d, t in plain if d is not None and d % 3 == 0] + [(1000, "w1 the unheard w2 of w3"), (1001, texts[3])]
    base = ngramlm.FLOOR / ngramlm.estimate(ngramlm.registers(ngramlm.word_hashes(pa.array(sorted({w for _, t in plain for w in t.lower().split()})))))
    want, longest = {d: [0, 0, 0.0] for d, _ in asked}, 0
    for d, length, every, same in _longest_contexts(plain, asked):
        want[d][0] += 1
        want[d][1] += length > 0
        want[d][2] += math.log((1 - ngramlm.FLOOR) * same / every + base)
        longest = max(longest, length)
    df, queries = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (rows, asked))
    got = {r["doc_id"]: r for r in ngramlm.scores(df, queries, shard, block, round_).collect()}
    assert set(got) == set(want) and longest > 50
    for d, (n, matched, total) in want.items():
        assert (got[d]["words"], got[d]["matched"]) == (n, matched) and got[d]["logprob"] == pytest.approx(total, rel=1e-9)


def test_language_model_query(spark, texts, tmp_path):
    rows = [(10 * k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(d, t) for d, t in rows if d % 50 == 0]
    base = ngramlm.FLOOR / ngramlm.estimate(ngramlm.registers(ngramlm.word_hashes(pa.array(sorted({w for _, t in rows for w in t.split()})))))
    want = collections.Counter()
    for d, _, every, same in _longest_contexts(rows, asked):
        want[d] += math.log((1 - ngramlm.FLOOR) * same / every + base)
    got = {r["doc_id"]: r["logprob"] for r in __spark_entry__.queries()["op9_unbounded_lm"](spark, str(tmp_path)).collect()}
    assert set(got) == {d for d, _ in asked} and all(v == pytest.approx(want[d], rel=1e-9) for d, v in got.items())


def test_language_model_shards(monkeypatch):
    """A place is searched in the shards that hold the three words before it, not in all of them; and all is counted."""
    rng = random.Random(11)
    rows = [(d, " ".join(f"w{rng.randrange(60)}" for _ in range(50))) for d in range(400)]
    rows += [(1001, rows[50][1] + " w1"), (None, "w2 " + rows[100][1]), (150, rows[100][1]), (1003, "once w1"), (1004, "w3"), (1005, "")]
    asked = [(d, t) for d, t in rows if d is not None and d % 50 == 0]
    held, seen, follow = ngramlm.Corpus(), [], ngramlm.Index._followers
    held.add(pa.array([d for d, _ in asked]), pa.array([t for _, t in asked]))
    words, codes, sizes, ids, _ = held.take()
    block = ngramlm.Block(words, codes.astype(np.int64) - 1, sizes.astype(np.int64), ids)
    monkeypatch.setattr(ngramlm.Index, "_followers", lambda self, word, lo, hi: (seen.append(len(word)), follow(self, word, lo, hi))[1])
    monkeypatch.setattr(ngramlm, "_read_blocks", lambda path: iter([(7, block)]))

    class Here:
        @staticmethod
        def mapInArrow(run, schema):
            cuts = [rows[a : a + 20] for a in range(0, len(rows), 20)]
            batches = (pa.RecordBatch.from_arrays([pa.array([d for d, _ in c], pa.int64()), pa.array([t for _, t in c])], names=["doc_id", "text"]) for c in cuts)
            return {b.column(0)[0].as_py(): ngramlm.unpack(b.column(1)[0].as_py()) for b in run(batches)}

    got = ngramlm._found(Here, "", 1000)
    want = _longest_contexts(rows, asked)
    assert [tuple(int(y) for y in x) for x in zip(*got[7])] == [x[1:] for x in want] and {x[1] for x in want} >= {1, 2, 3, 49}
    assert sum(seen) < 3 * len(want)


def test_suffix_array():
    rng = random.Random(9)
    held, rows = ngramlm.Corpus(), []
    for d in range(60):
        rows.append([rng.choice("abc") for _ in range(rng.randint(0, 12))] * rng.randint(1, 3))
    held.add(pa.array(range(60)), pa.array([" ".join(r) for r in rows]))
    index = ngramlm.Index(held)
    back = [index.t[p : p + 40].tolist() for p in index.sa]
    back = [b[: b.index(0)] for b in back]
    assert len(back) == sum(max(len(r) - 1, 0) for r in rows) and back == sorted(back)
    assert (index.isa[index.sa] == np.arange(len(back)) + index.base).all()


def test_language_id(spark):
    vocabulary = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba"]
    m = langid.fit({"x": {"ab": 3, "aba": 2}, "y": {"bb": 4, "bab": 1}}, vocabulary)

    def brute(w, g, i=0):
        if i == len(w):
            return 1.0
        out = sum(m.p[k, g] * brute(w, g, i + len(p)) for k, p in enumerate(vocabulary) if w.startswith(p, i))
        return out + (m.p[len(vocabulary), g] * brute(w, g, i + 1) if w[i] not in vocabulary else 0)

    words = ["ab", "abba", "zab", "bbbab"]
    want = [[math.log(brute("▁" + w, g)) for g in (0, 1)] for w in words]
    assert np.allclose(m.words(words), want) and np.allclose([m._long("▁" + w) for w in words], want)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = langid.identify(docs.filter("doc_id >= 100"), langid.train(docs.filter("doc_id < 100")))
    both = held_out.join(docs.withColumnRenamed("lang", "real").select("doc_id", "real"), "doc_id").collect()
    assert sum(r["lang"] == r["real"] for r in both) >= 0.95 * len(both)


def test_language_id_of_long_words(spark):
    """Words of any length, in training and scoring, against sums in logarithms; one language 1e8 times less likely a letter."""
    rng = random.Random(5)
    vocabulary = ["▁", "a", "b", "ab", "bba", "abab", "c" * 16]
    long = "".join(rng.choice("ab") for _ in range(300))
    m = langid.fit({"x": {"ab": 3, long: 2}, "y": {"bb": 4}, "z": {"c": 1, "ccc" * 20: 5}}, vocabulary)

    def logs(w, p):
        a = [0.0]
        for e in range(1, len(w) + 1):
            terms = [a[e - len(v)] + math.log(p[k]) for k, v in enumerate(vocabulary) if w.endswith(v, 0, e) and e >= len(v)]
            if w[e - 1] not in vocabulary:
                terms.append(a[e - 1] + math.log(p[len(vocabulary)]))
            top = max(terms)
            a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return a[-1]

    words = ["a" * 47, "ü" * 47, "ß" * 200, "".join(rng.choice("abü") for _ in range(50)), "ab" * 2500, "c" * 640, "ccb" * 99, long]
    got = m.words(words)
    for g in range(3):
        assert np.allclose(got[:, g], [logs("▁" + w, m.p[:, g]) for w in words], rtol=1e-9) and np.isfinite(got).all()
    far = langid.Model(m.lattice, ["p", "q"], np.stack([m.p[:, 0], m.p[:, 0] * 1e-8], axis=1), np.zeros(2))
    assert np.allclose(far.words(["ab" * 500])[0], [logs("▁" + "ab" * 500, far.p[:, g]) for g in (0, 1)], rtol=1e-9)
    # Expectation maximisation with a long word, by all its segmentations in turn.
    q, p = np.array([0.1, 0.2, 0.1, 0.3, 0.1, 0.1, 0.1, langid.UNKNOWN]), "▁abbaab"

    def cuts(w):
        if not w:
            yield []
        for k, v in enumerate(vocabulary):
            if w.startswith(v):
                yield from ([k, *rest] for rest in cuts(w[len(v) :]))

    every = [(c, math.prod(q[k] for k in c)) for c in cuts(p)]
    want = np.zeros(len(q))
    for c, x in every:
        np.add.at(want, c, x / sum(y for _, y in every))
    piece, soft = langid._expected(m.lattice, p, q)
    assert np.allclose(np.bincount(piece, weights=soft, minlength=len(q)), want)
    # Equal languages tie: the first by name.
    same = langid.Model(m.lattice, ["k", "l"], np.stack([m.p[:, 0]] * 2, axis=1), np.zeros(2))
    assert {r["lang"] for r in langid.identify(frame(spark, ["ab ba", "ß" * 200]), same).collect()} == {"k"}


def test_toxicity(spark):
    machine = toxicity.Automaton(("idiot", "worthless", "bad"), frozenset({"idiom"}))

    def edits(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(3000):
        term, limit = rng.choice([("idiot", 1), ("worthless", 2), ("bad", 0)])
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            k, q = rng.randrange(len(w) + 1), rng.random()
            if q < 0.3:
                w.insert(k, rng.choice("abiotw"))
            elif q < 0.6 and w:
                w.pop(min(k, len(w) - 1))
            elif w:
                w[min(k, len(w) - 1)] = rng.choice("abiotw")
        word = "".join(w)
        near = [(edits(word, t), t) for t, k in (("idiot", 1), ("worthless", 2), ("bad", 0)) if edits(word, t) <= k]
        got = machine.match(word)
        assert (got is None) == (not near) and (got is None or got[1] == min(near)[0])
    assert machine.match("idiom") is None
    texts = ["You are an idiot and a l0ser", "what an idioot, you stupd clown", 'he said "idiot" in the play', "a friendly text about idioms", "STUPID!!! trash### worthless$$$ " + "word " * 300]
    got = {r["doc_id"] for r in toxicity.toxic(frame(spark, texts)).collect()}
    assert got == {0, 1, 4}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels.filter("doc_id % 2 = 0"))
    found = {r["doc_id"] for r in toxicity.hits(docs, lexicon).filter("toxic").collect()}
    rest = labels.join(docs.filter("lang = 'en'").select("doc_id"), "doc_id").filter("doc_id % 2 = 1").collect()
    bad, good = [r["doc_id"] for r in rest if r["toxic"]], [r["doc_id"] for r in rest if not r["toxic"]]
    assert sum(d in found for d in bad) >= 0.8 * len(bad) and sum(d in found for d in good) <= 0.03 * len(good)


def test_seekable(spark, texts, tmp_path):
    folder = tmp_path / "out"
    manifest = seekable.write(frame(spark, texts), str(folder))
    codec = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})
    # What is there doesn't change with what of the manifest is read, or how often.
    held = sorted(p.name for p in folder.iterdir())
    assert len(manifest.limit(3).collect()) == 3 and manifest.first() and manifest.count() == manifest.count() == len(texts)
    assert sorted(p.name for p in folder.iterdir()) == held and all((folder / r["file"].rsplit("/", 1)[1]).exists() for r in manifest.collect())
    got = {r["doc_id"]: r["tokens"] for r in seekable.read(manifest.filter("doc_id % 3 = 1")).collect()}
    assert set(got) == {d for d in range(len(texts)) if d % 3 == 1} and all(codec.decode(t) == texts[d] for d, t in got.items())
    row = manifest.filter("n_tokens > 20").first()
    raw = bytearray(open(row["file"], "rb").read())
    raw[row["offset"] + row["size"] - 3] ^= 255
    bad = tmp_path / "bad.zst"
    bad.write_bytes(raw)
    with pytest.raises(ValueError):
        seekable.read_frames(str(bad), [row["frame"]])
    assert len(seekable.read_frames(str(bad), [(row["frame"] + 1) % manifest.filter(manifest.file == row["file"]).count()])) == 1
    bad.write_bytes(raw[:-4])
    with pytest.raises(ValueError):
        seekable.read_frames(str(bad), [0])


def test_seekable_wide_ids_nulls_and_failures(spark, tmp_path):
    rows = [(1, "a text of words"), (1, "a text of words"), (2, None), (3, ""), (None, "no id"), (4, "\u65e5\u672c \U0001f642" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ranks = {bytes([k]): k for k in range(256)} | {b"te": 70_000, b"xt": 70_001}
    vocabulary = tmp_path / "wide.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    manifest = seekable.write(df, str(tmp_path / "wide"), str(vocabulary))
    assert {r["width"] for r in manifest.collect()} == {4}
    codec = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r["doc_id"], r["tokens"]) for r in seekable.read(manifest).collect()), key=str)
    assert got == sorted(((d, None if t is None else codec.encode_ordinary(t)) for d, t in rows), key=str)

    # A task that fails in the middle leaves nothing behind.
    def broken(batches):
        for k, b in enumerate(batches):
            yield b
            raise ValueError("lost")

    with pytest.raises(Exception):
        seekable.write(df.mapInArrow(broken, df.schema), str(tmp_path / "lost"))
    assert not [p for p in (tmp_path / "lost").glob("*.zst")]


def test_queries_and_pipeline(spark):
    names = __spark_entry__.queries()
    assert sorted({n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}) == sorted(f"op{k}" for k in range(1, 11))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in repetition.annotate(docs).filter("keep").collect()}
    gone = {r["doc_id"] for r in bagminhash.duplicates(docs.filter(docs.doc_id.isin(*kept))).collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) <= kept - gone and all(r["round_trip"] for r in out.values())
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in kept - gone if not any(i in " ".join(texts[d].lower().split()) for i in items)}
    codec, cut = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={}), 0
    for d in clean:
        if d not in out:
            cut += 1  # all of it stands in an earlier document
        elif codec.decode(out[d]["tokens"]) != texts[d]:
            cut += 1
    assert cut <= 0.2 * len(clean)
