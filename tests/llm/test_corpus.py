"""Every operator against brute force on small tables, with the awkward cases in them."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import attention, bpe, chat, encoding, neardup, neighbours, packing, quality, scoring, substring, toxicity, wavelet
from graphloom.llm import textcore as tc
from graphloom.llm.shared import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCAB = ["".join(rng.choice(["an", "the", "or", "é", "ing", "x", "日本", "Z"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
words = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
BASE = words(60)
LONG = words(30000)
TEXTS = [BASE, None, "", " \n\t ", LONG, BASE, words(20) + " " + BASE[:200] + " " + words(20), BASE.replace("the", "teh", 1), "one", "don't  we'll\n\nI'M 12 ½", "a\n" * 30, "<|endoftext|> z", words(200), words(200), "&&& ### $$$ " * 20, "x" * 3000]
ROWS = [(i, t, 0.5, "s", 7) for i, t in enumerate(TEXTS)] + [(None, BASE, 0.1, None, 1), (6, TEXTS[6], 0.2, "s", 2), (100, words(50) + " " + LONG[5000:9000], 0.0, "s", 3)]
DDL = "doc_id long, text string, score double, ids string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def rows(df, *by):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str([r[b] for b in by]))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


TRICKY = TEXTS + ["'s 's's 'llama x'd  's \n's", "ΑΣ ΣΑ İstanbul Ⅷ ½ é é １２ a\x85c \x1c\x1d", "  a  b\n\n c \n", "日本語🎉🎉 x", "''s 're", "é" * 300 + "a" * 700, "tab\t\tend "]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_bpe_equals_the_library(path):
    enc, t = bpe.encoder(path), library(path)
    raw = [(x or "").encode() for x in TRICKY]
    ids, off = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for x, a, b in zip(TRICKY, off[:-1], off[1:], strict=True):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, x
        assert enc.decode(ids[a:b]) == t.decode(want, skip_special_tokens=False).encode(), x


def test_encode_and_decode(docs, empty):
    out = rows(encoding.encode(docs, WORDS, ("n_tokens", "ids", "decoded", "ids_sha256")), "doc_id", "n_tokens")
    assert len(out) == len(ROWS) and encoding.encode(empty, WORDS).count() == 0
    for r in out:
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
    e = encoding.encode(docs.filter("doc_id = 9"), BYTES)
    assert encoding.decode(e, BYTES).first()["text"] == TEXTS[9]


def test_packing(docs, empty):
    out = packing.pack(docs, WORDS, window=512, keep_ids=True).collect()
    t = library(WORDS)
    assert packing.pack(empty, WORDS).count() == 0
    seq, tokens = collections.defaultdict(list), collections.Counter()
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    padding = 0
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
        padding += 0 if at & (at - 1) == 0 else 512 - at
    want = collections.Counter()
    for i, x, *_ in ROWS:
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert tokens == want and padding == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 5000)
    m = wavelet.WaveletMatrix.build(ids, 9)
    assert (m.all() == ids).all() and (m.access(np.arange(0, 5000, 7)) == ids[::7]).all()
    for s in (0, 5, 299, 400):
        where = np.flatnonzero(ids == s)
        assert m.count(s, 100, 4000) == ((where >= 100) & (where < 4000)).sum() and (m.locate(s) == where).all()
    got, names, lengths = wavelet.load(wavelet.dump(m, [3, None], np.array([4000, 1000])))
    assert (got.all() == ids).all() and names == [3, None] and lengths.tolist() == [4000, 1000]


def test_wavelet_files(docs, empty):
    t = library(BYTES)
    man = wavelet.write_shards(docs.filter("doc_id is not null and doc_id <> 6"), BYTES, wavelet.new_folder(docs), shard_tokens=5000)
    got, at = sorted(wavelet.read_shards(man).collect()), 0
    for r in got:
        ids = t.encode(dict((i, x) for i, x, *_ in ROWS)[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(docs, BYTES, wavelet.new_folder(docs))).count() == len(ROWS)
    assert wavelet.read_shards(wavelet.write_shards(empty, BYTES, wavelet.new_folder(docs))).count() == 0


def cut_by_hand():
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, x, *_ in ROWS:
        w = SPLIT.findall(x or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, x, *_ in ROWS:
        w, gone = SPLIT.findall(x or ""), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(y for k, y in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring(docs, empty):
    got = sorted((tuple(r) for r in substring.dedup(docs).collect()), key=str)
    assert got == cut_by_hand()
    assert substring.dedup(empty).count() == 0
    cut = substring.dedup_text(docs)
    assert cut.columns == docs.columns
    left = {(r["doc_id"], len(SPLIT.findall(r["text"] or ""))) for r in cut.collect()}
    assert left == {(i, n - m) for i, n, m, _ in got}


def test_byte_planes_of_many_cells():
    """All cells in one call, each laid out as if it were alone, and read back; empty cells among them."""
    r = np.random.default_rng(8)
    size = r.integers(0, 4, 20000)
    a, b = r.integers(-(1 << 40), 1 << 40, int(size.sum())), r.integers(0, 1 << 16, int(size.sum()))
    cells = substring._planes([(a, "<i8"), (b, "<u2")], size)
    edge = np.concatenate([[0], np.cumsum(size)])
    for c in range(0, 20000, 977):
        i, j = edge[c], edge[c + 1]
        alone = b"".join(x[i:j].astype(k).view(np.uint8).reshape(j - i, int(k[2])).T.tobytes() for x, k in ((a, "<i8"), (b, "<u2")))
        assert cells[c].as_py() == alone
    for held in (cells, pa.chunked_array([cells[:0], cells[:7000], cells[7000:]])):
        (x, y), n = substring._unplanes(held, ["<i8", "<u2"])
        assert np.array_equal(x, a) and np.array_equal(y, b) and np.array_equal(n, size)
    assert substring._planes([(a[:0], "<i8")], size[:0]).to_pylist() == [] and substring._planes([(a[:0], "<i8")], size[:3] * 0).to_pylist() == [b""] * 3


def test_nothing_repeats(spark):
    made = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(6)]
    assert [r["n_removed"] for r in substring.dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()] == [0] * 6


def test_quality(docs, empty, tmp_path):
    import duckdb

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    cur = c.execute(quality.SQL)
    names = [x[0] for x in cur.description]
    judged = quality.judge(quality.ledger(docs)).select(*names)
    assert sorted(map(tuple, judged.collect()), key=str) == sorted(cur.fetchall(), key=str)
    kept = {r["doc_id"] for r in judged.filter("kept").collect()}
    assert {r["doc_id"] for r in quality.accept(docs).collect()} == kept and quality.accept(docs).columns == docs.columns
    ab = {r["rule"]: r for r in quality.ablate(quality.ledger(docs)).collect()}
    bits = [r["failed_bits"] for r in judged.collect()]
    assert ab["few_words"]["n_failed"] == sum(b & 1 for b in bits) and ab["few_words"]["n_only"] == bits.count(1)
    assert quality.union_and_common(quality.ledger(docs)).first()["n"] == len(ROWS)
    assert quality.ledger(empty).count() == 0


def test_toxicity(spark, docs, empty):
    bad, data, labels = ["idiot", "Scum!", "moron"], [], []
    r = random.Random(3)
    for i in range(600):
        y = int(r.random() < 0.3)
        w = [r.choice(VOCAB) for _ in range(40)] + ([r.choice(bad), r.choice(bad)] if y else [])
        r.shuffle(w)
        data.append((i, " ".join(w)))
        labels.append((i, y))
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.train(d, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, m).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i][1] for i in held]) > 0.97
    assert toxicity.reject(d, m).count() == sum(s < 0.5 for s in got.values())
    out = toxicity.score(docs, m).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, m).count() == 0
    none = toxicity.train(d, lab.limit(0))
    assert {round(r["score"], 3) for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_sample_stays_off_the_driver(spark, monkeypatch):
    """The fit reads its sample in parts from the shared folder: none of it goes through the driver's JVM, and parts change nothing."""
    r = random.Random(6)
    d = spark.createDataFrame([(i, " ".join(["bad"] * (i % 3 == 0) + [r.choice(VOCAB) for _ in range(30)])) for i in range(900)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    whole, plain = [], toxicity._fit

    def both(parts, label, **options):
        made = list(parts())
        assert len(made) > 1
        whole.append(toxicity.fit(np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made]), label, **options))
        return plain(parts, label, **options)

    def refused(*_, **__):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(toxicity, "_fit", lambda parts, label, *a, **o: both(parts, label, **o) if not whole and not a else plain(parts, label, *a, **o))
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(d), name, refused)
    m = toxicity.train(d, lab)
    assert len(m.buckets)
    for name in ("buckets", "weight", "factor"):
        assert np.array_equal(getattr(m, name), getattr(whole[0], name))
    assert m.bias == whole[0].bias


def test_toxicity_scores_by_hand(spark):
    """Scores of the query's rule recomputed from the machine, one document and one pair of terms at a time."""
    r = random.Random(4)
    data = [(i, " ".join(["Bad!"] * (i % 3 == 0) + [r.choice(VOCAB) for _ in range(30)])) for i in range(150)] + [(200, None), (201, ""), (202, LONG[:4000]), (200, None)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    m = toxicity.train(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int"))
    at = {b: k for k, b in enumerate(m.buckets.tolist())}

    def one(word):
        return toxicity.terms(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0].tolist()

    for row in toxicity.score(d, m).collect():
        x = dict(data)[row["doc_id"]] or ""
        t = sorted({at[b] for w in SPLIT.findall(x) for b in one(w) if b in at})
        z = m.bias + sum(m.weight[i] for i in t) + sum(float(m.factor[i] @ m.factor[j]) for k, i in enumerate(t) for j in t[:k])
        assert abs(row["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and row["n_terms"] == len(t)


def test_pairs_that_are_harmless_alone():
    r = np.random.default_rng(1)
    a, b = r.random(4000) < 0.5, r.random(4000) < 0.5
    sets = [sorted({*r.integers(100, 400, 20).tolist(), *([1] * x), *([2] * y)}) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    doc, term = np.repeat(np.arange(4000), [len(s) for s in sets]), np.concatenate(sets)
    m = toxicity.fit(doc, term, (a ^ b).astype(float))
    at = np.full(1 << toxicity.BITS, -1)
    at[m.buckets] = np.arange(len(m.buckets))
    k = at[term]
    assert ((m.score(doc[k >= 0], k[k >= 0], 4000) >= 0.5) == (a ^ b)).mean() > 0.99
    assert not len(toxicity.pair_terms(doc, term, r.permutation((a ^ b).astype(float)), np.bincount(term, minlength=1 << toxicity.BITS), 4000))


def near_by_hand():
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    texts = {i: x for i, x, *_ in ROWS if i is not None and SPLIT.findall(x or "")}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {}
    for t, i in first.items():
        w = SPLIT.findall(low(t))
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2)))
        sets[i] = {(g, k) for g, n in c.items() for k in range(n)}
    root, links = {i: i for i in sets}, collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.45 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i: (root[first[texts[i]]], first[texts[i]], links[first[texts[i]]]) for i in texts}


def test_near_duplicates(spark, docs, empty):
    want = near_by_hand()
    got = neardup.classes(docs).collect()
    assert len(got) == len(ROWS) and neardup.classes(empty).count() == 0
    for r in got:
        assert (r["class_id"], r["copy_of"], r["n_links"]) == want.get(r["doc_id"], (r["doc_id"], r["doc_id"], 0))
    kept = neardup.first_of_class(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted([str(i) for i in range(16) if want.get(i, (i,))[0] == i] + ["None", "100"])


def test_large_components_are_parted(monkeypatch, spark):
    monkeypatch.setattr(neardup, "LARGE", 2)
    monkeypatch.setattr(neardup, "WIDE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r = random.Random(1)
    base = [r.choice(VOCAB) for _ in range(80)]
    made = []
    for i in range(12):
        w = list(base)
        w[r.randrange(80)] = f"edit{i}"
        made.append((i, " ".join(w)))
    got = neardup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {11}


@pytest.mark.parametrize("loose", [0.0, 0.3])
def test_a_hot_band_and_the_exact_way(spark, monkeypatch, loose):
    """A third of all texts share a line and so bands; links and classes against all pairs, with large components parted or not."""
    monkeypatch.setattr(neardup, "LARGE", 8)
    r = random.Random(21)
    line, made = [r.choice(VOCAB) + str(i) for i in range(40)], []
    for i in range(90):
        own = [r.choice(VOCAB) + str(r.randrange(10**6)) for _ in range(20)]
        made.append((i, " ".join(line + own if i % 3 == 0 else own * 2)))
    sets = {i: collections.Counter(zip(w, w[1:], w[2:])) for i, w in ((i, t.lower().split()) for i, t in made)}
    links = collections.Counter()
    for i in sets:
        for j in sets:
            both, every = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            links[i] += i != j and both >= 0.45 * every
    got = {x["doc_id"]: x for x in neardup.classes(spark.createDataFrame(made, "doc_id long, text string"), loose=loose).collect()}
    assert {i: x["n_links"] for i, x in got.items()} == {i: links[i] for i in sets}
    assert all(x["class_id"] == (0 if i % 3 == 0 else i) for i, x in got.items())


@pytest.mark.parametrize("part", [1 << 19, 40])
def test_components_take_few_rounds(spark, monkeypatch, part):
    """Long chains against union by hand, in few tables written; in small parts too, which only take longer."""
    from graphloom.llm import components

    r, n, made = random.Random(12), 600, []
    monkeypatch.setattr(components, "PART", part)
    monkeypatch.setattr(components, "written", lambda df, plain=components.written: made.append(1) or plain(df))
    name = r.sample(range(10**6), n)
    pairs = [(name[i], name[i + 1]) for i in range(n - 1) if i % 200 != 199]
    r.shuffle(pairs)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {name[i]: min(name[i // 200 * 200 : i // 200 * 200 + 200]) for i in range(n)}
    assert part == 40 or len(made) <= 3


def test_registers_estimate_similarity():
    e = tc.mix(np.arange(1, 301, dtype=np.uint64))
    a, b = e[:200], e[100:300]
    s = neardup.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), np.ones(400), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.05


def _words_by_hand():
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    c = collections.Counter()
    for i, x, *_ in ROWS:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update([*SPLIT.findall(low(x)), None])
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, x, *_ in ROWS:
        w = [*SPLIT.findall(low(x)), None]
        want[i].append((len(w), sum(c[y] > 0 for y in w), round(sum(math.log10((c[y] + 0.1) / (n + 0.1 * (v + 1))) for y in w), 4)))
    return n, {k: sorted(x) for k, x in want.items()}


def _log_two_powers(x):
    """log of two to the x, linear between whole powers."""
    k = np.floor(x)
    return np.log(2.0) * k + np.log1p(x - k)


def _score_by_hand(m, classes, inside, ids, begin, end):
    """One document, one target at a time, in float64 and plain loops."""
    seq, targets, d, total = [begin, *ids], [*ids, end], m.wq.shape[0], 0.0
    for t, target in enumerate(targets):
        k = 0 if t < attention.WINDOW else -(-(t + 1 - attention.WINDOW) // attention.STRIDE)
        first = k * attention.STRIDE
        x = [m.embed[seq[j], :d].astype(float) + m.place[j - first, :d] for j in range(first, t + 1)]
        own = [_log_two_powers((x[-1] @ m.wq) @ (y @ m.wk) / math.sqrt(d)) for y in x]
        a = np.exp(own)
        state = x[-1] + (a[:, None] * np.array([y @ m.wv for y in x])).sum(0) / a.sum() @ m.wo
        w = np.array([_log_two_powers(z) for z in state @ m.out[:d] + m.out[d]])
        total += w[classes[target]] - np.log(np.exp(w).sum()) + inside[target]
    return total / math.log(10)


def test_scoring(docs, empty, monkeypatch):
    made, learn = {}, scoring._learn
    monkeypatch.setattr(scoring, "_learn", lambda *x: made.update(model=learn(*x)) or made["model"])
    got = scoring.score(docs, WORDS).collect()
    assert len(got) == len(ROWS)
    n, want = _words_by_hand()
    have = collections.defaultdict(list)
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        have[r["doc_id"]].append((r["n_tokens"], r["n_known"], round(r["base_score"], 4)))
    assert {k: sorted(x) for k, x in have.items()} == want
    t, texts, ids = library(WORDS), dict((i, x) for i, x, *_ in ROWS if i != 6), scoring.Ids.of(bpe.encoder(WORDS))
    for r in got:
        x = texts.get(r["doc_id"])
        if r["doc_id"] in texts and len(x or "") < 3000:
            assert abs(r["score"] - _score_by_hand(*made["model"], t.encode(x or "", add_special_tokens=False).ids, ids.begin, ids.end)) < 0.02, r
    assert scoring.score(empty, WORDS).count() == 0
    assert all(r["score"] < 0 and r["train_tokens"] == 0 for r in scoring.score(docs.filter("doc_id is null"), WORDS).collect())
    assert len(scoring.score(docs.filter("doc_id < 4"), BYTES).collect()) == 4


def test_scoring_learns_from_every_unit(docs, monkeypatch):
    """Counts, contexts and training windows against all training documents, gathered one by one; units of a few documents."""
    seen, trained, monkey = {}, [], monkeypatch.setattr
    monkey(scoring, "SLICE", 2000)
    monkey(scoring, "UNITS", 2)
    cluster, learn = attention.cluster, scoring._learn
    monkey(attention, "cluster", lambda c, n, *x: seen.update(ctx=c, counts=n) or cluster(c, n, *x))

    def keep(spread, ids, windows, *x):
        for r in spread.collect():
            w = attention.windows_of(*scoring._training(scoring.unpacked(scoring.read_bytes(r["unit"]))), ids.begin, ids.end)
            trained.append(w)
        assert windows == sum(map(len, trained)) and spread.rdd.getNumPartitions() > 2
        return learn(spread, ids, windows, *x)

    monkey(scoring, "_learn", keep)
    assert scoring.score(docs, WORDS).count() == len(ROWS)
    enc, ids = bpe.encoder(WORDS), scoring.Ids.of(bpe.encoder(WORDS))
    counts, ctx, rows = np.zeros(ids.size, np.int64), np.zeros((ids.size, 2 * attention.MARKS), np.int64), []
    mark = np.random.default_rng(9).integers(0, attention.MARKS, ids.size)
    for i, x, *_ in ROWS:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            own = enc.encode(np.frombuffer((x or "").encode(), np.uint8), np.array([0, len((x or "").encode())]))[0].tolist()
            np.add.at(counts, [*own, ids.end], 1)
            for a, b in zip(own[:-1], own[1:], strict=True):
                ctx[b, mark[a]] += 1
                ctx[a, attention.MARKS + mark[b]] += 1
            seq = [ids.begin, *own, ids.end]
            for k in range(0, len(seq) - 1, attention.WINDOW):
                w = seq[k : k + attention.WINDOW + 1]
                rows.append(w + [attention.PAD] * (attention.WINDOW + 1 - len(w)))
    assert (seen["counts"] == counts).all() and (seen["ctx"] == ctx).all()
    assert sorted(np.concatenate(trained).tolist()) == sorted(rows)


def test_attention_is_a_causal_distribution():
    m = attention.Model.start(50, np.full(5, 0.2))
    ids = np.random.default_rng(0).integers(0, 50, (2, 8))
    z = attention.hidden(m, ids)[-1].reshape(2, 8, -1)
    other = ids.copy()
    other[:, 5:] = 1
    assert np.allclose(attention.hidden(m, other)[-1].reshape(2, 8, -1)[:, :5], z[:, :5], atol=1e-5)
    total = sum(np.exp(attention.class_log(m, z.reshape(16, -1), np.full(16, c))) for c in range(5))
    assert np.allclose(total, 1, atol=1e-4)
    off = np.array([0, 3, 40, 140])
    begin, length, fresh = attention.placed(off)
    hit = np.zeros(140, int)
    for b, n, f in zip(begin, length, fresh, strict=True):
        hit[b + f : b + n] += 1
    assert (hit == 1).all()


def test_gradients():
    r = np.random.default_rng(2)
    m = attention.Model.start(20, np.full(4, 0.25))
    ids, cls, live = r.integers(0, 20, (3, 6)), r.integers(0, 4, (3, 6)), np.ones((3, 6), bool)
    _, g = attention.gradients(m, ids, cls, live)
    g["embed"] = np.stack([g["embed"].reshape(3, 6, -1)[ids == i].sum(0) for i in range(20)])
    for name in ("wq", "wk", "wv", "wo", "out", "place", "embed"):
        a, at = getattr(m, name), (1, 1)
        old = a[at]
        a[at] = old + 1e-2
        up = attention.gradients(m, ids, cls, live)[0]
        a[at] = old - 1e-2
        down = attention.gradients(m, ids, cls, live)[0]
        a[at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 5e-4, name


def test_training_lowers_the_loss():
    r = np.random.default_rng(3)
    ids = np.cumsum(r.integers(1, 3, 6000)) % 40  # the next id is one of two
    w = attention.windows_of(ids, np.array([0, 3000, 6000]), 40, 41)
    assert (w != attention.PAD)[:, 1:].sum() == 6002
    m = attention.Model.start(42, np.full(42, 1 / 42))
    classes = np.arange(42)
    before = attention.gradients(m, w[:50, :-1].astype(np.int64), classes[w[:50, 1:].astype(np.int64)], np.ones((50, attention.WINDOW), bool))[0]
    assert attention.train(m, w, classes, 41, epochs=40) < 1.2 < before


def _chat_sql(data):
    import duckdb

    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", data)
    cur = c.execute(chat.SQL)
    return [x[0] for x in cur.description], sorted(cur.fetchall(), key=str)


def _rendered(said, me):
    """One dialogue and the ranges to learn from, message by message."""
    out, mask = "", []
    for _, role, x in said:
        who = "system" if role == "system" else "assistant" if role == me else "user" if role is None else f"user name={role}"
        out += f"<|im_start|>{who}\n"
        if role == me:
            mask.append(f"{len(out)}-{len(out) + len(x or '') + 10}")
        out += f"{x or ''}<|im_end|>\n"
    return out, ",".join(mask)


def test_chat(spark):
    data = [(1, 0, "system", "be"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 2, "ann", "x"), (1, 2, "ann", "x"), (1, 200, "cid", LONG), (None, 0, "ann", "lost"), (2, None, "bob", "when"), (2, 1, None, "who"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*x, 1) for x in data], "conv_id long, turn long, role string, text string, mask int")
    got = chat.rotate(df)
    names, want = _chat_sql(data)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
    r = got.filter("conv_id = 1 and perspective = 'ann'").first()
    for span in r["mask"].split(","):
        a, b = map(int, span.split("-"))
        assert r["text"][a:b] in ("hi é<|im_end|>", "x<|im_end|>")
    assert chat.rotate(df.limit(0)).count() == 0


def test_a_dialogue_in_parts_is_whole(spark, monkeypatch):
    """A third of all messages in one conversation, parts and their sums smaller than it; the parts together against one rendering."""
    monkeypatch.setattr(chat, "SUPER", 3)
    r = random.Random(8)
    low = lambda x: (x is not None, "" if x is None else x)
    data = [(c, r.choice([None, *range(70)]), r.choice(["ann", "bob", "system", None, "zoë"]), f"t{r.random()}") for c in (1, None) for _ in range(300)] + [(i, 0, "ann", "only") for i in range(2, 300)]
    got = chat.rotate(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5), limit=25).collect()
    whole = collections.defaultdict(list)
    for g in sorted(got, key=lambda g: g["part"]):
        whole[g["conv_id"], g["perspective"]].append(g)
    assert len(got) > 90 and set(whole) == {(c, m) for c in (1, None) for m in ("ann", "bob", "zoë")} | {(i, "ann") for i in range(2, 300)}
    for (c, me), parts in whole.items():
        said = sorted(((t, role, x) for k, t, role, x in data if k == c), key=lambda m: ((m[0] is not None, m[0] or 0), low(m[1]), m[2]))
        text, mask = _rendered(said, me)
        assert "".join(p["text"] for p in parts) == text and ",".join(filter(None, (p["mask"] for p in parts))) == mask
        assert [p["start"] for p in parts] == [0, *np.cumsum([p["n_chars"] for p in parts])[:-1]] and all(p["n_messages"] <= 25 for p in parts)


def test_neighbours(spark, empty):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16))
    x[50:90] = x[50]  # a group of copies
    data = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(700, None, 1.0), (701, [0.0] * 16, 1.0), (702, [float("nan")] * 16, 1.0), (703, [1.0], 1.0), (None, x[0].tolist(), 1.0), (704, [None] * 16, 1.0), (10, x[10].tolist(), 1.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double")
    got = collections.defaultdict(list)
    for row in neighbours.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits += len(set(want.tolist()) & {v for v, _ in got[q]})
        total += 5
        assert len(got[q]) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in got[q])
    assert hits / total >= 0.9 and [v for v, _ in got[50]] == [51, 52, 53, 54, 55]
    assert set(got) == set(range(0, 600, 50))
    few = neighbours.search(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert len(few) == 2
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_search_enters_buckets():
    """At the fitted radius probes meet a part of the rows, and nearly all true neighbours."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 64))
    x = centre[r.integers(0, 40, 9000)] + r.normal(size=(9000, 64))
    coder = neighbours.fit(x[::3])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = coder.codes(unit)
    index, hits = neighbours.MultiIndex(codes, coder), 0
    for q in range(0, 9000, 90):
        s = unit @ unit[q]
        hits += len(set(np.argsort(-s)[1:6].tolist()) & set(index.within(codes[q], coder.radius, coder.far).tolist()))
    assert index.met < 0.5 * 100 * 9000 and hits >= 0.95 * 500


def test_radius_reaches_past_a_group_of_the_lowest_ids():
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(size=32) + 1e-3 * r.normal(size=(600, 32)), r.normal(size=(1200, 32))])
    coder = neighbours.fit(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = np.arange(600, 1800, 7)
    s = unit[rest] @ unit.T
    s[np.arange(len(rest)), rest] = -9
    codes = coder.codes(unit)
    index = neighbours.MultiIndex(codes, coder)
    met = [len(np.intersect1d(index.within(codes[i], coder.radius, coder.far), np.argsort(-s[k])[:5])) for k, i in enumerate(rest)]
    assert np.mean(met) > 0.95 * 5


def test_multi_index_probing_meets_all():
    r = np.random.default_rng(6)
    c = neighbours.fit(r.normal(size=(3000, 16)), rotations=2)
    codes = c.codes(r.normal(size=(3000, 16)))
    index = neighbours.MultiIndex(codes, c)
    for radius in (0, 3, 6, 9, 32):
        for q in range(0, 3000, 400):
            want = np.flatnonzero(neighbours.distances(codes[q][None, :], codes)[0] <= radius)
            assert (index.within(codes[q], radius) == want).all()


def test_clashing_columns(spark):
    """Columns with the names that operators use on their way, with Spark's own hidden one, and one that differs in case only from another."""
    ddl = "doc_id long, text string, `_metadata` string, `__from_file` string, `__from_row` long, terms string, block long, `__salt` int"
    data = [(i, t, "m", "f", 1, "t", 2, 3) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(data, ddl)
    cut = substring.dedup_text(df)
    assert cut.columns == df.columns and cut.count() == len(data) and {r["_metadata"] for r in cut.collect()} == {"m"}
    kept = neardup.first_of_class(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(data)
    assert quality.accept(df).columns == df.columns and toxicity.reject(df, toxicity.train(df, df.select("doc_id", df["__salt"].alias("toxic")))).columns == df.columns
    assert scoring.score(df, WORDS).count() == neardup.classes(df).count() == substring.dedup(df).count() == packing.pack(df, WORDS).select("doc_id").distinct().count() == len(data)


def test_queries_return_their_contract(spark, tmp_path):
    """Every registered query on small tables: names, types, and the columns that a query derives."""
    from graphloom.llm import queries

    r = random.Random(2)
    base = [(i, f"{words(30)} {'idiot' * (i % 4 == 0)}", "en", "s", 1) for i in range(60)] + [(60, None, None, None, None), (61, "", "en", "s", 0)]
    spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, i, "ann", "x") for i in range(4)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(16)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {
        "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op2_neardup": "doc_id bigint, class_id bigint, n_links bigint",
        "op3_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op7_wavelet": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op8_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op9_chat": "conv_id bigint, perspective string, text string, mask string",
        "op10_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    }
    got = queries.queries()
    assert set(got) == set(want)
    for name, ddl in want.items():
        df = got[name](spark, str(tmp_path))
        kinds, out = dict(df.dtypes), df.collect()
        assert all(kinds[c] == k for c, k in (x.split() for x in ddl.split(", "))), name
        if name == "op10_neighbours":
            assert len(out) == 15
        elif name == "op9_chat":
            assert len(out) == 1
        else:
            assert {x["doc_id"] for x in out} == set(range(62)), name
        if name == "op1_toxicity":
            assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and x["predicted"] == (x["score"] >= 0.5) for x in out)


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_on_empty_and_awkward_tables(spark, tmp_path, rows):
    """Each stage alone: no rows; null texts and ids, ties, a very long text, and columns of clashing names, all of which stay."""
    import corpus_pipeline

    data = [(1, LONG, "en", None, None, "m", 1), (2, LONG, "en", "s", 1, "m", 2), (None, None, None, None, None, None, None)][:rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, `_metadata` string, block long"
    spark.createDataFrame([(1, 1, 0)][:rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(data, ddl)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        n = out.count()
        assert n == 0 if not rows else n == {"toxicity": 3, "quality": n, "near duplicates": 2, "repeated passages": 3, "packing": n}[name], name
        assert stage.__doc__


def test_pipeline(spark, tmp_path):
    """The stages against the same decisions made one document at a time."""
    import corpus_pipeline

    r = random.Random(9)
    clean = lambda: " ".join(r.choice(VOCAB) + str(r.randrange(400)) for _ in range(60))
    shared, data, labels = " ".join(f"w{i}" for i in range(60)), [], []
    for i in range(200):
        t, y = clean(), int(i % 5 == 0)
        data.append((i, t + " idiot scum" * y, "en", "s", 0))
        labels.append((i, 1, y))
    data += [(300, shared + " " + clean(), "en", "s", 0), (301, clean() + " " + shared + " " + clean(), "en", "s", 0), (302, data[1][1], "en", "s", 0), (303, "too few", "en", "s", 0), (304, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x["doc_id"] for x in out}
    assert kept == {i for i in range(200) if i % 5} | {300, 301}
    t = library(WORDS)
    left = data[201][1].replace(shared + " ", "")
    n = next(x["doc_tokens"] for x in out if x["doc_id"] == 301)
    assert n == len(t.encode(left, add_special_tokens=False).ids) + 1
    assert sum(x["length"] for x in out) == sum({x["doc_id"]: x["doc_tokens"] for x in out}.values())
