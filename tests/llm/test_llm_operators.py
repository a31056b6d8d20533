"""Each operator against a brute-force version, the library it must equal, or an exact round trip."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.llm import audio, bpe, jaccard, lines, mixing, quality, search, substring, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    """rows: (id, text) or (id, text, source). The columns that clash with results are there on purpose."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("n_tokens", "size", "copies", "keep", "doc", "token", "component", "_line", "_lines", "_h", "_hash", "_key", "_bytes", "bytes", "of", "limit", "_maybe", "maybe", "_mix_room", "_mix_block", "_shard", "_copy", "code", "n_lines", "n_removed", "words", "term"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, tied, repeated and very long texts."""
    rng = random.Random(3)
    long = sentence(rng, 60_000)
    shared = sentence(rng, 70)
    texts = [None, "", "   \n\t ", "one", "one", "ONE", shared, f"before {shared} after", f"{shared} {shared}", "x" * 20_000, long, long + " more", "a\n\nb\r\n c  d", "\x00é　ß 日本 😀 ▁ <s> <|endoftext|>"]
    return list(enumerate(texts)) + [(len(texts), shared), (len(texts), shared)]


def test_token_counts(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(frame(spark, odd), limit=50).collect()
    want = sorted((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in odd)
    assert sorted(map(tuple, got)) == want
    assert token_counts.token_counts(frame(spark, odd[:0])).count() == 0


def test_transducer_over_chunks_and_full_tables():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = list(token_counts.transducer(P.path("piece_bpe_32k.model")).scores.items())
    rng = random.Random(1)
    letters = "ab th e  in  \n\t▁=-/*éüñß中文日本😀\x00AZ109<>x"
    texts = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(3000)] + ["=" * k + " " * k for k in range(120)] + ["x" * 5000, ""]
    want = [len(x) for x in sp.encode(texts)]
    for lanes, entries in ((1, 1 << 22), (7, 1 << 22), (512, 1 << 22), (64, 96 * 200)):  # the last empties its table again and again
        assert token_counts.Transducer(pieces, entries, lanes).count(texts).tolist() == want


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = bpe.byte_pairs(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    letters = "ab th e  in  \n\t▁=-/*éüñß中文日本😀\x00AZ109<>x'sll \xa0\x1c "
    for x in ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(5000)] + ["<|endoftext|>a<|endoftext|>", "I'll don't\n\n x"]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert coder.encode(x) == ids and coder.decode(ids) == t.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(frame(spark, odd), with_ids=True).collect()}
    for i, x in odd:
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"], r["ids"]) == (len(ids), sha(",".join(map(str, ids))), sha(x or ""), x or "", ids)
    assert bpe.bpe_round_trip(frame(spark, odd[:0])).count() == 0


def links(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, base, count, most):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, odd, width, percent):
    rng = random.Random(4)
    base = sentence(rng, 120, 5000)
    texts = copies(rng, base, 150, 12)  # many link with no pivot, only with copies of their own
    texts += [c for t in texts[:25] for c in copies(rng, t, 2, 3)]
    texts += [" ".join(base.split()[k:]) for k in range(0, 60, 6)]
    texts += [sentence(rng, rng.randrange(1, 30), 6) for _ in range(40)] + [sentence(rng, 60) for _ in range(20)]
    rng.shuffle(texts)
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    got = jaccard.jaccard_components(frame(spark, [*rows, (None, "one")]), width, percent)
    want = links(rows, width, percent)
    found = got.collect()
    assert {(r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None} == {(i, c) for i, (_, c) in want.items()}
    assert all(r["n_shingles"] == want[r["doc_id"]][0] for r in found if r["doc_id"] is not None)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    kept = {r["doc_id"] for r in jaccard.one_of_each(frame(spark, rows), got).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}
    assert jaccard.jaccard_components(frame(spark, odd[:0])).count() == 0


def test_jaccard_dealt_in_parts(spark, monkeypatch):
    """Frequent tokens of one holder in one part, in many, and each by itself give equal classes, those of brute force."""
    rng = random.Random(14)
    base = sentence(rng, 100, 5000)
    rows = list(enumerate(copies(rng, base, 120, 14) + [" ".join(base.split()[k:]) for k in range(0, 40, 5)]))
    want = {(i, c) for i, (_, c) in links(rows, 5, 80).items()}
    for most, least in ((10**6, 2), (300, 2), (300, 10**6)):
        monkeypatch.setattr(jaccard, "MOST_DEALT", most)
        monkeypatch.setattr(jaccard, "DEALT", least)
        got = jaccard.jaccard_components(frame(spark, rows), 5, 80).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == want
    tokens, counts = np.arange(1, 1001, dtype=np.uint64), np.full(1000, 50)
    parts = np.unique(jaccard.dealt(tokens, counts, np.zeros(1000, np.int64)), return_counts=True)[1]
    assert len(parts) == 1000  # each by itself, as none is frequent
    monkeypatch.setattr(jaccard, "DEALT", 2)
    monkeypatch.setattr(jaccard, "MOST_DEALT", 10_000)
    assert len(np.unique(jaccard.dealt(tokens, counts, np.zeros(1000, np.int64)))) == 6


def test_mixing(spark, odd):
    rng = random.Random(5)
    rows = [(i, t, "s0") for i, t in odd] + [(100 + i, sentence(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "ä", None, "hot", "hot", "hot"])) for i in range(800)] + [(2000, "", "empty")]
    docs = frame(spark, rows)
    got = mixing.mix(docs)
    out = got.select("doc_id", "source", "size", "source_size", "target", "copies", "shards").collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "copies", "shards").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3 and len(r["shards"]) == r["copies"] and set(r["shards"]) <= set(range(16))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want, weight, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names)
    total = sum(size.values())
    while True:  # caps one after the other, as told
        free = total - sum(3 * size[s] for s in names if s not in left)
        w = sum(weight[s] for s in left)
        over = [s for s in left if free * weight[s] / w > 3 * size[s]]
        if not over:
            break
        left -= set(over)
    for s in names:
        want[s] = free * weight[s] / w if s in left else 3 * size[s]
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert mixing.mixed_rows(got, ["doc_id", "text"]).count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_counts_what_the_leaves_hold(spark, monkeypatch, tmp_path):
    """op5_mixing takes its copies from the splitting tree: what is dealt twice is taken twice."""
    from meshwright.llm import queries

    rng = random.Random(7)
    frame(spark, [(i, sentence(rng, 5), "ab"[i % 2]) for i in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    before = {r["doc_id"]: r for r in queries.op5_mixing(spark, str(tmp_path)).collect()}
    real = mixing.split_shards

    def twice(*args):
        units = real(*args)
        return units.unionByName(units)

    monkeypatch.setattr(mixing, "split_shards", twice)
    after = {r["doc_id"]: r for r in queries.op5_mixing(spark, str(tmp_path)).collect()}
    assert set(after) == set(before) and sum(r["copies"] for r in before.values())
    assert all(2 * r["copies"] <= after[i]["copies"] <= 2 * r["copies"] + 1 and after[i]["taken"] == r["size"] * after[i]["copies"] for i, r in before.items())


def brute_lines(rows, min_lines, min_chars):
    positions = [(i, k, tuple(t.split("\n"))) for i, t in rows if t is not None for k in [0]]
    out = {}
    docs = [(i, t.split("\n")) for i, t in rows if t is not None]
    singles, windows = {}, {}
    for i, ls in sorted(docs):
        gone = set()
        for k, line in enumerate(ls):
            if singles.setdefault(line, (i, k)) != (i, k) and len(line.strip(" ")) >= min_chars:
                gone.add(k)
            if k + min_lines <= len(ls) and any(x.strip(" ") for x in ls[k : k + min_lines]) and windows.setdefault(tuple(ls[k : k + min_lines]), (i, k)) != (i, k):
                gone.update(range(k, k + min_lines))
        out[i] = [x for k, x in enumerate(ls) if k not in gone]
    assert positions or not rows
    return out


@pytest.mark.parametrize("min_lines,min_chars", [(4, 60), (2, 8), (2, 24), (1, 1)])
def test_lines(spark, min_lines, min_chars):
    rng = random.Random(6)
    pool = [sentence(rng, rng.randrange(0, 12)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a\n" * 3000)]
    got = lines.dedup_lines(frame(spark, rows), min_lines, min_chars).collect()
    want = brute_lines(rows, min_lines, min_chars)
    for r in got:
        if r["text"] is None:
            assert r["doc_id"] == 101 and (r["n_lines"], r["n_removed"]) == (0, 0)
            continue
        n = dict(rows)[r["doc_id"]].count("\n") + 1
        assert (r["text"], r["n_lines"], r["n_removed"]) == ("\n".join(want[r["doc_id"]]), n, n - len(want[r["doc_id"]]))
    assert lines.dedup_lines(frame(spark, rows[:0])).count() == 0
    twice = lines.dedup_lines(frame(spark, [rows[3], rows[3]]), 4, 10**6).collect()
    assert len(twice) == 2 and twice[0]["text"] == twice[1]["text"]


def test_audio(spark, odd):
    out = {}
    for r in audio.audio_digests(frame(spark, odd)).collect():
        out.setdefault(r["doc_id"], r)
    for i, t in odd:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = audio.wav(full, 16000)
        assert audio.wav_samples(stored) == full
        r = out[i]
        import zlib

        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert out[3]["feature"] == out[4]["feature"]
    assert audio.audio_digests(frame(spark, odd[:0])).count() == 0
    tensors = audio.audio_tensors(frame(spark, odd)).toArrow()
    fixed = audio.as_fixed_shape(tensors.column("tensor"))
    assert len(fixed) == tensors.num_rows and fixed.type.shape == [32, 24]


def test_audio_parts():
    o = audio.AudioOptions(up=3, down=4, taps=24)
    t = np.arange(4000) / 16000
    x = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    y = audio.resample(x, o)
    assert len(y) == 3000
    spectrum = np.abs(np.fft.rfft(y[200:2800]))
    assert abs(np.argmax(spectrum) * 12000 / 2600 - 500) < 10
    loud = np.zeros((20, 4), np.int16)
    loud[5:12] = 500
    assert audio.segments(loud, o) == [(5, 12)]


def bm25(texts, k):
    docs = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts]
    words = [(i, WORD.findall(t)) for i, t in docs]
    mean = sum(len(w) for _, w in words) / len(words)
    df = defaultdict(int)
    for _, w in words:
        for x in set(w):
            df[x] += 1
    out = {}
    for q, w in words:
        if q % 20:
            continue
        scores = []
        for i, v in words:
            s = sum(np.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * v.count(x) * 2.2 / (v.count(x) + 1.2 * (0.25 + 0.75 * len(v) / mean)) for x in set(w) if x in v)
            if s > 0:
                scores.append((-round(s, 9), i, s))
        out[q] = [(i, round(s, 6)) for _, i, s in sorted(scores)[:k]]
    return out


def test_search(spark, odd):
    rng = random.Random(8)
    rows = [(20 * i if i % 3 else i, sentence(rng, rng.randrange(1, 25), 60)) for i in range(1, 160)] + [(5000, None), (5020, ""), (5040, "ONE w1"), (5041, "one w1"), (5043, "w1 one")]
    rows = list(dict(rows).items())
    docs = frame(spark, rows)
    for shard_rows, block in ((10_000, 64), (23, 4)):
        got = search.bm25_top_k(docs, docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"), 5, shard_rows=shard_rows, block=block).collect()
        want = bm25(rows, 5)
        found = defaultdict(list)
        for r in sorted(got, key=lambda r: (r["query"], r["rank"])):
            found[r["query"]].append((r["doc_id"], r["score"]))
        assert dict(found) == {q: x for q, x in want.items() if x}
    assert search.bm25_top_k(docs.limit(0), docs.limit(0).select(F.col("doc_id").alias("query"), "text")).count() == 0


def test_search_goes_on_from_shard_to_shard(spark, monkeypatch):
    """A task gives k rows a query, not k from each of its shards, and blocks that cannot reach the k-th score are left out."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{i % 40}w{int(60 * rng.random() ** 2)}" if rng.random() < 0.5 else f"w{int(60 * rng.random() ** 3)}" for _ in range(30))) for i in range(400)]
    docs, made, real = frame(spark, rows), [], search._searched

    def counted(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(search, "_searched", counted)
    got = defaultdict(list)
    for r in search.bm25_top_k(docs, docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"), 3, shard_rows=10, block=2).orderBy("query", "rank").collect():
        got[r["query"]].append((r["doc_id"], r["score"]))
    assert dict(got) == bm25(rows, 3)
    assert 0 < made[0] <= 4 * 20 * 3


def test_search_holds_a_shard_in_little_memory(spark, monkeypatch):
    """An index takes few bytes a posting while it is made and asked, also where all rows are candidates; long documents make more shards."""
    import tracemalloc

    rng = np.random.default_rng(10)
    rows, each = 4000, 250
    codes = np.concatenate([np.sort(rng.choice(20_000, each, replace=False)) for _ in range(rows)]).astype(np.int32)
    counts, lengths = np.ones(len(codes), np.int32), np.full(rows, float(each))
    asked = np.arange(0, 20_000, 2, dtype=np.int32)
    want = np.add.reduceat((codes % 2 == 0) * 1.0, np.arange(0, len(codes), each))
    tracemalloc.start()
    try:
        index = search.Shard(np.arange(rows), lengths, codes, np.full(rows, each), counts, np.ones(20_000), each, 1.2, 0.75, 64)
        ((found, scores),) = index.top([asked], np.array([1.0]), 10)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30 * len(codes)
    assert len(found) == rows and np.allclose(scores, want)

    shards = []
    monkeypatch.setattr(search, "written", lambda df, name: df)
    monkeypatch.setattr(search, "_searched", lambda docs, weighed, *args: shards.append(docs.select("shard").distinct().count()) or weighed.selectExpr("ask", "query", "ask as doc", "0d as score"))
    docs = frame(spark, [(i, " ".join(f"d{i}w{j}" for j in range(50))) for i in range(200)])
    search.bm25_top_k(docs, docs.limit(1).select(F.col("doc_id").alias("query"), "text"), shard_terms=1000)
    assert shards == [10]


def test_warc(spark):
    page = '<html lang="fr"><head><title>A &amp; B</title></head><body><script>"</p>"</script><p>x  y<br>z</p><!-- no --><a href="/q">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://b/\r\nX: 1", ""), (4, "http://c/", "<" * 5000)], "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    out = warc.warc_derivatives(pages, with_records=True).collect()
    assert len(out) == 8
    by = {(r["page_id"], r["kind"]): r for r in out}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    h, block = warc.parse(bytes(text["record"]))
    assert block.decode() == "x y\nz\nlink" and h["warc-refers-to"] == meta["refers_to"] and h["warc-block-digest"] == warc.digest(block)
    m = warc.parse(bytes(meta["record"]))[1].decode()
    assert "title: A & B" in m and "lang: fr" in m and "outlink: /q" in m and f"conversion: {text['record_id']}" in m and f"source-payload-digest: {warc.digest(page.encode())}" in m
    assert b"\r\nX: 1" not in bytes(by[3, "metadata"]["record"])
    stored = spark.createDataFrame([(1, bytearray(warc.response(1, "http://a/", page, "1970-01-01T00:00:00Z"))), (2, None), (3, bytearray(b"junk")), (4, text["record"])], "page_id long, source binary")
    again = warc.warc_derivatives(stored, source="source", with_records=True).collect()
    assert {bytes(r["record"]) for r in again} == {bytes(r["record"]) for r in out if r["page_id"] == 1}
    assert warc.warc_derivatives(pages.limit(0)).count() == 0


def brute_substrings(rows, window):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("max_group", [50_000, 2])
def test_substrings(spark, odd, max_group):
    rng = random.Random(9)
    shared = [sentence(rng, n) for n in (30, 49, 50, 51, 90)]
    rows = odd + [(100 + i, " ".join([sentence(rng, rng.randrange(40)), rng.choice(shared), sentence(rng, rng.randrange(40)), rng.choice(shared)])) for i in range(120)]
    rows += [(300 + i, "same " * n) for i, n in enumerate((10, 60, 80, 200))]
    got = substring.dedup_substrings(frame(spark, rows), max_group=max_group).collect()
    assert sorted(map(tuple, got)) == sorted(brute_substrings(rows, 50))
    assert substring.dedup_substrings(frame(spark, rows[:0])).count() == 0
    assert substring.dedup_substrings(frame(spark, [(None, "a b")])).collect()[0]["n_words"] == 2


def kneser_ney(texts, order):
    """Probabilities by definition, from dictionaries."""
    counts = {k: defaultdict(int) for k in range(1, order + 1)}
    for t in texts:
        s = [quality.PAD] * (order - 1) + quality.symbols(t).tolist()
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def discount(k):
        n = [0] + [sum(1 for c in counts[k].values() if c == j) for j in (1, 2, 3, 4)]
        if not (n[1] and n[2] and n[3]):
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(d, 0.1 * j), j) for j, d in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]

    ds = {k: discount(k) for k in counts}

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k = len(g)
        inside = [(x, c) for x, c in counts[k].items() if x[:-1] == g[:-1]]
        if not inside:
            return p(g[1:])
        total = sum(c for _, c in inside)
        d = lambda c: ds[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return (max(c - d(c), 0) / total if c else 0) + sum(d(x) for _, x in inside) / total * p(g[1:])

    return p


@pytest.mark.parametrize("order", [3, 5])
def test_quality_model(spark, order):
    texts = ["the cat sat", "the dog", "a cat\n", "Then 12 |!", "собака и кот", "猫と犬と猫", "🐈🐕", ""]
    model = quality.train(spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary"), order).toArrow().sort_by("code")
    table = [np.asarray(model.column(c)) for c in ("code", "share", "back")]
    p = kneser_ney(texts, order)
    rng = random.Random(1)
    seen = sorted({c for t in texts for c in quality.symbols(t).tolist()})
    tried = [tuple(rng.choice(seen) for _ in range(order)) for _ in range(40)] + [tuple(quality.symbols(t)[k : k + order].tolist()) for t in texts[:6] for k in range(len(t) - order + 1)]
    codes = np.array([sum(x << quality.BITS * (order - 1 - i) for i, x in enumerate(g)) for g in tried], np.int64)
    assert np.abs(quality.probabilities(codes, order, *table) / [p(g) for g in tried] - 1).max() < 1e-5
    context = codes[-1] >> quality.BITS << quality.BITS
    assert abs(quality.probabilities(context + np.arange(quality.SYMBOLS), order, *table).sum() - 1) < 1e-5


def test_symbols_tell_scripts_and_letters_apart():
    han = quality.symbols("".join(map(chr, range(0x4E00, 0xA000))))
    assert len(np.unique(han)) > 0.99 * quality.OWN  # 2048 classes beyond Latin, Greek, Cyrillic, Hebrew and Arabic
    assert len(np.unique(quality.symbols("".join(map(chr, range(1, quality.OWN)))))) == quality.OWN - 1


def test_grams_do_not_depend_on_pieces():
    rng = random.Random(6)
    texts = ["", "a", sentence(rng, 300), "é" * 50, sentence(rng, 5)]

    def by_text(piece):
        out = defaultdict(list)
        for codes, rows in quality.grams(texts, 5, piece):
            for c, r in zip(codes.tolist(), rows.tolist(), strict=True):
                out[r].append(c)
        return out

    assert by_text(1) == by_text(7) == by_text(1 << 19)
    assert [len(by_text(7)[i]) for i in range(5)] == [len(t) for t in texts]


def test_sharded_scores_equal_copied_ones(spark, odd):
    rng = random.Random(8)
    docs = frame(spark, odd + [(i, sentence(rng, 30)) for i in range(40, 140)]).withColumn("block", F.lit("clash")).withColumn("row", F.struct(F.lit(1).alias("x")))
    model = quality.train(docs.filter("doc_id >= 40").select(F.col("text").cast("binary")))
    copied, sharded = (quality.scored(docs, model, most_bytes=n, block_rows=30) for n in (1 << 30, 0))
    assert copied.columns == sharded.columns == [*docs.columns, "log_perplexity"]
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    a, b = (sorted(df.collect(), key=key) for df in (copied, sharded))
    assert [key(r) for r in a] == [key(r) for r in b]
    assert all(x["log_perplexity"] == y["log_perplexity"] or abs(x["log_perplexity"] - y["log_perplexity"]) < 1e-9 for x, y in zip(a, b, strict=True))
    empty = quality.train(docs.limit(0).select(F.col("text").cast("binary")))
    for n in (1 << 30, -1):
        assert abs(quality.scored(docs.filter("doc_id = 3"), empty, most_bytes=n).first()["log_perplexity"] - np.log(quality.SYMBOLS)) < 1e-9


def test_quality_judgement(spark, odd):
    rng = random.Random(2)
    good = [(i, sentence(rng, 40)) for i in range(20, 220)]
    junk = [(i, " ".join(rng.choice(["!!|", "ZZ", "##"]) for _ in range(40))) for i in range(300, 330)]
    docs = frame(spark, odd + good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in junk[::2]] + [(999, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(docs, labels, least=5).collect()}
    assert all(out[i]["keep"] for i, _ in good) and not any(out[i]["keep"] for i, _ in junk)
    assert out[0]["log_perplexity"] is None and out[0]["keep"] and out[1]["keep"]
    assert quality.judge(docs, labels.limit(0)).filter("keep").count() == docs.count()
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_model_goes_through_the_driver_once(spark, odd, monkeypatch):
    made, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(value) or real(self, value))
    docs = frame(spark, [(i, t[:2000] if t else t) for i, t in odd]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in odd[:16]], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels, folds=2, least=1).count() == len(odd)
    assert len(made) == 1


def test_shingles_of_arrow_slices():
    texts = pa.array([b"a b c d e", b"", None, b"a b", b"A B c D e"], pa.binary())
    whole = dict(jaccard.shingle_sets(texts, 4))
    assert [len(whole[i]) for i in range(5)] == [2, 0, 0, 1, 2] and whole[0].tolist() == whole[4].tolist()
    assert [s.tolist() for _, s in jaccard.shingle_sets(texts.slice(3), 4)] == [whole[3].tolist(), whole[4].tolist()]


def test_every_sample_is_in_a_frame():
    o = audio.AudioOptions()
    for n in (9, o.frame - 1, o.frame, o.frame + 1, 5 * o.hop + o.frame + o.hop // 2):
        silent, loud = np.zeros(n, np.float32), np.zeros(n, np.float32)
        loud[max(0, n - 4) :] = 1  # the very last samples
        a, b = audio.log_mel(silent, o), audio.log_mel(loud, o)
        assert a.shape == b.shape and (len(a) - 1) * o.hop + o.frame >= n
        assert n == o.frame or (a[-1] != b[-1]).any()
        made, begin, end, voiced = audio.tensors(a, [], o)
        assert made.type == pa.fixed_shape_tensor(pa.int16(), (o.shape, o.mels)) and len(made) == len(begin) == len(end) == len(voiced)
