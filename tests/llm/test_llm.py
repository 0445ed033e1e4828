"""The training-data operators against plain versions, and the hard cases of each."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rowtide.llm import bpe, ctph, embed_dedup, kneser_ney, licenses, packing, queries, simhash, token_orc, toxicity, warc, words
from rowtide.llm.common import Scratch, components
from rowtide.llm.pieces import PieceEncoder

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word " * 30_000 + "x" * 5_000
HARD = [(1, None, "en"), (2, "", None), (3, "a b", "de"), (3, "a b", "de"), (None, "some text", "en"), (4, " \n\t ", "fr"), (5, LONG, "en"), (6, "é漢字 \U0001f600 'quote' \\ \"", "es"), (7, LONG + "y", "en")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(*r, "s", 1, "clash", b"x", 0.5) for r in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, body binary, toxic_score double")


@pytest.fixture(scope="module")
def none(hard):
    return hard.limit(0)


def union(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = union(links, {x for ab in links for x in ab})
    assert all(got.get(n, n) == c for n, c in want.items())


def plain_fingerprint(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_simhash(docs, hard, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.limit(200).collect()] + [(10_000 + i, r[1] or "") for i, r in enumerate(HARD)]
    rows += [(20_000 + i, t + " tail") for i, t in rows[:40]]
    fps = {i: plain_fingerprint(t, 4) for i, t in rows}
    want = union([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    got = simhash.near_duplicates(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (f, want[i]) for i, f in fps.items()}
    assert len(simhash.near_duplicates(hard).collect()) == len(HARD)
    assert simhash.near_duplicates(none).count() == 0


def test_gray_index_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for i in range(1500):  # chains of near fingerprints
        f[i + 1] = f[i] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(0, 6))).tolist())))
    f = np.unique(f)
    links = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 4) if i < j]
    got = {(int(a), int(b)) if a < b else (int(b), int(a)) for i, j in simhash.GrayIndex(np.zeros(len(f), int), f).pairs(4) for a, b in zip(i, j, strict=True)}
    assert got == set(links)
    roots = np.sort(rng.integers(0, 400, len(f)))  # of one to some tens of fingerprints, and one of many
    roots[: len(f) // 2] = 0
    got = sorted((min(a, b), max(a, b)) for i, j in simhash.GrayIndex(roots, f).pairs(4) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert got == sorted((i, j) for i, j in links if roots[i] == roots[j])
    assert not list(simhash.GrayIndex(roots[:0], f[:0]).pairs(4))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    calls = []
    monkeypatch.setattr(simhash.GrayIndex, "pairs", lambda self, radius, own=simhash.GrayIndex.pairs: calls.append(0) or own(self, radius))
    a, b = simhash.spanning(roots, f, 4)
    assert calls and union(list(zip(a.tolist(), b.tolist(), strict=True)), range(len(f))) == union([(i, j) for i, j in links if roots[i] == roots[j]], range(len(f)))
    frame = spark.createDataFrame([(int(x), int(x), 0) for x in f.view(np.int64)], "cid long, fp long, fp2 long")
    found = simhash.hamming_links(frame, 4, Scratch(spark, "t")).collect()
    key = {int(x): i for i, x in enumerate(f.view(np.int64))}
    assert union([(key[r["a"]], key[r["b"]]) for r in found], range(len(f))) == union(links, range(len(f)))


def test_simhash_by_similarity(spark):
    """Near copies of a similarity well over 0.8 group together; other texts stay alone."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(60):
        base = [word() for _ in range(300)]
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(300)] = word()
            rows.append((4 * g + k, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, radius=12, similarity=0.8).collect()}
    assert sum(got[i] == i // 4 * 4 for i in got) >= 0.97 * len(got)
    assert all(c // 4 == i // 4 for i, c in got.items())


def test_similar_links_are_exact(spark):
    """Pairs planted at similarities of 0.7 to 0.9, and texts that one word dominates: links are those of exact Jaccard >= 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = ["same " * 400 + " ".join(word() for _ in range(20)) for _ in range(3)]
    for changes in [*range(1, 9)] * 12:
        base = [word() for _ in range(150)]
        copy = list(base)
        for at in rng.sample(range(150), changes):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert sum(0.8 <= s < 0.9 for s in alike.values()) > 10 and sum(0.7 <= s < 0.8 for s in alike.values()) > 10
    want = union([p for p, s in alike.items() if s >= 0.8], range(len(texts)))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, order in ((simhash.CHUNK, simhash.ORDERED_BY), (5, 40)):  # roots in pairs of chunks and a poor order of shingles give the same
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "CHUNK", chunk)
            m.setattr(simhash, "ORDERED_BY", order)
            got = simhash.near_duplicates(frame, words=5, similarity=0.8).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["component_id"] for r in got if r["kept"]} == set(want.values()) and sum(r["kept"] for r in got) == len(set(want.values()))


def test_similar_links_within_a_root_of_many(spark):
    """Texts of which a passage is most: all share their shingles, few are similar, and no chain from the least joins them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, texts = [word() for _ in range(40)], []
    for _ in range(60):
        own = [word() for _ in range(rng.choice([2, 14, 20, 26]))]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    want = union([(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(texts)))
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 10


def test_n_grams_of_long_texts_come_in_lots(monkeypatch):
    rng = random.Random(3)
    bodies = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 1, 3, 16, 17, 100, 0, 33)]
    for lot in (5, 16, 1 << 21):
        monkeypatch.setattr(kneser_ney, "LOT", lot)
        found = defaultdict(list)
        for own, of, n in kneser_ney.codes(bodies, 4):
            for k, part in zip(of.tolist(), np.split(own, np.cumsum(n)[:-1]), strict=True):
                found[k] += part.tolist()
        padded = [b"\0" * 3 + b for b in bodies]
        assert {k: v for k, v in found.items()} == {k: [int.from_bytes(p[i : i + 4], "big") for i in range(len(p) - 3)] for k, p in enumerate(padded) if len(p) > 3}
        assert kneser_ney.distinct_codes(bodies, 4).tolist() == sorted({g for v in found.values() for g in v})


def planted(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    labels = rng.integers(0, 4, n)
    hot = rng.normal(size=dim)
    for i in range(0, 300):
        base[i], labels[i] = hot + 0.15 * rng.normal(size=dim), 1
    for i in range(300, 500, 2):
        base[i + 1], labels[i + 1] = base[i] * 3 + 0.3 * rng.normal(size=dim) * (i % 5), labels[i]
    base[600:640] = base[600]
    return base.astype(np.float32), labels


def test_multi_index(spark):
    x, labels = planted()
    rows = [(i, [float(y) for y in v], int(k), "clash") for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    nan, inf = float("nan"), float("inf")
    rows += [(9000, None, 1, ""), (9001, [0.0] * 64, 1, ""), (9002, [nan] * 64, 1, ""), (9003, [inf] + [1.0] * 63, 1, ""), (9004, rows[0][1], None, ""), (9005, [], 1, ""), (9006, rows[0][1][:10], 1, ""), (9007, [None] + [1.0] * 63, 1, "")]
    e = x.astype(np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    link = (e @ e.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    pairs = list(zip(*(a.tolist() for a in np.nonzero(np.triu(link))), strict=True))
    want = union(pairs, range(len(x)))
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cid string")).collect()}
    assert len(got) == len(rows)
    links, true = sum(got[i]["n_links"] for i in range(len(x))), link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert links >= 0.99 * true
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9000, 9008))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(9)
    cells = list(embed_dedup.MultiIndex.traverse(a, b, 0.8))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(9) for j in range(9) if a[i] + b[j] <= 0.8}


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "model"):
        library_ids.model = Tokenizer.from_file(VOCABULARY)
    return library_ids.model.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_orc(docs, hard, none, spark):
    at, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library_ids(r["text"] or ""), 0]
        want[r["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    got = token_orc.round_trip(docs, VOCABULARY)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    got = token_orc.round_trip(hard, VOCABULARY).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, None]
    assert got[0]["n_tokens"] == 1 and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert token_orc.round_trip(none, VOCABULARY).count() == 0
    scratch = Scratch(spark, "orc")
    token_orc.write_tokens(docs, scratch.path("x"), VOCABULARY)
    few = token_orc.read_tokens(spark, scratch.path("x"), [5, 17])
    assert "IN (5,17)" in few._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["start"] for r in few.collect()} == {i: want[i][0] for i in (5, 17)}


@pytest.mark.parametrize("text", ["", "  a  b", "a \n b  c", "x\t y", "it's  don't 's", "a\x1c b", "a　 b 　c", " a", "a ", "1 2 3  4", "\xa0 \xa0x", LONG])
def test_stretches_encode_as_whole_texts(text):
    assert PieceEncoder(VOCABULARY).encode(pa.array([text.encode()]))[0].tolist() == library_ids(text)


def tiktoken_model():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, hard, none):
    model = tiktoken_model()

    def want(text):
        ids = model.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r[0]: tuple(r[1:]) for r in got} == {i: want(t) for i, t in texts.items()}
    got = bpe.round_trip(hard, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *want(r[1])) for r in HARD)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_and_long_pieces():
    model = tiktoken_model()
    pairs = bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 4000):
        for letters in ("a", "ab", "abcdefgh", "thein "):
            text = "".join(rng.choice(letters) for _ in range(n))
            ids, sizes = pairs.encode(pa.array([text.encode()]))
            assert ids.tolist() == model.encode_ordinary(text) and sizes.tolist() == [len(ids)]
    queue, given = bpe.RankQueue(60_000), defaultdict(list)
    for i in range(3000):
        given[rng.randrange(60_000)].insert(0, i)
    for rank, places in given.items():
        queue.push(rank, list(places))
    assert [queue.pop() for _ in given] == [(r, sorted(p)) for r, p in sorted(given.items())] and not queue


def test_ranks_in_any_order():
    """Merges may make pairs of lower ranks than their own: against a plain search for the least pair, in packed arrays too."""
    rng = random.Random(5)
    for trial in range(60):
        tokens = [bytes([b]) for b in range(256)] + list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(40)]
        want = []
        for piece in pieces:
            x = [piece[i : i + 1] for i in range(len(piece))]
            while len(x) > 1 and (best := min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(x, x[1:], strict=False))))[0] < 1 << 30:
                x[best[1] : best[1] + 2] = [x[best[1]] + x[best[1] + 1]]
            want.append([ranks[t] for t in x])
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bpe, "PACKED", (1, 1 << 20)[trial % 2])
            ids, sizes = bpe.Ranks(ranks).merge(pieces)
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "12", ".", "<|endoftext|>", "|>", "<|", " <", "\u3000", " x", "日本", "'", "\x1c", "the", " ing"]


@pytest.mark.parametrize(("part", "limit"), [(4 << 20, 1 << 20), (3, 2000)])
def test_words_encode_as_whole_texts(part, limit, monkeypatch):
    """Texts with odd spaces and added tokens in all places; cut into very short parts and with a table that is soon full too."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [f"{a}<|endoftext|>{b}" for a in ("", "word", "word ", "word.", "\n") for b in ("", "word", " word", "\n", "|>")]
    monkeypatch.setattr(words, "PART", part)
    library, model = PieceEncoder(VOCABULARY), tiktoken_model()
    for coder, want in ((library, lambda t: library_ids(t)), (bpe.BytePairs(RANKS, public_tokenizers.PATTERN), model.encode_ordinary)):
        coder.limit = limit
        for lot in (texts[:2000], texts[2000:], texts[:50]):
            ids, sizes = coder.encode(pa.array([t.encode() for t in lot], pa.binary()))
            ends = np.cumsum(sizes)
            assert [ids[e - n : e].tolist() for n, e in zip(sizes, ends, strict=True)] == [list(want(t)) for t in lot]
    assert library.encode(pa.array([b"a\xffb", b""], pa.binary()))[0].tolist() == library_ids("a\ufffdb")
    assert library_ids("foo<|endoftext|>")[-1] == 50256  # as the library takes it


def check_packing(rows, texts, cap=1024):
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    for i, text in texts.items():
        ids, at = [*library_ids(text or ""), 2], 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            assert len(docs[i]) == 1 or k == 0 or r["length"] == cap
            at += r["length"]
        assert at == len(ids)
    return len(places)


def best_fit(lengths, cap):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            min(fits)[0] -= x
        else:
            bins.append([cap - x])
    return len(bins)


def test_packing(docs, hard, none):
    rows = packing.pack(docs, VOCABULARY).collect()
    n = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n == best_fit([r["length"] for r in rows], 1024)
    rows = packing.pack(hard, VOCABULARY)
    sequences = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(rows).collect()}
    assert sum(sequences.values()) == rows.agg(F.sum("length")).first()[0] and max(sequences.values()) <= 1024
    assert packing.pack(none, VOCABULARY).count() == 0


def test_packing_plan():
    rng = random.Random(2)
    for cap in (10, 64, 1024):
        for _ in range(20):
            lengths = [rng.randint(1, rng.choice([3, cap // 2, cap])) for _ in range(rng.randint(1, 400))]
            counts = Counter(lengths)
            slots, n = packing.plan(counts, cap)
            assert n == best_fit(lengths, cap)
            used, taken = defaultdict(list), Counter()
            for length, rank, ranks, first, offset, each in slots:
                for k in range(ranks):
                    used[first + k // each].append((offset + k % each * length, length))
                    taken[length, rank + k] += 1
            assert taken == Counter({(x, k): 1 for x, c in counts.items() for k in range(c)})
            for own in used.values():
                assert sum(y for _, y in own) <= cap and all(a + x == b for (a, x), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))


def test_warc(spark):
    big = "<html>" + "é\r\n\r\nx" * 50
    rows = [(5, "http://a", big), (3, "http://b", big), (9, "http://c", big), (1, "u", "small"), (2, "v", "small"), (4, "w", None), (6, None, ""), (7, "bad\r\nWARC-Type: revisit", "z" * 200), (8, "r", "z" * 200), (8, "r", "z" * 200), (None, "n", "q" * 100), (10, "n", "q" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("record", F.lit(1))
    scratch = Scratch(spark, "t")
    warc.write_archive(pages, scratch.path("w"), scratch)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, scratch.path("w")).collect())

    def row(i, html, kind="response", to=None):
        b = (html or "").encode()
        return i, len(b), hashlib.sha256(b).hexdigest(), kind, to

    assert got == Counter([row(3, big), row(5, big, "revisit", 3), row(9, big, "revisit", 3), row(1, "small"), row(2, "small"), row(4, None), row(6, ""), row(7, "z" * 200), row(8, "z" * 200, "revisit", 7), row(8, "z" * 200, "revisit", 7), row(10, "q" * 100), row(None, "q" * 100, "revisit", 10)])
    assert spark.read.parquet(scratch.path("w") + "/payloads").count() == 5
    full = {r["page_id"]: bytes(r["bytes"]) for r in warc.reconstruct(spark, scratch.path("w")).collect()}
    for i, body in ((3, big.encode()), (6, b"")):
        head, _, rest = full[i].partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[length:] == b"\r\n\r\n" and rest[:length].partition(b"\r\n\r\n")[2] == body
    warc.export(spark, scratch.path("w"), scratch.path("files"))
    whole = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(scratch.path("files")).collect())
    assert sorted(whole) == sorted(b"".join(bytes(r["bytes"]) for r in warc.reconstruct(spark, scratch.path("w")).collect()))
    files = warc.read_warc(spark, scratch.path("files")).collect()
    read = {(r["page_id"], r["record_type"], r["payload_digest"], r["refers_to"]) for r in files}
    assert len(files) == len(rows) and read == {(i, kind, digest, to) for i, _, digest, kind, to in got}
    assert {r["url"] for r in files if r["page_id"] == 7} == {"bad%0D%0AWARC-Type: revisit"}
    assert all((hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]) if r["record_type"] == "response" else r["payload"] is None for r in files)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(whole[:-5]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parsed(whole + b"x\r\n\r\n"))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_piecewise_hash(docs, hard, none):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = {}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e, n = (ctph.fingerprint(x.encode()) for x in (t, edited, after))
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, ctph.likeness(f, e), ctph.likeness(f, n))
    got = {r[0]: tuple(r[1:]) for r in ctph.compare_with_edits(docs).collect()}
    assert got == want
    near = [v[4] for v in want.values()]
    assert np.mean([v[4] > v[5] for v in want.values() if v[0] > 200]) > 0.9 and 0 <= min(near) and max(near) <= 1
    assert len(ctph.compare_with_edits(hard).collect()) == len(HARD)
    one = ctph.compare_with_edits(hard.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert ctph.compare_with_edits(none).count() == 0


def test_partitions_follow_the_size_of_files(spark, docs, monkeypatch, sf_dir):
    from rowtide.llm import common

    files, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.partitions(spark)
    assert common.partitions(spark, files) == n == common.partitions(spark, spark.createDataFrame([(1,)], "a int"))
    monkeypatch.setattr(common, "PARTITION_BYTES", 1 << 10)
    monkeypatch.setattr(common, "MOST_PARTITIONS", 40)
    assert common.partitions(spark, files) == 40


def test_repeated_ids_are_dealt_out(spark, monkeypatch):
    """A third of the rows under one id, and a third without one: their ranges are split, and results are as in one order."""
    rng = random.Random(9)
    rows = [(i, f"text {i} {rng.random()}") for i in range(60)] + [(17, f"same id {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(58)] + [(None, "no id 7")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from rowtide.llm import common

    monkeypatch.setattr(common, "partitions", lambda spark, df=None: 9)
    dealt = common.deal(common.ordered(common.text_rows(frame, "doc_id", "text"), "id", "body"), "id", "tie", "body")
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert max(sizes) < 45 and sum(sizes) == len(rows)
    order = sorted(((r["bucket"], r["id"] is None, r["id"] or 0, r["tie"], bytes(r["body"]).decode()) for r in dealt.collect()))
    assert [x[1:3] for x in order] == sorted(x[1:3] for x in order)  # ranges follow each other
    texts = [x[4] for x in order]
    got = {(r["doc_id"], r["edited_sha256"]) for r in ctph.compare_with_edits(frame).collect()}
    cut = lambda t, after: (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
    assert got == {(None if x[1] else x[2], hashlib.sha256(cut(t, after)).hexdigest()) for x, t, after in zip(order, texts, [*texts[1:], texts[0]], strict=True)}
    tokens = sorted(((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_orc.round_trip(frame, VOCABULARY).collect()))
    ids = [[*library_ids(t), 0] for t in texts]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert tokens == [(s, len(x), crc(x)) for s, x in zip(starts, ids, strict=True)]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        a, b = (["".join(rng.choice("ab") for _ in range(2)) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert ctph.common("".join(a), "".join(b)) == table[-1][-1]


def plain_kneser_ney(trusted, order):
    """Dictionaries and recursion, straight from the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in trusted:
        t = b"\0" * (order - 1) + t
        counts[order].update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, sums = {}, {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        cuts[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        sums[k] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[k].items():
            s = sums[k][g[:-1]]
            s[0] += c
            s[1] += cuts[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, back = len(g), p(g[1:])
        if g[:-1] not in sums[k]:
            return back
        total, freed = sums[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (max(c - cuts[k][min(c, 3) - 1], 0) if c else 0) / total + freed / total * back

    return p


def test_kneser_ney(docs, hard, none, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK", 20_000)
    monkeypatch.setattr(kneser_ney, "LEAST_DOCS", 5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    rows = {r["doc_id"]: ((r["text"] or "").encode(), r["lang"]) for r in docs.collect()}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    p = plain_kneser_ney([rows[i][0] for i in good - held if i in rows], 4)
    cache = {}

    def perplexity(t):
        t = b"\0" * 3 + t
        return np.exp(-np.mean([cache.setdefault(t[i - 3 : i + 1], np.log(p(t[i - 3 : i + 1]))) for i in range(3, len(t))]))

    got = {r["doc_id"]: r for r in kneser_ney.score(docs, labels).collect()}
    assert got.keys() == rows.keys()
    for i in list(rows)[:60]:
        if rows[i][0]:
            assert got[i]["perplexity"] == pytest.approx(perplexity(rows[i][0]), rel=1e-4)
            assert got[i]["keep"] == (got[i]["perplexity"] <= got[i]["threshold"])
    assert len({r["threshold"] for r in got.values()}) > 1
    out = kneser_ney.score(hard, labels).collect()
    assert len(out) == len(HARD) and all(r["keep"] for r in out if r["n_bytes"] == 0)
    assert all(r["keep"] and r["threshold"] is None for r in kneser_ney.score(hard, labels.limit(0)).collect())
    assert kneser_ney.score(none, labels).count() == 0


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op5(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    assert docs.count() == 1000


def test_toxicity_hard_cases(spark, hard, none):
    texts = ["all is well today", "you vile fool", "a fine day", "what a vile fool you are", "good bread"] * 8
    model = toxicity.train(texts, np.array(["vile" in t for t in texts]))
    out = toxicity.score(hard, model, {"de": 0.7}, lang_col="lang")
    assert out.columns == [*hard.columns[:-1], "toxic_score", "toxic_limit"]
    rows = out.collect()
    assert len(rows) == len(HARD) and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert {r["lang"]: r["toxic_limit"] for r in rows} == {"en": 0.5, None: 0.5, "de": 0.7, "fr": 0.5, "es": 0.5}
    assert toxicity.score(none, model).count() == 0
    long = " ".join(random.Random(1).choices(["you", "vile", "fool", "good", "bread", "are", "x"], k=300))
    rows = model.words(long.split())
    for blocks in ([rows], [rows[i : i + 7] for i in range(0, 300, 7)], [rows[i : i + 1] for i in range(300)]):  # against windows over the padded text
        at, want = 0, []
        for w in toxicity.WIDTHS:
            padded = np.pad(rows[:, at : at + w * toxicity.FILTERS], ((w - 1, w - 1), (0, 0)))
            every = [sum(padded[t + k, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] for k in range(w)) for t in range(300 + w - 1)]
            want.append(np.maximum(np.max(every, axis=0), 0))
            at += w * toxicity.FILTERS
        assert np.allclose(model.pooled(blocks), np.concatenate(want), atol=1e-5)
    read = toxicity.Reader(model)
    assert model.score(read("such a Vile, fool")) > 0.5 > model.score(read("good bread and a fine day"))
    nothing = toxicity.train([], np.zeros(0, bool))
    assert nothing.score(toxicity.Reader(nothing)("x")) < 0.5
    empty, limits = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.score(toxicity.Reader(empty)("")) < 0.5 and not limits


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    """4,500 documents of each class, in several parts: none is left out, and parts together know what one part alone can't."""
    monkeypatch.setattr(toxicity, "PART", 2000)
    words = ["bread", "house", "river", "stone", "cloud"]
    rows = [(i, f"{words[i % 5]} {words[i % 3]} {'vile' if i % 2 else 'fine'} {words[i % 4]}", "en", i % 2) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and zlib.crc32(b"c%d" % r[0]) % 3]
    seen = []
    begin = toxicity.Training.__init__
    monkeypatch.setattr(toxicity.Training, "__init__", lambda self, seen_, n, seed=7: (seen.append((seen_, n)), begin(self, seen_, n, seed))[1])
    model, _ = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    [(with_bucket, n)] = seen
    assert n.tolist() == [sum(r[3] == y for r in used) for y in (0, 1)]
    assert with_bucket[toxicity.features("vile")[0]].tolist() == [0, n[1]]
    read = toxicity.Reader(model)
    assert model.score(read("stone vile")) > 0.5 > model.score(read("stone fine"))


def test_toxicity_thresholds_count_all_and_never_part_ties(spark):
    rng = np.random.default_rng(3)
    for _ in range(50):
        z, y = rng.integers(-6, 7, 80) / 2, rng.random(80) < 0.4
        places = np.unique(z)
        cut = toxicity.best_cut(places, *(np.array([((z == p) & (y == c)).sum() for p in places]) for c in (True, False)))
        wrong = lambda c: (z[y] < c).sum() / max(1, y.sum()) + (z[~y] >= c).sum() / max(1, (~y).sum())
        assert cut not in places and wrong(cut) <= min(map(wrong, [*places, places[-1] + 1])) + 1e-9
    rows = [(i, "vile house" if i % 2 else "fine house", lang, i % 2) for i, lang in zip(range(600), ["en", None, "de", "en", "fr", "None"] * 100, strict=True)]
    docs = spark.createDataFrame([r if r[2] != "fr" or r[0] < 60 else (*r[:2], "en", r[3]) for r in rows], "doc_id long, text string, lang string, toxic int")
    _, limits = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert set(limits) == {"en"} and 0 < limits["en"] < 1  # the other languages have one class only, or few documents


def test_license_scan(docs, hard, none, spark):
    notice, long = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["mit"]
    changed = long.replace("free of charge", "without fee").replace("Software without", "Software entirely without")
    rows = [(1, f"Some words. {notice} More."), (2, "released UNDER the mit license!"), (3, "x\n" + changed), (4, "the license of the road"), (5, (notice + "\n") * 3), (6, "y " * 50_000 + notice), (7, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found[1, "mit-notice"] == found[2, "mit-notice"] == found[3, "mit"] == found[6, "mit-notice"] == 1 and found[5, "mit-notice"] >= 1
    assert not any(i in (4, 7) for i, _ in found)
    for r in got:
        if (r["doc_id"], r["license"]) == (1, "mit-notice"):
            assert texts[1][r["span_start"] : r["span_end"]] == notice and r["coverage"] == 1.0
        if (r["doc_id"], r["license"]) == (3, "mit"):
            assert r["coverage"] > 0.9 and texts[3][r["span_start"] : r["span_end"]] == changed
    want = {(r["doc_id"], n) for r in docs.collect() for n, t in licenses.TEMPLATES.items() if t in (r["text"] or "")}
    assert want <= {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert licenses.scan(hard).count() == 0 and licenses.scan(none).count() == 0


def test_piecewise_hash_of_repetitive_texts_is_whole():
    rng = random.Random(6)
    cut = 0
    for _ in range(40):
        line = "".join(rng.choice("abcdefghij ") for _ in range(30))
        data = (line * 400).encode()
        edited = data[:6000] + "".join(rng.choice("klmnopqrst ") for _ in range(6000)).encode()
        mark = ctph.fingerprint(data)
        power, own, _ = mark.split(":")
        ends = len(ctph.boundaries(data, int(power))[0])
        assert len(own) // 2 in (ends, ends + 1)  # every chunk, the last one up to the end
        assert ends >= ctph.FEW or len(ctph.boundaries(data, ctph.LEAST)[0]) < ctph.FEW
        assert ctph.likeness(mark, ctph.fingerprint(edited)) < 0.9
        cut += ends >= ctph.CHUNKS
    assert cut


def test_thresholds_are_of_the_own_language(spark):
    """A language of few trusted documents has its own threshold."""
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(60))
    few = [(i, text("klmn"), "de") for i in range(1, 13)]
    many = [(i, text("abcdefgh"), "en") for i in range(100, 160)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in few + many], "doc_id long, quality int")
    got = {r["lang"]: r["threshold"] for r in kneser_ney.score(spark.createDataFrame(few + many, "doc_id long, text string, lang string"), labels).collect()}
    assert got["de"] < got["en"]


def test_license_scan_reports_each_copy(spark):
    notice = licenses.TEMPLATES["mit-notice"]
    partial = notice.replace(" License.", "")  # 4 of 5 words
    rows = [(1, (notice + "\n") * 3), (2, f"{partial} {notice}"), (3, (notice + "\n") * 40), (4, f"{notice} and {notice} some other words stand here {notice}")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'mit-notice'").collect()
    assert Counter(r["doc_id"] for r in got) == {1: 3, 2: 2, 3: 40, 4: 3}
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["span_start"] : r["span_end"]] == notice for r in got if r["doc_id"] != 2)
    assert len({(r["doc_id"], r["span_start"]) for r in got}) == len(got)


def test_embeddings_beside_a_hot_group(spark, monkeypatch):
    """Links are all found, though almost all pairs that a small sample shows are of one tight group."""
    monkeypatch.setattr(embed_dedup, "SAMPLE", 100)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 32))
    turned = base + rng.normal(size=base.shape) * 0.35
    hot = rng.normal(size=32) + 0.01 * rng.normal(size=(600, 32))
    x = np.concatenate([base, turned, hot])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    want = near.sum(1) - 1
    assert want[:1200].sum() > 200
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
