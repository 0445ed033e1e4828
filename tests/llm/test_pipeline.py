"""The corpus pipeline, stage by stage, and its hard cases."""

import random

import corpus_pipeline
from test_llm import HARD, check_packing, union

from rowtide.llm import simhash
from rowtide.llm.common import Scratch


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns, kept = Scratch(spark, "t"), docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf), f"s{i}")
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert kept[-1].items() <= kept[-2].items()
    share = lambda a, b, want: sum(i in kept[b] for i in labels if i in kept[a] and want(labels[i])) / max(1, sum(i in kept[a] and want(labels[i]) for i in labels))
    assert share(0, 1, lambda r: r["toxic"] == 1) < 0.1 and share(0, 1, lambda r: r["toxic"] == 0) > 0.95
    assert share(1, 2, lambda r: r["quality"] == 1) > 0.95 and share(1, 2, lambda r: r["quality"] == 0) < 0.4
    assert len(set(kept[3].values())) == len(kept[3])  # no exact copies are left
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), kept[3])


def test_rows_are_judged_by_their_own_text(spark):
    """Rows without an id, and different texts under one id; copies go and one row stays of each text."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(None, base), (None, base), (1, base), (2, "quite other words are here in this text"), (2, base + " more"), (None, "a third text of a few words only"), (None, "a third text of a few words only"), (3, "alone here"), (3, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(1, base), (2, "quite other words are here in this text"), (0, "a third text of a few words only"), (3, "alone here")])


def test_near_copies_against_all_pairs(spark):
    """The stage on sf0.01: components of all pairs with a Jaccard similarity of five-word shingles of 0.8 or more, the least id of each stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] or sets[b] else True)]
    top = union(pairs, ids)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert got == set(top.values())


def test_hard_cases(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.createDataFrame([(*r, "s", 1) for r in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0) for r in near).count(3) == 1  # a repeated row stays once
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            assert out.count() >= 0, name


def test_rows_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    """Variants of one text, most of them a little under 0.8 alike, others over: the components of all pairs, by fewer rows than texts."""
    rng, rows = random.Random(4), []
    base = [f"word{i}" for i in range(150)]
    for i in range(200):
        own = list(rows[-1][1].split()) if i % 5 == 4 else list(base)
        for k in rng.sample(range(150), 1 if i % 5 == 4 else rng.choice([2, 3, 4])):
            own[k] = f"other{i}x{k}"
        rows.append((i, " ".join(own)))
    saved, save = {}, Scratch.save

    def spy(self, df, name, *args, **kwargs):
        out = save(self, df, name, *args, **kwargs)
        if name == "rest":
            saved[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for chunk in (simhash.CHUNK, 16):  # whole, and dealt out as pairs of chunks
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect()}
        sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
        pairs = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        assert got == union(pairs, sorted(sets)) and 20 < len(set(got.values())) < 180
        if chunk > 16:
            assert saved["rest"] < len(rows)
