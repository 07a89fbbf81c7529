"""Near duplicates, repeated spans, decontamination, packing, language model and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodeweave.llm import decontaminate, entries, kernel, lm, neardup, packing, sentences, tokens

from tests.conftest import MEDIUM, SMALL, same

from tests.llm.conftest import prose


def test_all_registered():
    assert [int(n[2:].split("_")[0]) for n in entries.QUERIES] == list(range(1, 11))
    assert set(entries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def jaccard(a, b):
    return len(a & b) / len(a | b)


def pairs_set(t):
    w = words(t)
    return set(zip(w, w[1:])) or set(w)


def similar_pairs(docs):
    """All pairs at the threshold; sizes rule out most."""
    ids = sorted((i for i in docs if docs[i]), key=lambda i: len(docs[i]))
    out = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(docs[a]) < neardup.THRESHOLD * len(docs[b]):
                break
            if jaccard(docs[a], docs[b]) >= neardup.THRESHOLD:
                out.append((a, b))
    return out


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else "zz" + w for w in text.split(" "))


def test_near_duplicates_reach_the_recall(spark):
    docs = {r.doc_id: pairs_set(r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    true = similar_pairs(docs)
    got = neardup.op6_near_duplicates(spark, MEDIUM).collect()
    root = {r.doc_id: r.duplicate_of for r in got}
    found = sum(root.get(a, a) == root.get(b, b) for a, b in true)
    assert true and found >= 0.95 * len(true)
    assert all(r.duplicate_of < r.doc_id for r in got)
    near = {x for p in true for x in p}
    assert len({r.doc_id for r in got} - near) <= 0.02 * len(near)


def test_large_groups_and_hot_regions(spark):
    """Hundreds of edited copies and of exact ones are one group each; unrelated documents are none."""
    rng = random.Random(5)
    origin, other = prose(rng, 150), prose(rng, 120)
    rows = [(i, edited(rng, origin, 0.04)) for i in range(400)] + [(2000 + i, other) for i in range(400)] + [(5000 + i, prose(rng, 80)) for i in range(200)]
    got = {r.doc_id: (r.duplicate_of, r.group_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i in got for i in range(1, 400)) >= 394 and len({got[i] for i in range(1, 400) if i in got}) == 1
    assert all(got[i] == (2000, 400) for i in range(2001, 2400))
    assert not any(i >= 5000 for i in got)


@pytest.mark.parametrize("share", [0.08, 0.1, 0.12])
def test_star_shaped_groups_equal_brute_force(spark, share):
    """Copies close to the original but not to each other: grouped as comparing all signatures groups them."""
    rng = random.Random(11)
    origin = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [(i, edited(rng, origin, share if i != 700 else 0)) for i in range(2000)]
    cp, at = kernel.code_points(pa.array([t for _, t in rows]))
    low = neardup.signatures(cp, at, neardup.TREES * neardup.DEPTH)[1].astype(np.uint8)
    left, group, want = np.ones(2000, bool), [700], set()
    left[700] = False
    while group:
        i = group.pop()
        want.add(i)
        new = left & (((low == low[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= neardup.THRESHOLD)
        left &= ~new
        group += np.flatnonzero(new).tolist()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    top = max(Counter(r.duplicate_of for r in got).items(), key=lambda x: x[1])[0]
    group = {r.doc_id for r in got if r.duplicate_of == top} | {top}
    assert group <= want and len(group) >= 0.95 * len(want) and len(want) > 1000


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.integers(0, 2**32))
def test_links_connect_what_all_pairs_connect(n, seed):
    low = np.random.default_rng(seed).integers(0, 3, (n, 20)).astype(np.uint8)
    low[n // 2 :] = low[: n - n // 2]
    low[n // 2 :, :5] = 7

    def labels(pairs):
        root = list(range(n))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {frozenset(i for i in range(n) if root[i] == r) for r in root}

    for threshold in (0.4, 0.6, 0.75):
        every = [(a, b) for a in range(n) for b in range(a) if ((low[a] == low[b]).mean() - 1 / 256) / (1 - 1 / 256) >= threshold]
        assert labels(neardup.links(low, threshold)) == labels(every)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_signature_agreement_estimates_similarity():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(100, 500))
    cp, at = kernel.code_points(pa.array([a, b]))
    _, sig, _ = neardup.signatures(cp, at, 512)
    assert (sig[0] == sig[1]).mean() == pytest.approx(299 / 499, abs=0.07)


def test_repeated_spans_equal_sql(spark, oracle):
    same(sentences.op8_sentence_spans(spark, SMALL), oracle, entries.ORACLE_SQL["op8_sentence_spans"])


def spans_by_definition(docs, least):
    """What stays of each text, sentence by sentence, from the definition: no regular expression of the operator's."""

    def cut(t):
        out, i = [], 0
        while i < len(t):
            k = i
            while k < len(t) and t[k] not in ".!?。！？\n":
                k += 1
            while k < len(t) and t[k] in ".!?。！？\n":
                k += 1
            while k < len(t) and (k > i and t[k - 1] in ".!?。！？\n \t\r\f") and t[k] in " \t\r\n\f":
                k += 1
            out.append(t[i:k])
            i = k
        return out

    def plain(s):
        for c in ".!?。！？\n\t\r\f":
            s = s.replace(c, " ")
        return tuple("".join(f" {c} " if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힣" else c for c in s.lower()).split(" ")) if s else ()

    first, gone = {}, defaultdict(set)
    for i, t in sorted(docs):
        u = [tuple(w for w in plain(s) if w) for s in cut(t)]
        for k in range(len(u)):
            n = k
            while n < len(u) and sum(map(len, u[k:n])) < least:
                n += 1
            if u[k] and sum(map(len, u[k:n])) >= least and first.setdefault(tuple(u[k:n]), (i, k)) != (i, k):
                gone[i] |= set(range(k, n))
    return {i: ("".join(s for k, s in enumerate(cut(t)) if k not in gone[i]), len(gone[i])) for i, t in docs if i in gone}


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(9)
    shared = prose(rng, 64)
    docs = [(3, prose(rng, 30) + ". " + shared + " " + prose(rng, 20)), (1, shared.upper() + "\n" + prose(rng, 40)), (2, prose(rng, 90)), (4, shared + " " + shared), (5, "A. B. C. D."), (6, "A. B. C. D.")]
    docs += [(7, "一二三四五。六七八九十！" * 2), (8, "x. 一二三四五。六七八九十！ 一二三四五。六七八九十！y"), (9, "...\n" + shared[:200]), (10, "word " * 30 + "end. And so on."), (11, "before. " + "word " * 30 + "end! after"), (12, "Go on. " * 40)]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentences.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == spans_by_definition(docs, sentences.WORDS) and set(got) == {3, 4, 8, 9, 11, 12}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "e f g", ". ", "! ", "\n", " ", "日", "。"]), max_size=30).map("".join), min_size=1, max_size=8))
def test_repeated_spans_of_any_text(spark, texts):
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.text, r.n_removed) for r in sentences.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert got == spans_by_definition(docs, 4)


def test_planted_passages_are_caught_and_the_rest_is_left(spark):
    """Passages of 51 to 90 words, cut anywhere and put in the middle of sentences."""
    rng = random.Random(3)
    docs = {i: words(prose(rng, 300)) for i in range(400)}

    def punctuated(w):
        out, k = [], 0
        while k < len(w):
            n = rng.randrange(2, 22)
            out.append(" ".join(w[k : k + n]) + rng.choice([". ", "! ", ".\n"]))
            k += n
        return "".join(out)

    texts, source = {i: punctuated(w) for i, w in docs.items()}, [punctuated(words(prose(rng, 120))).split(" ") for _ in range(20)]
    holders = {}
    for n, i in enumerate(range(0, 400, 2)):
        p = source[n % 20]
        a, size = 10 + n % 20, 51 + 2 * (n % 20)
        t = texts[i].split(" ")
        k = rng.randrange(len(t))
        texts[i] = " ".join([*t[:k], *p[a : a + size], *t[k:]])
        holders.setdefault(n % 20, []).append(i)
    got = {r.doc_id for r in sentences.cleaned(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    planted = {i for h in holders.values() for i in sorted(h)[1:]}
    assert len(got & planted) >= 0.95 * len(planted) and not got - planted


def test_a_passage_that_every_document_has(spark):
    rng = random.Random(8)
    line = "This line is a notice that all of them carry, word by word, whatever else they say. It has two sentences. "
    docs = [(i, prose(rng, 20) + ". " + line) for i in range(3000)]
    got = sentences.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 2999 and all(r.first_ids == [0] for r in got)


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    best = min(row)
    return best, row.index(best)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=25))
def test_bit_parallel_search(item, text):
    assert decontaminate.best_match(item, text) == edit_distance_in(item, text)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(5, 60))) for i in range(30)]
    docs = []
    for i in range(150):
        t = words(prose(rng, rng.randrange(0, 150)))
        if i % 2:
            w = words(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 1 + int(1.6 * decontaminate.RATE * len(w)))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 2)] = ["new"] * rng.randrange(0, 2)
            k = rng.randrange(len(t) + 1)
            t[k:k] = w
        docs.append((i, " ".join(t)))
    want = {}
    for d, t in docs:
        for i, x in items:
            dist, _ = edit_distance_in(words(x), words(t))
            if dist <= int(decontaminate.RATE * len(words(x))):
                want[d, i] = dist
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert set(found) <= set(want) and len(found) >= 0.95 * len(want) and len(want) > 50
    assert all(want[k] == d for k, d in found.items())
    text = dict(docs)
    for r in got:
        assert edit_distance_in(words(dict(items)[r.item_id]), words(text[r.doc_id][r.span_start : r.span_end]))[0] <= r.distance


def test_benchmark_in_blocks_gives_the_same(spark):
    docs, bench = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    one, many = (sorted(map(tuple, decontaminate.matches(docs, bench, block_words=n).collect())) for n in (10**6, 500))
    assert one == many and len(one) > 10
    kept = {r.doc_id for r in decontaminate.keep(docs, bench, block_words=500).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {m[0] for m in one}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, max(1, w - 1)), max_size=60))))
def test_plan_is_best_fit_decreasing(case):
    capacity, sizes = case
    sizes = [s for s in sizes if s <= capacity]
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else capacity) - s)
    steps, n = packing.plan(Counter(sizes), capacity)
    room, steps, count = [capacity] * n, sorted(steps), Counter(sizes)
    for i, (size, number, per, first, at) in enumerate(steps):
        end = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == size else count[size]
        for j in range(end - number):
            assert at + size * (j % per) + size <= capacity
            room[first + j // per] -= size
    assert sorted(room) == sorted(bins)


def test_packing_round_trip(spark):
    """Windows hold every token of every document once, in order, without gaps, and are as few as best-fit decreasing makes."""
    got = packing.place(packing.lengths(spark.read.parquet(f"{SMALL}/documents.parquet")), 256).collect()
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    ids = {r.doc_id: encode(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len({r.window_id for r in got}) == len(got) == max(r.window_id for r in got) + 1
    pieces = defaultdict(list)
    for r in got:
        at = 0
        for s in r.segments:
            assert s.window_start == at
            at += s.n_tokens
            pieces[s.doc_id].append((s.doc_start, ids[s.doc_id][s.doc_start : s.doc_start + s.n_tokens]))
        assert at == r.n_tokens <= 256
    assert {d: [t for _, p in sorted(x) for t in p] for d, x in pieces.items()} == {d: t for d, t in ids.items() if t}
    rests = Counter(len(t) % 256 for t in ids.values())
    del rests[0]
    assert len(got) == packing.plan(rests, 256)[1] + sum(len(t) // 256 for t in ids.values())


def test_language_model_equals_a_walk_of_the_automaton(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    w = {r.doc_id: words(r.text) for r in docs.collect()}
    counts = [Counter(tuple(x[a : a + n]) for x in w.values() for a in range(len(x) - n + 1)) for n in (1, 2, 3)]
    kept, total = [{k: v for k, v in c.items() if v >= lm.PRUNE} for c in counts], sum(map(len, w.values()))
    count = lambda h: kept[len(h) - 1].get(h, 0) if h else total

    def arc(h, x):
        if not h:
            return math.log((count((x,)) + lm.MU[0] / lm.UNKNOWN) / (total + lm.MU[0]))
        return math.log((count((*h, x)) + lm.MU[len(h)] * math.exp(cost(h[1:], x)[0])) / (count(h) + lm.MU[len(h)]))

    def cost(state, x):
        """What x costs from a state, by failure arcs if need be, and where it leads."""
        spent = 0.0
        while state and not (count(state) and count((*state, x))):
            spent += math.log(lm.MU[len(state)] / (count(state) + lm.MU[len(state)])) if count(state) else 0.0
            state = state[1:]
        return spent + arc(state, x), (*state, x)

    want = {}
    for d, x in w.items():
        state, log = (), 0.0
        for t, word in enumerate(x):
            state = tuple(x[max(0, t - 2) : t])
            log += cost(state, word)[0]
        want[d] = log
    for r in lm.score(docs, block=40_000).collect():
        assert r.n_words == len(w[r.doc_id]) and (r.n_words == 0 or r.log_probability == pytest.approx(want[r.doc_id]))


def test_probabilities_sum_to_one():
    """Over the vocabulary and all unknown words, from any history, but for what follows the ends of texts."""
    text = ["a b a b c a b c", "a b c d", "d d a b"]
    hashes, _, _ = lm.read(pa.array([" ".join((*h, x)) for h in ("ab", "ca") for x in "abcdz"]))
    counts = Counter(int(x) for h in lm.read(pa.array(text))[0] for x in h if x)
    totals = [np.array([float(counts[int(x)]) for x in h]) for h in hashes]
    p = np.exp(lm.traverse(hashes, totals, sum(len(t.split()) for t in text)))[2::3]
    for k in (0, 5):
        assert 0.97 < p[k : k + 4].sum() + (lm.UNKNOWN - 4) * p[k + 4] < 1 + 1e-9


def test_answered_counts_sum_to_one():
    """As a bucket answers them by default, from a history of which each continuation occurs once."""
    after = [f"x{i}" for i in range(40)]
    text, vocabulary = [f"q r {x}" for x in after], ["q", "r", *after]
    hashes, _, _ = lm.read(pa.array([f"q r {x}" for x in (*vocabulary, "unknown")]))
    key, n = lm.known(lm.read(pa.array(text))[0])
    asked, none = lm.known(hashes)
    t = pa.table({"bucket": [0, 0], "block": [0, 1], "keys": [lm.key_planes(key), lm.key_planes(asked)], "counts": [lm.planes(n), lm.planes(np.zeros_like(none))], "words": [3 * len(text), 0]})
    answer = lm.unplanes(lm._answer(lm.PRUNE)(t).column("totals")[1].as_py(), np.uint64)
    counts = dict(zip(asked.tolist(), answer.tolist()))
    totals = [np.array([float(counts.get(int(x), 0)) for x in h]) for h in hashes]
    p = np.exp(lm.traverse(hashes, totals, 3 * len(text)))[2::3]
    assert 0.99 < p[:-1].sum() + (lm.UNKNOWN - len(vocabulary)) * p[-1] < 1 + 1e-9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_keys_come_back(keys):
    keys = np.array(sorted(set(keys)), np.uint64)
    assert (lm.unkey(lm.key_planes(keys)) == keys).all() and (lm.unplanes(lm.planes(keys), np.uint64) == keys).all()


def test_pipeline_stages_take_effect(spark):
    out = corpus_pipeline.run(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    kept = {r[0] for r in out.select(F.explode("segments").alias("s")).select("s.doc_id").distinct().collect()}
    dups = {r.doc_id for r in neardup.op6_near_duplicates(spark, MEDIUM).collect()}
    leaks = {r.doc_id for r in decontaminate.op3_decontamination(spark, MEDIUM).collect()}
    bad = {r.doc_id for r in docs.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("quality = 0").collect()}
    good = {r.doc_id for r in docs.collect()} - dups - leaks - bad
    assert not kept & leaks and len(kept & bad) <= 0.1 * len(bad) and len(kept & dups) <= 0.1 * len(dups)
    assert len(good & kept) >= 0.85 * len(good)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage's rows from its predecessor's, by plain Python where a definition allows it."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    after = stages["near duplicates"](spark, docs, SMALL)
    sets = {r.doc_id: pairs_set(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, b in similar_pairs(sets):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want, got = {i for i in ids if find(i) == i}, {r.doc_id for r in after.collect()}
    assert len(want ^ got) <= 1
    bench = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in docs.collect() if any(edit_distance_in(w, words(r.text))[0] <= int(decontaminate.RATE * len(w)) for _, w in bench if len(set(w) & set(words(r.text))) >= 0.5 * len(set(w)))}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SMALL).collect()} == set(ids) - leaks
