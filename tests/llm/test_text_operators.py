"""The text operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeweave.llm import chat, decontaminate, exact_dedup, features, html_extract, jaccard_join, language_id, quality, sentencepiece_codec, token_store, toxicity
from cladeweave.llm.components import components
from cladeweave.llm.shared import fold_of, join_counted, split_by_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", " ", None, "a", "  a  b ", "▁x", "tab\tand\r\nline", "ünï ß é", "x" * 3000, "<|endoftext|> it's </s>", "日本語 テスト", "a\u00a0b", "word " * 4000]


def frame(spark, texts, extra=False):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id AS node", "text AS `sig`", "lang AS label") if extra else df


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"edit{rng.randrange(9999)}" for w in text.split(" "))


def shingles(text, k):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, num, den):
    sets, label = [shingles(t, k) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in range(len(texts))}


def near_corpus(seed, n=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = prose(rng, words, 40)
    texts = list(ODD_TEXTS)
    for _ in range(n):
        base = prose(rng, words, rng.choice([5, 30, 80, 200]))
        texts += [base, base, edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.08), base + " " + prose(rng, words, 4), shared + " " + base]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(
    ("k", "num", "work"),
    [(4, 85, {}), (5, 80, {}), (5, 80, {"memory_nodes": 2, "block_nodes": 3}), (4, 85, {"memory_nodes": 3, "block_nodes": 2, "pivots": 2, "leaf": 1}), (5, 80, {"key_bits": 4, "memory_nodes": 4})],
)
def test_jaccard_components_match_brute_force(spark, k, num, work):
    texts = near_corpus(k + num)
    got = jaccard_join.near_duplicates(frame(spark, texts, extra=True), k, num, 100, **work).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, k, num, 100)


def chained_sets(rng, families=12, steps=14, size=90):
    """Sets that drift away from their family's first one, so that links form chains longer than the radius."""
    out = []
    for f in range(families):
        now = set(range(1000 * f, 1000 * f + size))
        for step in range(steps):
            out.append(np.sort(jaccard_join.spans.mix64(np.array(sorted(now), dtype=np.uint64))))
            gone = rng.sample(sorted(now), rng.choice([1, 3, 6, 12]))
            now = (now - set(gone)) | {1000 * f + 500 + 20 * step + j for j in range(len(gone))}
    rng.shuffle(out)
    return out


def components_of_sets(sets, num, den):
    label = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            one, other = label[a], label[b]
            label = [min(one, other) if x in (one, other) else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(6))
def test_voronoi_cells_find_every_component(seed):
    rng = random.Random(seed)
    sets, num = chained_sets(rng), rng.choice([70, 80, 90])
    join = jaccard_join.Sets(sets, jaccard_join.Slicing(num, 100))
    join.voronoi(rng.choice([2, 5, 8]), rng.choice([1, 4]))
    want = components_of_sets(sets, num, 100)
    assert [join.root(x) for x in range(len(sets))] == want
    assert len(join.edges) == len(sets) - len(set(want))
    # Cells did the work: far fewer comparisons than pairs, and boundary sets were replicated.
    assert join.cells > 1 and join.replicas > 0 and join.compared < len(sets) * (len(sets) - 1) // 3


def test_large_regions_are_joined_over_tasks(spark):
    texts = [" ".join(f"w{v}" for v in h.tolist()) for h in chained_sets(random.Random(8), families=5)]
    sets = list(jaccard_join.shingle_sets(pa.array(texts), 1))
    nodes = [jaccard_join.set_key(h) for h in sets]
    stored = spark.createDataFrame([*zip(nodes, texts), (nodes[0], "another text of the id")], "node long, text string")
    placed = spark.createDataFrame([(j % 2, nodes[j], len(h)) for j, h in enumerate(sets)], "region long, node long, n long")
    want = [set(components_of_sets([h if j % 2 == side else np.array([j], dtype=np.uint64) for j, h in enumerate(sets)], 80, 100)) for side in (0, 1)]
    links = jaccard_join._join_large(placed, stored, jaccard_join.Keys(1), jaccard_join.Slicing(80, 100), 3, 2, 4).collect()
    label = list(range(len(sets)))
    for a, b in links:
        one, other = label[nodes.index(a)], label[nodes.index(b)]
        label = [min(one, other) if x in (one, other) else x for x in label]
    assert set(label) == {x for x in want[0] if x % 2 == 0} | {x for x in want[1] if x % 2 == 1}


def test_hot_slices_leave_in_blocks():
    rng = np.random.default_rng(4)
    runs = {7: np.arange(200_000), 9: np.arange(5), 11: np.arange(3), 13: np.arange(3), 15: np.array([1]), 2: np.arange(100_000, 140_000)}
    sig = np.concatenate([np.repeat(s, 2 * len(x)) for s, x in sorted(runs.items())])
    node = np.concatenate([np.repeat(x, 2) for _, x in sorted(runs.items())])
    cuts = np.sort(rng.choice(len(sig), 40))
    batches = [pa.record_batch([pa.array(sig[a:z]), pa.array(node[a:z])], names=["sig", "node"]) for a, z in zip([0, *cuts], [*cuts, len(sig)], strict=True)]
    found = pa.Table.from_batches(jaccard_join._meeting(iter(batches), 512)).to_pandas()
    assert found.groupby(["region", "block"]).size().max() <= 512
    want = sorted([200_000, 40_000, 5, 3])  # equal members are one region, single members none
    assert sorted(found.groupby("region").node.nunique()) == want and sorted(found.groupby("region").size()) == want
    assert set(found[found.many].groupby("region").size()) == {200_000, 40_000}


def test_jaccard_keeps_one_of_each_component(spark):
    texts = near_corpus(3, n=4)
    want = {d for d, (_, c) in brute_components(texts, 5, 80, 100).items() if d == c}
    kept = jaccard_join.keep_one(frame(spark, texts, extra=True))
    assert {r.doc_id for r in kept.collect()} == want
    assert kept.columns == frame(spark, [], extra=True).columns


def test_jaccard_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.near_duplicates(df).collect()) == [(-1, -1), (-1, 4), (4, 4)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 300), min_size=6, max_size=60, unique=True), st.lists(st.integers(0, 300), max_size=8), st.integers(70, 95))
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_slice(values, changes, num):
    slicing = jaccard_join.Slicing(num, 100)
    key = lambda s: np.sort(jaccard_join.spans.mix64(np.array(sorted(s), dtype=np.uint64)))
    a, b = set(values), set(values) ^ set(changes)
    if a != b and b and 100 * len(a & b) >= num * len(a | b):
        assert set(jaccard_join.slice_signatures(key(a), slicing)) & set(jaccard_join.slice_signatures(key(b), slicing))


def test_signatures_are_short():
    h = np.sort(jaccard_join.spans.mix64(np.arange(5000, dtype=np.uint64)))
    found = jaccard_join.slice_signatures(h, jaccard_join.Slicing(80, 100))
    assert len(set(found.tolist())) == len(found) > 1000 and found.min() >= 0 and int(found.max()).bit_length() == 40


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(20)}


def test_bitmaps_lose_no_id_and_joins_by_count_no_row(spark):
    docs = frame(spark, [str(k) for k in range(500)]).unionByName(spark.createDataFrame([(None, "n", "en", "s", 1)], DOCS)).selectExpr("*", "1 AS drop_id", "2 AS drop_word_")
    asked = spark.createDataFrame([(k,) for k in range(0, 500, 3)] + [(None,)], "x long")
    for bits, most in ((7, 500), (16, 200)):
        free, rest, name = split_by_ids(docs, docs["doc_id"], asked, bits)
        one, other = {r.doc_id for r in free.collect()}, {r[name]: r.doc_id for r in rest.collect()}
        assert set(range(0, 500, 3)) <= set(other) and all(k == v for k, v in other.items()) and len(other) <= most
        assert one | set(other) == {None, *range(500)} and not one & set(other) and free.columns == docs.columns
    left = spark.createDataFrame([(k % 7 if k < 60 else 1000 + k, k) for k in range(80)], "key long, v long")
    right = left.groupBy("key").count().where("key != 3 AND key != 1070")
    for how, want in (("inner", 80 - 9 - 1), ("left", 80)):
        got = join_counted(left, right, "key", "count", 80, how).collect()
        assert len(got) == want and all((r["count"] is None) == (r.key in (3, 1070)) for r in got)


@pytest.mark.parametrize("bits", [256, 3])
def test_exact_groups_even_when_digests_collide(spark, bits):
    texts = [*ODD_TEXTS, "a  b", "a b", "a\n b", "a b ", "c"] * 2
    rows = exact_dedup.exact_groups(frame(spark, texts, extra=True), digest_bits=bits, memtable_rows=5, fan_in=2, shard_rows=7).collect()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    want = {d: (norm.index(t), norm.count(t), norm.index(t) == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in enumerate(norm)}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want


def test_exact_dedup_keeps_columns_and_first_rows(spark):
    df = frame(spark, ["x", "y", "x ", "x", None, ""], extra=True)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_compaction_ends_with_one_sorted_run_of_each_shard(spark):
    rng = random.Random(3)
    entries = {}
    for run in range(9):
        for d in rng.sample(range(60), 25):
            entries[run, hashlib.sha256(b"%d" % d).digest()] = (rng.randrange(999), rng.randrange(1, 4))
    runs = spark.createDataFrame([(r, d, i, n) for (r, d), (i, n) in entries.items()], exact_dedup.RUNS)
    merged, shards = exact_dedup.compact(runs, fan_in=2, shard_rows=20)
    rows = merged.collect()
    want = {}
    for (_, d), (i, n) in entries.items():
        keep, total = want.get(d, (i, 0))
        want[d] = (min(keep, i), total + n)
    assert {bytes(r.digest): (r.keep_id, r.n) for r in rows if r.n} == {d: x for d, x in want.items() if x[1] > 1}
    for r in rows:
        if not r.n:
            held = [d for d, (_, n) in want.items() if n > 1 and exact_dedup.shard_of(d, shards) == r.shard]
            assert exact_dedup.RunFilter.from_bytes(bytes(r.digest)).has(held).all()
    assert shards > 1 and all(exact_dedup.shard_of(bytes(r.digest), shards) == r.shard for r in rows if r.n)


def test_run_filters_exclude_most_others():
    names = [hashlib.sha256(b"%d" % k).digest() for k in range(3000)]
    f = exact_dedup.RunFilter.from_bytes(exact_dedup.RunFilter(names[:1000]).to_bytes())
    assert f.has(names[:1000]).all() and f.has(names[1000:]).mean() < 0.1


def test_bytes_are_compared_when_texts_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 10)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", -1)
    texts = ["some longer text"] * 3 + ["some other text"] * 2 + ["x"]
    rows = exact_dedup.exact_groups(frame(spark, texts), digest_bits=1).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


ROWS = [(None, "a b c d e f"), (None, "a  b c d e f"), (1, "x y z u v w"), (1, "x y z u v w"), (1, "one text of its own"), (2, "x y z u v w"), (2, "and another one here"), (None, "x y z u v w"), (7, ""), (None, "k l m n o p")]


@pytest.mark.parametrize("keep", [exact_dedup.deduplicate, jaccard_join.keep_one])
def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark, keep):
    kept = keep(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    want = [(None, "a b c d e f"), (1, "x y z u v w"), (1, "one text of its own"), (2, "and another one here"), (7, ""), (None, "k l m n o p")]
    assert sorted((r.doc_id or -1, " ".join(r.text.split())) for r in kept) == sorted((d or -1, t) for d, t in want)


def labelled(spark, n=900):
    rng = random.Random(5)
    words = [a + b for a in ("ther", "on", "ed", "re", "ing", "st") for b in ("an", "ti", "ou", "ha", "ly", "sh")]
    rows, labels = [], []
    for d in range(n):
        text, toxic, good = prose(rng, words, rng.randrange(5, 120)), int(d % 6 == 0), int(d % 4 != 1)
        if toxic:
            text += " you stupid moron " + rng.choice(["scum", "trash"])
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((d, text, "en", "s", len(text)))
        labels.append((d, good, toxic))
    rows += [(n + k, t, "en", "s", 0) for k, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (n + 99, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_hold_out(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality IS NOT NULL").collect()}
    for rows, name in ((toxicity.score_documents(spark, docs, labels).collect(), "toxic"), (quality.score_documents(docs, labels).collect(), "quality")):
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][name] for r in held) / len(held) > 0.97
    clean = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    scored = toxicity.score_documents(spark, docs, labels).collect()
    assert clean == {r.doc_id for r in scored if not r.predicted}


def plain_ftrl(rows, size, epochs=3, seed=7, alpha=1.0, beta=1.0, l1=3.0, l2=1.0):
    """The textbook algorithm, coordinate by coordinate."""
    z, n, rng = {}, {}, np.random.default_rng(seed)

    def weight(i):
        if i == size:
            return -z.get(i, 0.0) / ((beta + n.get(i, 0.0) ** 0.5) / alpha)
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, terms = rows[k]
            w = {i: weight(i) for i in [*terms.tolist(), size]}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - y
            for i in w:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return np.array([weight(i) for i in range(size + 1)])


def test_ftrl_against_the_plain_algorithm():
    rng = np.random.default_rng(3)
    rows = [(int(k % 3 == 0), np.unique(np.concatenate((rng.integers(0, 30, 6), [31] if k % 3 == 0 else [30])))) for k in range(90)]
    got = toxicity.Ftrl(size=33).fit(rows)
    assert np.allclose(got, plain_ftrl(rows, 32)) and got[31] > 1 > -1 > got[30] and (got[:30] == 0).sum() > 3


def test_toxicity_scores_against_plain_sums(spark):
    docs, labels = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    assert weight
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        terms = next(iter(toxicity.distinct_terms(pa.array([r.text or ""]))))[0]
        total = model[2] + sum(weight.get(int(t), 0.0) for t in terms)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -35, 35)))) and r.predicted == (r.score >= 0.5)


def test_repeated_terms_are_features():
    column = pa.array(["scumbag", "scumbag scumbags", "scumbag scumbags scumbaggy scumbagged"])
    one, two, four = (set(t.tolist()) for t, _ in toxicity.distinct_terms(column))
    buf = np.frombuffer(b"scumbag", np.uint8)
    stem = next(iter([g for g in toxicity.term_groups(buf, np.array([0, 7]))][2][0]))  # the beginning of seven bytes
    twice, often = (int(toxicity.again(np.array([stem], np.uint32), c)[0]) for c in toxicity.AGAIN)
    assert int(stem) in one and twice not in one and twice in two and often not in two and {twice, often} <= four


def plain_quality(rows, bits, epochs=6, rate=1.0, seed=11):
    """Averages of bucket vectors, softmax and gradient steps, one number at a time."""
    d = quality.DIMENSIONS
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / d, 1 / d, (1 << bits, d)).astype(np.float32)
    out, bias, done = np.zeros((2, d)), np.zeros(2), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, counts = rows[k]
            total = float(sum(counts))
            h = [sum(float(np.float32(c / total)) * float(vectors[b, j]) for b, c in zip(at, counts)) for j in range(d)]
            logits = [sum(out[c, j] * h[j] for j in range(d)) + bias[c] for c in (0, 1)]
            e = np.exp(np.array(logits) - max(logits))
            p = e / e.sum()
            p[y] -= 1
            step = rate * (1 - done / (epochs * len(rows)))
            done += 1
            move = [step * sum(p[c] * out[c, j] for c in (0, 1)) for j in range(d)]
            for b, c in zip(at, counts):
                for j in range(d):
                    vectors[b, j] -= np.float32(min(np.float32(c / total) * 50, 1)) * np.float32(move[j])
            for c in (0, 1):
                out[c] -= step * p[c] * np.array(h)
                bias[c] -= 0.1 * step * p[c]
    return vectors, out, bias


def test_quality_training_against_plain_gradient_descent():
    rng = np.random.default_rng(8)
    rows = []
    for k in range(24):
        at = np.unique(np.append(rng.integers(0, 60, 5), 62 + k % 2))
        rows.append((k % 2, at, rng.integers(1, 4, len(at))))
    for a, b in zip(quality.train(rows, 6), plain_quality(rows, 6), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_language_machine_against_plain_averaging():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 20, 6)), None) for _ in range(40)]
    rows = [(np.append(at, 20 + k % 2), rng.uniform(0.2, 1, len(at) + 1)) for k, (at, _) in enumerate(rows)]
    signs = np.array([1 if k % 2 else -1 for k in range(40)])
    w, bias = language_id.svm(rows, signs, 22, epochs=3)
    v, b, mean, b_mean, t, order = np.zeros(22), 0.0, np.zeros(22), 0.0, 0, np.random.default_rng(5)
    share = {1: 0.5 * 40 / 20, -1: 0.5 * 40 / 20}
    for _ in range(3):
        for k in order.permutation(40):
            t += 1
            (at, x), y = rows[k], signs[k]
            step = 1 / (1e-4 * (t + 1e4))
            margin = y * (v[at] @ x + b)
            v = v * (1 - step * 1e-4)
            if margin < 1:
                v[at] += step * y * share[y] * x
                b += 0.01 * step * 1e-4 * y * share[y]
            mean, b_mean = mean + v, b_mean + b
    assert np.allclose(w, mean / t) and bias == pytest.approx(b_mean / t)
    assert all(np.sign(w[at] @ x + bias) == y for (at, x), y in zip(rows, signs))


def test_empty_and_repeated_rows_in_classifiers(spark):
    docs, labels = labelled(spark, 200)
    more = docs.unionByName(docs.limit(5)).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS held_out", "4 AS label")
    for made in (toxicity.score_documents(spark, more, labels), quality.score_documents(more, labels), language_id.identify(more)):
        rows = made.collect()
        assert len(rows) == more.count() and len(set(rows)) == docs.count()
    nothing = docs.limit(0)
    assert toxicity.score_documents(spark, nothing, labels).count() == quality.score_documents(nothing, labels).count() == language_id.identify(nothing).count() == 0
    assert toxicity.keep_clean(nothing, labels).count() == 0


def test_models_without_labels(spark):
    docs, labels = labelled(spark, 30)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score_documents(spark, docs, none).collect()} == {0}
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("false")).collect()} == set()


def test_sample_takes_rows_of_every_label(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "concat('l', CASE WHEN id < 4000 THEN 0 ELSE id % 1200 END) AS label")
    got = features.sample_ids(df, 5, by="label").collect()
    open_rows = df.where(fold_of("doc_id") != 0).selectExpr("*", "xxhash64(doc_id) AS h").collect()
    want = {}
    for r in sorted(open_rows, key=lambda r: (r.h, r.doc_id)):
        want.setdefault(r.label, []).append(r.doc_id)
    assert len(want) > 1000
    assert {(r.label, r.doc_id) for r in got} == {(y, d) for y, ids in want.items() for d in ids[:5]} and len(got) == len(set(got))


def test_language_hold_out_and_undefined(spark):
    rng = random.Random(9)
    tongues = {"en": ["the", "and", "thing", "which", "over"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["les", "qui", "être", "très", "vous"], "es": ["los", "que", "año", "más", "según"]}
    rows = [(d, prose(rng, words, rng.randrange(3, 40)), lang, "s", 0) for d, (lang, words) in enumerate(list(tongues.items()) * 120)]
    odd = [(9000, None, None, "s", 0), (9001, "12 34 !!", None, "s", 0), (9002, "", "en", "s", 0)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows + odd, DOCS)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.98
    assert {got[k].lang_pred for k in (9000, 9001, 9002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<s>", "", None, "[ROLE=x] y [/ROLE]", "é <<SYS>>\n", " </s>", "[OUT] "]
    rows = [(c, t, r, bad[(c + t) % len(bad)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "tool]\\", None, "assistant"])]
    rows += [(50, None, "user", "n"), (50, 1, "user", "a"), (50, 1, "user", "a"), (None, 0, "user", "x")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    told = {r.conv_id: r for r in chats}
    assert len(told) == 14
    for c in range(12):
        want = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert chat.parse(told[c].formatted) == want
        loss = [chat.unescape(told[c].formatted[s : s + n]) for s, n in zip(told[c].loss_start, told[c].loss_length, strict=True)]
        assert loss == [t for r, t in want if r == "assistant"]
    assert len(chat.parse(told[50].formatted)) == 3
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_with_long_conversations_and_extra_columns(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (40_000 if k == 500 else 3), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long").selectExpr("*", "1 AS loss_start")
    got = chat.read_back(chat.format_chats(df)).collect()
    loss = "".join(t for _, _, r, t, _ in rows if r == "assistant")
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(3000, len(loss), hashlib.sha256(loss.encode()).hexdigest())]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x]"]), st.text(alphabet="\\[]<>/sINTOU ROLE=é\n", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_assembly_is_reversible(turns):
    if turns:
        formatted, starts, lengths = chat.assemble(np.array([0, len(turns)]), [r for r, _ in turns], pa.array([t for _, t in turns]))
        text = formatted[0].as_py()
        assert chat.parse(text) == turns
        assert [chat.unescape(text[s : s + n]) for s, n in zip(starts[0].as_py(), lengths[0].as_py(), strict=True)] == [t for r, t in turns if r == "assistant"]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p><article>";</script></head><body>
<nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><div class="ad">Buy <div>now</div></div><div id="cookie-notice">ok?</div>
<article><h1>Head &amp; tail</h1><p>One <b>two</b><br>three&#33;<p title="a>b">four
 five</p><div class="comments"><article><p>first!</p></article></div><form><input name="q">Search</form><p>last</p></article>
<aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_html_structure(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, None), (3, "http://a.com", ""), (4, "u", "<p>only &lt;b&gt; text"), (5, "u", "<main><p>unclosed <script>x")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "Head & tail\nOne two\nthree!\nfour five\nlast", 2: "", 3: "", 4: "only <b> text", 5: "unclosed"}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_html_attributes_are_read_one_by_one():
    kept = ["href='/hidden-valley'", 'title="a hidden gem"', 'data-hidden="false"', 'href="/x?id=comments"', 'data-role="search"', "href=/a?class=ad", 'data-x="a" title=\'id="ad"\'']
    gone = ["hidden", "HIDDEN=''", "aria-hidden = true", 'data-x="y" role="search"', "class='main-menu'", 'id=nav', 'style="color:red; display : none"', 'title="a"hidden', 'href=/x id="ads"']
    page = "<article>" + "".join(f"<span {a}>k{n} </span>" for n, a in enumerate(kept)) + "".join(f"<span {a}>g{n} </span>" for n, a in enumerate(gone)) + "<p>so <math><mi>x</mi>=<mn>2</mn></math></p></article>"
    assert html_extract.main_text(page) == " ".join(f"k{n}" for n in range(len(kept))) + "\nso x=2"


def test_host_suffix_array_keeps_unique_runs(spark):
    shared = "welcome to our little site please read the rules before you post"
    rows = [(k, "http://h.org/%d" % k, f"<div>{shared}</div><p>{k} is the text of page {k}</p>") for k in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=4).collect()
    assert {r.text for r in got} == {f"{k} is the text of page {k}" for k in range(9)}
    streams = [np.array(s) for s in ([1, 2, 3, 4, 9], [8, 1, 2, 3, 4], [1, 2, 3, 4], [7, 7], [1, 2, 3, 4])]
    covered = html_extract.repeated_tokens(streams, 3, 3)
    assert [c.tolist() for c in covered] == [[True] * 4 + [False], [False] + [True] * 4, [True] * 4, [False, False], [True] * 4]


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_suffix_array_and_repeats_against_brute_force(pages, least_tokens, least_pages):
    flat = np.array([t for k, page in enumerate(pages) for t in [*page, -1 - k]])
    order, common = html_extract.suffix_array(flat)
    suffixes = [flat[k:].tolist() for k in range(len(flat))]
    assert order.tolist() == sorted(range(len(flat)), key=lambda k: suffixes[k])
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    seen = {}
    for page in pages:
        for k in range(len(page) - least_tokens + 1):
            seen.setdefault(tuple(page[k : k + least_tokens]), set()).add(tuple(page))
    occurs = lambda w: sum(tuple(p[k : k + least_tokens]) == w for p in pages for k in range(len(p) - least_tokens + 1))
    want = []
    for page in pages:
        drop = [False] * len(page)
        for k in range(len(page) - least_tokens + 1):
            w = tuple(page[k : k + least_tokens])
            if len(seen[w]) >= least_pages and occurs(w) > 1:
                drop[k : k + least_tokens] = [True] * least_tokens
        want.append(drop)
    got = html_extract.repeated_tokens([np.array(p, dtype=np.int64) for p in pages], least_tokens, least_pages)
    assert [c.tolist() for c in got] == want


def test_marked_pages_teach_the_host_its_boilerplate(spark):
    note = "this site is kept by volunteers who like long evenings and tea"
    rows = [(k, f"http://h.org/{k}", f"<div class='footer'>{note}</div><article><header><h1>T{k}</h1></header><p>{note} inside</p></article><!-- <article> -->") for k in range(3)]
    rows += [(7, "http://h.org/7", f"<p>own words</p><div>{note}</div><!-- <article> no --><script>'<main>'</script>"), (8, "http://i.org/8", f"<p>own words</p><div>{note}</div>")]
    rows += [(9, None, None), (9, None, None), (10, None, "<nav>only a menu</nav>"), (None, "x", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS `key`", "3 AS body", "4 AS text")
    got = html_extract.extract(df, group_pages=2).collect()
    assert len(got) == len(rows) and html_extract.extract(df.limit(0)).count() == 0
    text = {r.page_id: r.text for r in got}
    assert [text[k] for k in range(3)] == [f"T{k}\n{note} inside" for k in range(3)]
    # All streams of marked pages are equal, so they are one page; a second and a third are needed.
    assert text[7] == f"own words\n{note}" and text[8] == f"own words\n{note}"
    assert text[9] == "" and text[10] == "" and text[None] == " ".join(["long"] * 200_000)
    rows = [(k, u, h.replace("</div>", f"</div><nav>{k} menu</nav>", 1) if k is not None and k < 3 else h) for k, u, h in rows]
    more = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in more}[7] == "own words"


def test_repeats_are_found_across_the_groups_of_a_large_host(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    own = [prose(rng, words, 20) for _ in range(120)]
    thrice, twice, note = (prose(rng, words, 12) for _ in range(3))
    bodies = [[x] for x in own]
    for d in (3, 50, 99):
        bodies[d].append(thrice)
    for d in (7, 70):
        bodies[d].append(twice)
    bodies += [[note, own[0] + " tail"], [note, own[0] + " tail"], [note + " " + own[0] + " tail"], []]  # equal streams are one page
    rows = [(d, f"http://big.org/{d}", "".join(f"<p>{x}</p>" for x in b)) for d, b in enumerate(bodies)]
    rows += [(1000 + d, f"http://other.org/{d}", f"<p>{own[d]}</p><p>{twice}</p>") for d in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r.page_id: r.text for r in html_extract.extract(df, group_pages=n).collect()} for n in (4, 1000)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert found[0][3] == own[3] and found[0][7] == f"{own[7]}\n{twice}" and found[0][120] == f"{note}\n{own[0]} tail" and found[0][1000] == own[0]


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aé<>s/"), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_sentencepiece_equals_library(text):
    c = sentencepiece_codec.codec(SP)
    ids = [*c.sp.encode(text), c.end]
    assert c.encode(text) == ids
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert c.digest(text) == (len(ids), h(" ".join(map(str, ids))), h(c.sp.decode(ids)))


def test_sentencepiece_frames(spark):
    df = frame(spark, ODD_TEXTS, extra=True)
    both = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_ids(df, SP), SP)
    assert sorted(both.collect()) == sorted(sentencepiece_codec.encode_and_decode(df, SP).collect())
    lib = sentencepiece_codec.codec(SP).sp
    for r in both.collect():
        assert r.token_ids == [*lib.encode(r.text or ""), 2] and r.decoded == lib.decode(lib.encode(r.text or ""))
    assert sentencepiece_codec.round_trip_digests(df.limit(0), SP).count() == 0


def test_sentencepiece_refuses_to_overwrite_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", [1])], "doc_id long, text string, decoded string, token_ids array<int>")
    with pytest.raises(ValueError, match="token_ids"):
        sentencepiece_codec.encode_ids(df, SP)
    with pytest.raises(ValueError, match="decoded"):
        sentencepiece_codec.decode_ids(df, SP)


def test_sentencepiece_table_is_bounded():
    c = sentencepiece_codec.ChunkCodec(SP, table_entries=5)
    text = " ".join(f"w{k}" for k in range(40))
    assert c.encode(text) == [*c.sp.encode(text), 2] and len(c.table) <= 5


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sltrem1²é%$aß\u00a0"), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_byte_bpe_equals_library(text):
    t = token_store.token_table(BPE)
    assert t.by_table
    assert t.ids(text).tolist() == t.lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(ids, bits), bits, len(ids)) == ids).all()


def test_token_files(spark, tmp_path, monkeypatch):
    texts = ODD_TEXTS + [f"text number {k} " * k for k in range(60)]
    df = frame(spark, texts, extra=True).repartition(5)
    folder = f"file://{tmp_path}/ids"
    manifest = token_store.write_files(df, folder, BPE, 2, files=3)
    lib = token_store.token_table(BPE).lib
    ids = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    got = sorted(tuple(r) for r in token_store.read_digests(manifest).collect())
    assert got == [(d, int(starts[d]), len(x), zlib.crc32(x.tobytes())) for d, x in enumerate(ids)]
    with open(sorted(tmp_path.glob("ids/*.ids"))[0], "rb") as f:
        first = token_store.TokenFile(f)
        assert first.document(9).tolist() == ids[9].tolist()
    assert token_store.store_and_read(spark, df.limit(0), BPE).count() == 0


def test_token_files_with_null_and_hot_ids(spark, tmp_path):
    rng = random.Random(1)
    rows = [(None, "no id"), (None, None), (3, "three"), (3, "three"), *((40, f"text {k}") for k in range(300)), *((k, "word " * rng.randrange(9)) for k in range(50, 80)), (99, "long " * 150_000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(3)
    manifest = token_store.write_files(df, f"file://{tmp_path}/ids", BPE, 2, files=8).collect()
    assert sum(r.documents for r in manifest) == len(rows) and max(r.documents for r in manifest) < 200
    lib = token_store.token_table(BPE).lib
    got, last = [], None
    for r in sorted(manifest):
        with open(r.file.removeprefix("file://"), "rb") as f:
            file = token_store.TokenFile(f)
            for k, d in enumerate(file.doc_ids.tolist()):
                assert last is None or last <= d
                last = d
                got.append((d, lib.decode(file.document(k)[:-1].tolist(), skip_special_tokens=False)))
    assert sorted(got) == sorted((token_store.NO_ID if d is None else d, t or "") for d, t in rows)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(300)] + ["the", "of", "and"] * 60
    items = [prose(rng, words, rng.randrange(13, 40)) for _ in range(12)]
    texts = [prose(rng, words, 150) for _ in range(40)] + ODD_TEXTS
    want = set()
    for d in range(0, 36, 3):
        item = d // 3
        leak = items[item] if d % 2 else edited(rng, items[item], 0.1)
        texts[d] += f"\n{leak.upper()}! " + prose(rng, words, 30)
        want.add((d, item))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    found = decontaminate.find_leaks(frame(spark, texts, extra=True), bench).collect()
    clear = {(r.doc_id, r.item_id) for r in found}
    assert want <= clear
    assert {d for d, _ in clear} == {d for d, _ in want}
    kept = {r.doc_id for r in decontaminate.keep_clean(frame(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0


def test_leaks_against_all_pairs(spark):
    rng = random.Random(11)
    words = [f"u{k}" for k in range(250)] + ["the", "of"] * 30
    items = [prose(rng, words, n) for n in (1, 2, 3, 6, 14, 25, 40, 60)]
    items[0] = "word7"
    texts = [prose(rng, words, 60) for _ in range(50)] + ["", None, "word7", "Word7!", "word7 and more words", items[1], items[2].upper()]
    for d in range(0, 50, 2):
        at, item = rng.randrange(50), items[3 + d % 5]
        w = texts[d].split(" ")
        texts[d] = " ".join([*w[:at], edited(rng, item, rng.choice([0, 0.1, 0.25])), *w[at:]])
    texts += ["word7 " * 4] * 3
    hashes = lambda t: [w for _, h, of in decontaminate._words(pa.array([t])) for w in [h]][0]
    want = {}
    for i, item in enumerate(items):
        for d, text in enumerate(texts):
            if text and len(hashes(text)):
                score = decontaminate.align([hashes(text)], [hashes(item)])[0] / len(hashes(item))
                # A common word alone is a leak only as the whole document; chance pairs of words are none.
                if score >= 0.5 and (i or len(hashes(text)) == 1):
                    want[d, i] = round(float(score), 6)
    df = frame(spark, texts, extra=True)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(df, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert {(52, 0), (53, 0)} <= set(got) and (54, 0) not in got
    short = {k for k in want if k[1] in (1, 2)}  # one shared word is half of two or three words, but no seed
    assert {k: want[k] for k in set(want) - short} == {k: x for k, x in got.items() if k[1] not in (1, 2)}
    assert set(got) & short >= {(55, 1), (56, 2)} and all(got[k] == want[k] for k in set(got) & short)


def test_repeated_and_null_ids_in_decontamination(spark):
    leak = "seven quick words that leak from tests"
    rows = [(1, leak), (1, "x " + leak), (None, leak), (None, "clean"), (2, "clean too"), (2, "clean too")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item_id")
    bench = spark.createDataFrame([(0, leak), (0, leak), (None, "seven quick words that leak")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.find_leaks(df, bench).collect()}
    assert found == {(1, 0, 0), (None, 0, 0), (1, None, 0), (None, None, 0)}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "clean"), (2, "clean too"), (2, "clean too")]


def test_alignment_scores_against_plain_smith_waterman():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64)) for _ in range(60)]

    def plain(a, b):
        h, g = np.zeros((len(a) + 1, len(b) + 1)), decontaminate.PENALTY
        for i, j in np.ndindex(len(a), len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -g), h[i, j + 1] - g, h[i + 1, j] - g)
        return h.max()

    got = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [plain(a, b) for a, b in pairs])


@given(st.integers(0, 10**6), st.integers(100, 6000), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_count_vectors_do_not_enlarge_differences(seed, size, changes):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[changes:], rng.integers(0, 1 << 63, changes * 2).astype(np.uint64))))
    if len(a) and len(b):
        one, two = jaccard_join._vectors_of([jaccard_join.count_vector(a), jaccard_join.count_vector(b)])
        assert np.abs(one - two).sum() <= len(np.setxor1d(a, b)) and one.sum() == len(a) and two.sum() == len(b)
        assert (jaccard_join._vectors_of([jaccard_join._packed(np.array([0, 300])), jaccard_join._packed(np.array([70000, 1, 2, 3]))]) == [[0, 300], [70001, 5]]).all()
