"""Rules of extraction, samples and hot slices against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cladeweave.llm import features, html_extract, jaccard_join, language_id
from cladeweave.llm.shared import bitmap_bits


@pytest.mark.parametrize("name", ["post has-sidebar", "entry no-comments", "post related-topics", "content share-enabled", "with-header", "page not-ad"])
def test_classes_that_only_mention_a_name_are_kept(name):
    for tag in ("main", "article", "div role=main"):
        assert html_extract.main_text(f'<{tag} class="{name}"><p>hello</p></{tag.split()[0]}>') == "hello"
    assert html_extract.main_text(f'<div class="{name}"><nav>menu</nav><article><p>hello</p></article></div>') == "hello"
    assert html_extract.main_text(f'<p>before</p><div id="{name}"><p>hello</p></div>') == "before\nhello"


@pytest.mark.parametrize("name", ["sidebar", "site-header", "ad-slot-2", "nav-links", "cookie_banner", "comments-area", "post related", "Social"])
def test_classes_that_are_a_name_are_skipped(name):
    assert html_extract.main_text(f'<p>a</p><div class="{name}"><p>b</p></div><p>c</p>') == "a\nc"


def test_marked_articles_win_over_names_around_them():
    text = html_extract.main_text
    assert text('<form><main class="widget"><p>t</p><div class="comments"><article class="comment">c</article></div></main></form>') == "t"
    assert text('<div class="sidebar"><article><p>t</p></article></div>') == "t"
    assert text('<article><p>t</p></article><aside><article>card</article></aside>') == "t"
    assert text('<article><p>t</p><article class="comment"><p>c</p></article></article>') == "t"
    assert text('<header class="header"><nav>menu</nav></header><p>plain</p>') == "plain"


def test_skipped_inline_elements_do_not_end_a_block():
    text = html_extract.main_text
    assert text("<p>We <span class='ad'>x</span>go</p>") == "We go"
    assert text("<article><p>We <button>x</button>go <b>on</b></p></article>") == "We go on"
    assert text("<p>a <span class=ad>x<div>y</div></span>b</p><p>c</p>") == "a b\nc"
    assert text("<p>left <span class='ad'>never closed") == "left"
    assert text("<p>one</p><div class=ad>x</div>two") == "one\ntwo"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><nav>menu</div><article><p>t</p></article>", "t"),
        ("<article><p>a</p><div class=ad>x<p>y</div><p>b</p></article>", "a\nb"),
        ("<article><div><form><p>f</div><p>b</p></article>", "b"),
        ("<article><ul><li class=ad>x<ul><li>y</ul><li>b</ul><p>c</p></article>", "b\nc"),
        ("<article><dl><dt class=ad>x<dd>b</dl></article>", "b"),
        ("<article><table><tr class=ad><td>x<tr><td>a<td class=ad>y<td>b</table></article>", "a b"),
        ("<article><div class=ad><table><tr><td></div>x</table></div>b</article>", "b"),
        ("<article><p>a <span class=ad>x</p>b<p>c</p></article>", "a\nb\nc"),
        ("<article><b class=ad>x<div>q</b>y</div></b>b</article>", "b"),
        ("<article><nav/><p>We <span class=ad />go</p><div class=ad data-u=/x/>y</div></article>", "We go"),
        ("<head><title>t</title><body><p>b</p>", "b"),
        ("<div role=main><span class=ad>x</div>b", "b"),
    ],
)
def test_elements_that_are_not_closed_end_with_those_around_them(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("between", ["<svg-icon></svg-icon>", "<title-bar></title-bar>", '<svg class="x"/>', "<!-->", "<!-- c --!>", "<script>x</script foo>", "<a title=it's></a>", "<!--[if !IE]><!-->"])
def test_tags_end_where_html_ends_them(between):
    assert html_extract.main_text(f"<article><p>a</p>{between}<p>it's b</p></article>") == "a\nit's b"


def test_marks_of_comments_and_cards_do_not_replace_the_text():
    text = html_extract.main_text
    for around in ("<div class=comments><article>c</article></div>", "<aside><article>card</article></aside>", "<div data-role='main'></div>", "<nav role=main-nav>m</nav>"):
        assert text(f"<div class=post><p>The whole story</p></div>{around}") == "The whole story"
    assert text("<div>Logo</div><div class=sidebar><article>The whole story</article></div>") == "The whole story"


def test_many_open_elements_take_linear_time():
    deep = "<article>" + "<div class=ad><span><p>x</q></div>" * 20_000 + "<b>" * 20_000 + "<p>a</i>" * 20_000
    assert html_extract.main_text(deep) == "\n".join(["a"] * 20_000)


def plain_extract(pages, least_tokens, least_pages):
    """Text of unmarked pages without the windows of tokens that are on enough different pages of the host."""
    blocks = {k: [p for p in body] for k, (_, body) in enumerate(pages)}
    windows: dict = {}
    for k, (host, _) in enumerate(pages):
        words = tuple(w for b in blocks[k] for w in b.split())
        for at in range(len(words) - least_tokens + 1):
            windows.setdefault((host, words[at : at + least_tokens]), set()).add(words)
    out = []
    for k, (host, _) in enumerate(pages):
        words = [w for b in blocks[k] for w in b.split()]
        drop = [False] * len(words)
        for at in range(len(words) - least_tokens + 1):
            if len(windows[host, tuple(words[at : at + least_tokens])]) >= least_pages:
                drop[at : at + least_tokens] = [True] * least_tokens
        at, kept = 0, []
        for b in blocks[k]:
            n = len(b.split())
            left = [w for w, d in zip(b.split(), drop[at : at + n], strict=True) if not d]
            at += n
            kept += [" ".join(left)] if left else []
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("group_pages", [256, 3])
def test_pages_without_marks_against_plain_windows(spark, group_pages):
    rng = random.Random(group_pages)
    words = [f"w{k}" for k in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(4, 9))] for _ in range(4)]
    pages = []
    for k in range(30):
        blocks = [" ".join(rng.choice(shared) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(1, 7))]) for _ in range(rng.randrange(0, 6))]
        pages.append((f"h{k % 3}.org", blocks))
    pages += [pages[0]] * 3
    rows = [(k, f"http://{host}/{k}", "".join(f"<p>{b}</p>" for b in blocks)) for k, (host, blocks) in enumerate(pages)]
    rows.append((99, "http://h9.org/", "<article><p>marked</p></article><p>menu</p>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=group_pages, least_tokens=4, least_pages=3).collect()}
    want = plain_extract(pages, 4, 3)
    assert got.pop(99) == "marked" and [got[k] for k in range(len(pages))] == want
    assert any(len(t.split()) < sum(len(b.split()) for b in p[1]) for t, p in zip(want, pages, strict=True))


def test_long_documents_keep_the_same_features():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 1 << 20, 900)).astype(np.uint32), np.unique(rng.integers(0, 1 << 20, 700)).astype(np.uint32)
    both = np.union1d(a, b)
    few, counts = features.thinned(a, np.arange(len(a)), 100)
    assert len(few) == 100 and (np.diff(few.astype(int)) > 0).all() and (a[counts] == few).all()
    whole, _ = features.thinned(both, np.ones(len(both)), 100)
    assert set(whole.tolist()) & set(a.tolist()) <= set(few.tolist())  # what stays in a longer document stays in a shorter one
    assert features.thinned(a, a)[0] is a


def test_many_labels_are_bounded_and_whole_samples_are_learned(spark, monkeypatch):
    monkeypatch.setattr(features, "MOST_TERMS", 8)
    rows = [(k, f"text {k} " + " ".join(f"w{j}" for j in range(k % 40)), "en" if k % 2 else "de" if k % 4 else f"x{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.selectExpr("doc_id", "lang AS label")
    sample = features.sample_ids(labelled, 50, by="label", most_labels=2)
    counts = {r.label: r.n for r in sample.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert set(counts) == {"en", "de"} and max(counts.values()) <= 50
    got = features.sample_features(docs, sample, lambda c: features.counted(c, language_id.FEATURES))
    assert len(got) == sum(counts.values()) and all(len(x) <= features.MOST_TERMS or len(x) > 0 for _, x, _ in got)
    model = language_id.fit(docs, bound=30, most_labels=2)
    assert sorted(y for m in model.members.values() for y in m) == ["de", "en"]


def test_votes_against_a_plain_count():
    rng = np.random.default_rng(5)
    members = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "xx": ["xx"]}
    families, pairs = sorted(members), [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    model = language_id.Model(families, members, pairs, np.zeros((1, 7)), np.zeros(7))
    margins = np.round(rng.normal(size=(300, 7)), 1)
    margins[:20, 3:] = 0.0  # equal votes: a rounds to the first of a pair
    names, scores = language_id.decide(model, margins)
    squash = lambda m: 1 / (1 + np.exp(-2 * m))
    for row, name, score in zip(margins, names, scores, strict=True):
        family = families[int(row[:3].argmax())]
        votes, chance = {y: 0.0 for y in members[family]}, {y: 1.0 for y in members[family]}
        for (a, b), m in zip(pairs, row[3:], strict=True):
            if a in votes:
                won, lost = (a, b) if m >= 0 else (b, a)
                votes[won] += 1
                votes[a] += 1e-3 * np.tanh(m)
                votes[b] -= 1e-3 * np.tanh(m)
                chance[a], chance[b] = min(chance[a], squash(m)), min(chance[b], squash(-m))
        best = max(votes, key=lambda y: votes[y])
        assert name == best and np.isclose(score, squash(row[:3].max()) * chance[best])


def test_hot_slices_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 16)
    rng = np.random.default_rng(2)
    hot, rows = 77, []
    for node in range(300):
        own = rng.integers(0, 1 << 40, 3).tolist() + ([hot] if node < 200 else []) + ([55] if node in (1, 2, 250) else [])
        rows.append((node, bytearray(np.array(own, dtype=np.int64).tobytes())))
    folder = spark.createDataFrame(rows, "node long, sigs binary").repartition(5)
    found = {r.sig: r.salts for r in jaccard_join._hot(folder, jaccard_join._hold(4)).collect()}
    assert set(found) == {hot} and found[hot] > 8
    got = jaccard_join._members(folder, 4).collect()
    regions: dict = {}
    for r in got:
        regions.setdefault(r.region, []).append(r)
    big = [x for x in regions.values() if len(x) > 3]
    assert len(big) == 1 and {r.node for r in big[0]} == set(range(200)) and all(r.many for r in big[0])
    blocks: dict = {}
    for r in big[0]:
        blocks.setdefault(r.block, []).append(r.node)
    assert max(map(len, blocks.values())) <= 4
    assert [{r.node for r in x} for x in regions.values() if len(x) <= 3] == [{1, 2, 250}]


@pytest.mark.parametrize("rows", [0, 1, 5, 9])
def test_shares_of_hot_slices_leave_whole(rows):
    batch = pa.record_batch([pa.array([9] * rows + [12] * rows, pa.int64()), pa.array([*range(rows), *range(rows)], pa.int64()), pa.array([True] * (2 * rows), pa.bool_())], names=["sig", "node", "hot"])
    parts = [batch.slice(k, 2) for k in range(0, batch.num_rows, 2)]
    out = [r for b in jaccard_join._meeting(iter(parts), 4) for r in b.to_pylist()]
    assert sorted(r["node"] for r in out) == sorted([*range(rows)] * 2) and len({r["region"] for r in out}) == (2 if rows else 0)


def test_bitmaps_grow_with_their_ids():
    assert [bitmap_bits(n) for n in (0, 1000, 1 << 20, 1 << 40)] == [23, 23, 25, 28]
