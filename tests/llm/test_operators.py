"""Each operator against a brute-force version, and on nulls, empties, ties and repeats."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from caseledger.llm import (embedding_dedup, exact_dedup, html_text, jaccard_join, mixing, sentencepieces, sharding, token_files,  # noqa: E402
                            toxicity, warc)
from caseledger.llm.common import components, forest, ship  # noqa: E402
from caseledger.session import fresh_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _x string, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(n=120, seed=1):
    """Copies, near copies, null, empty and blank texts, a long one, null ids and sources, a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n // 2)]
    for t in texts[:n // 4]:
        w = t.split()
        if len(w) > 10:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:n // 8] + [None, "", "  \n\t", "Two Words", "two  words", " ".join(vocabulary * 40), "é ▁ 　ß\x00z"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "k", "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here", "en", "s1", 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
    a, b = forest(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 3, 4: 3, 9: 8}


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, none, bits):
    """With three hash bits most chunks collide, and the ordinals decide."""
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, hash_bits=bits).collect())
    groups = collections.defaultdict(list)
    for r in rows_of():
        groups[r[1] or ""].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 256, 200_000, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(0, 256, n, dtype=np.uint8), shared]) for n in (10, 70_001)]
    cut = [{bytes(t[a:b]) for a, b in itertools.pairwise(exact_dedup.chunk_bounds(t, np.array([0, len(t)]))[0].tolist())} for t in texts]
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0])
    flat = np.zeros(100_000, np.uint8)
    bounds = exact_dedup.chunk_bounds(flat, np.array([0, len(flat)]))[0]
    assert (np.diff(bounds) <= exact_dedup.LONGEST).all() and bounds[-1] == len(flat)


def test_drop_copies_keeps_columns(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows_of()})


def target_sizes(sizes, most=3):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {k: (1, 2, 3)[i % 3] for i, k in enumerate(keys)}, sum(sizes.values()), set()
    while True:
        open_ = [k for k in keys if k not in full]
        level = (total - sum(most * sizes[k] for k in full)) / max(sum(weight[k] for k in open_), 1)
        more = {k for k in open_ if weight[k] * level > most * sizes[k]}
        if not more:
            return {k: float(most * sizes[k]) if k in full else weight[k] * level for k in keys}
        full |= more


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in rows_of():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = target_sizes(sizes), collections.Counter()
    assert len(got) == len(rows_of())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    # one document may be larger than all others of its source can make up for
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s] / 2 + 1) for s in sizes)
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0


def test_mix_reshares_above_the_cap(spark):
    rows = [(i, "w " * (1 + i % 5), "en", s, 0, "", "", 0) for i, s in enumerate(["a"] * 60 + ["b"] * 2 + ["c"] * 30)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    small = [r for r in got if r["source"] == "b"]
    assert all(r["copies"] == 3 for r in small) and small[0]["target"] == 3 * small[0]["source_size"]
    out = mixing.repeat_mixed(spark.createDataFrame(rows, SCHEMA))
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in got)


def brute_components(rows, width=3, num=90, den=100):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, r in enumerate(rows):
        w = WORD.findall((r[1] or "").translate(low))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            top[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), r[0] if not sets[i] else least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("width,num,small", [(3, 90, False), (3, 90, True), (5, 80, True)])
def test_jaccard(docs, none, monkeypatch, width, num, small):
    if small:  # every family counts as large, and common shingles join without bitmaps
        monkeypatch.setattr(jaccard_join, "UNIT_ROWS", 2)
        monkeypatch.setattr(jaccard_join, "COMPARED", 3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, width, num).collect())
    assert got == brute_components(rows_of(), width, num)
    if not small:
        assert jaccard_join.jaccard_components(none).count() == 0


def test_drop_near_copies_of_shared_ids(spark):
    """Rows go one by one: an unrelated text stays though its id is a near copy's."""
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcde"]
    a, b, c, d, e = ((t, t + " more") for t in texts)
    rows = [(1, a[0]), (2, a[1]), (2, b[0]), (3, c[0]), (3, c[1]), (None, d[0]), (None, d[1]), (None, e[0]), (9, e[1]), (5, ""), (5, None)]
    got = jaccard_join.drop_near_copies(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _x long"), 5, 80)
    first = [min(x, key=lambda t: hashlib.sha256(t.encode()).hexdigest()) for x in (c, d)]
    want = [(1, a[0]), (2, b[0]), (3, first[0]), (None, first[1]), (9, e[1]), (5, ""), (5, None)]
    assert got.columns == ["doc_id", "text", "_x"]
    got = got.collect()
    assert {(r[0], r[1]) for r in got} == set(want) and len(got) == len(want)
    assert all(rows[r["_x"]] == (r[0], r[1]) for r in got)


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > x], rng.integers(0, 2**63, int(300 * x)).astype(np.uint64)])) for b in base for x in rng.uniform(0, 0.12, 30)]
    top = list(range(len(sets)))

    def root(t, x):
        while t[x] != x:
            x = t[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            top[root(top, i)] = root(top, j)
    mine = list(range(len(sets)))
    for i, j in jaccard_join.linked(sets, mine[:], None, 90, 100):
        mine[root(mine, i)] = root(mine, j)
    pairs = lambda t: {(i, j) for i, j in itertools.combinations(range(len(t)), 2) if root(t, i) == root(t, j)}
    assert pairs(mine) == pairs(top) and pairs(top)


PAGE = """<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy &amp; save</div>
<article><h1>A  title</h1><p>One&nbsp;two &lt;3 <b>bold</b><br>line</p><p>Second paragraph of the text.
<p>Third &copy; paragraph.</p><div class="advert"><p>Buy more</p></div></article>
<aside class="sidebar"><p>Related things</p></aside><section class="comments"><div class="comment"><p>First! Nice text.</p></div></section>
<form><label>Mail</label><input></form><div class="cookie-notice"><p>We use cookies.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (5, "x", "<p"), (6, "y", PAGE * 3)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    want = "A title\nOne two <3 bold line\nSecond paragraph of the text.\nThird © paragraph."
    assert got[1]["text"] == want == got[None]["text"] and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and got[3]["n_chars"] == 0 and len(got) == 6
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<p>a</p><svg class="i"/><p>rest</p>', ["a", "rest"]),
    ("<p>a</p><svg-icon></svg-icon><p>b</p><video-player>c</video-player><select-menu><p>d</p></select-menu>", ["a", "b", "c", "d"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold <math/> here</p><p>b</p>", ["Let x=2 hold here", "b"]),
    ("<p>a</p><svg><title>T</title><style/><text>in</text></svg><p>b</p>", ["a", "in", "b"]),
    ("<p>a</p><object data=x>o</object><audio>u</audio><video>v</video><noscript><p>n</p></noscript><select><option>s<option>t</select><p>b</p>", list("aouvnstb")),
    ("<p>a</p><svg><text>t</text><p>b</p>", ["a", "t", "b"]),
    ("<p>a <svg><g><path d=''/></g></svg> b<script>no</script> c <video><source src=x>d</video><video>e</video> f<p>g<style>no</style>", ["a b c", "d", "e", "f", "g"]),
    ("<p>a</p><iframe src=x><p>b</p><canvas>c</canvas><template>d</template><textarea>e</textarea><p>f</p>", list("abcdef")),
    ("<p>a</p><script-box>b</script-box><script x='>'>if (a</script-box>) <p>no</p></SCRIPT ><title\n>no</title><style>no</style><p>c</p>", list("abc")),
    ("<p>a</p><!--><p>b</p><!-- <p>no</p> --!><p>c</p><script>no<p>no</p>", list("abc"))])
def test_leaf_blocks_read_all_text(page, want):
    assert [b.text for b in html_text.leaf_blocks(page)] == want


def test_html_beyond_icons(spark):
    page = PAGE.replace("<h1>", '<svg class="i"/><svg-icon name="x"></svg-icon><h1>').replace("<p>Second", "<p>As <math><mi>x</mi></math> says.</p><video-player></video-player><p>Second")
    got = html_text.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert got == "A title\nOne two <3 bold line\nAs x says.\nSecond paragraph of the text.\nThird © paragraph."


def test_labeller_gradients():
    pages = [[b for b in html_text.leaf_blocks(PAGE)]]
    f, model = html_text.Features(pages), html_text.Labeller(1)
    y, w = np.arange(f.size) % 2.0, np.ones(f.size)
    g = model.gradients(f, y, w)

    def loss():
        p = np.clip(model.probabilities(f), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, at in (("wf", (3, 5)), ("wb", (30, 45)), ("out", 4), ("path", (int(f.path[0]), 2)), ("cf", 7)):
        keep, step = model.p[name][at], 1e-2
        model.p[name][at] = keep + step
        up = loss()
        model.p[name][at] = keep - step
        slope = (up - loss()) / (2 * step)
        model.p[name][at] = keep
        assert abs(slope - g[name][at]) < 1e-3 + 0.05 * abs(slope)


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            words[rng.randrange(30)] = "grumblo" + chr(97 + rng.randrange(26)) * 2
        rows.append((i, " ".join(words), "en", "s", 0, "", "", 0))
        labels.append((i, 0, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None, "en", "s", 0, "", "", 0), (None, "You IDIOT!", "en", "s", 0, "", "", 0)], SCHEMA)
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, table).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert all(got[i]["predicted"] == int(i % 6 == 0) for i in range(600) if got[i]["held_out"])
    assert got[1000]["predicted"] == 0 and got[None]["predicted"] == 1
    # held-out labels teach nothing
    turned = spark.createDataFrame([(i, q, 1 - t if got[i]["held_out"] else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()} == {i: r["score"] for i, r in got.items()}
    # no labels: the stated insults alone
    bare = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, table.limit(0)).collect()}
    assert bare[None] == 1 and bare[0] == 0
    assert toxicity.toxicity(none, table).count() == 0
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


HOSTILE = {"nested": "<div>x" * 160_000, "names": "".join(f"<div class=a{i}>x" for i in range(50_000)), "open tags": "<a " * 300_000, "inline": "<b>x " * 200_000,
           "unmatched": "<div>x" * 40_000 + "</q>" * 100_000, "inline then blocks": "<b>" * 100_000 + "<div>y</div>" * 50_000, "script": "<script>" + "</script " * 100_000,
           "svg": "<svg>x" * 100_000, "long": "<p>" + "word " * 200_000}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    import time

    began = time.time()
    got = html_text.leaf_blocks(HOSTILE[kind])
    assert time.time() - began < 30  # seconds for about a megabyte; minutes to hours where work grows with the square
    assert len(got) == {"nested": 160_000, "names": 50_000, "open tags": 1, "inline": 1, "unmatched": 40_000, "inline then blocks": 50_000, "script": 0, "svg": 100_000, "long": 1}[kind]


def test_own_attributes_and_odd_pages(spark):
    """A page may use data-keep for anything; columns with other names are not read; no rows give none."""
    article = "<p>" + "A sentence of the story that goes on for a while. " * 8 + "</p>"
    rows = [(i, f"u{i}", f'<body><nav><a href="x">Home</a></nav><article data-keep="{v}">{article}</article></body>', "x", 1) for i, v in enumerate(["true", "", "0", "1", "é"])]
    rows += [(None, None, None, None, None), (9, "deep", "<div>" * 5000 + article, None, None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path long")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows) and len({r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 5}) == 1
    assert all("sentence of the story" in r["text"] and "Home" not in r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 5)
    assert {(r["text"], r["n_chars"]) for r in got if r["page_id"] is None} == {("", 0)}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_labeller_on_layouts_it_has_not_seen(monkeypatch):
    """Made pages of other wrappers than those of training: blocks told right, by words."""
    from caseledger.llm import blocks

    labeller = html_text.Labeller().fit(html_text.training_pages([]))
    rng = np.random.default_rng(99)

    def right(pages):
        own = labeller.probabilities(html_text.Features(pages, learn=False)) >= 0.5
        flat = [b for p in pages for b in p if b.keep >= 0]
        told = own[[b.keep >= 0 for p in pages for b in p]]
        size = np.array([len(b.text.split()) for b in flat])
        return (size * (told == np.array([b.keep == 1 for b in flat]))).sum() / size.sum()

    known = right([blocks.leaf_blocks(blocks.made_page(rng, ["one", "two", "three"]), made=True) for _ in range(100)])
    monkeypatch.setattr(blocks, "CONTENT", ('<div id="content"><div class="entry">{0}</div></div>', '<main><section class="post-body">{0}</section></main>', '<article class="h-entry"><div>{0}</div></article>'))
    monkeypatch.setattr(blocks, "AROUND", ('<div class="navigation top">{0}</div>', '<div class="site-footer">{0}</div>', '<div class="widget area">{0}</div>', '<aside id="rail">{0}</aside>', '<form class="search">{0}</form>'))
    unseen = right([blocks.leaf_blocks(blocks.made_page(rng, ["vier", "fünf", "six"]), made=True) for _ in range(100)])
    print("known", known, "unseen", unseen)
    assert known >= 0.97 and unseen >= 0.85


def test_jaccard_rows_without_or_with_one_id(spark, monkeypatch):
    """Near copies that all lack an id, or share one: right, and no text moves for each pair of them."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base + [f"tail{i}"]) for i in range(120)] + [" ".join(f"x{i}{k}" for k in range(20)) for i in range(30)]
    for ids in ([None] * 150, [7] * 150, [None if i % 2 else i for i in range(150)]):
        docs = spark.createDataFrame(list(zip(ids, texts)) * 2, "doc_id long, text string").repartition(4)
        moved = spark.sparkContext.accumulator(0)
        pairs = jaccard_join._link_unit_pair

        def counted(*a, pairs=pairs, moved=moved):
            run = pairs(*a)

            def count(rows):
                moved.add(rows.num_rows)
                return run(rows)

            return count

        monkeypatch.setattr(jaccard_join, "_link_unit_pair", counted)
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
        monkeypatch.undo()
        least = min((i for i in ids[:120] if i is not None), default=None)
        want = collections.Counter((i, len(t.split()) - 2, least if k < 120 else i) for k, (i, t) in enumerate(zip(ids, texts)) for _ in range(2))
        assert got == want and moved.value <= 150 * 8


@pytest.mark.parametrize("planted", [40, 300])
def test_large_toxic_vocabularies_are_found(spark, planted):
    """Toxic texts that share no word but one of many, each learned from about ten of them."""
    rng = random.Random(planted)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, insults = [word(rng.randint(2, 8)) for _ in range(2000)], [word(9) for _ in range(planted)]
    rows, labels = [], []
    for i in range(planted * 40):
        text = [rng.choice(common) for _ in range(30)]
        if toxic := i % 3 == 0:
            text[rng.randrange(30)] = insults[i // 3 % planted]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, table).where("held_out").collect()
    truth = dict(labels)
    assert sum(r["predicted"] for r in got if truth[r["doc_id"]]) >= 0.97 * sum(truth[r["doc_id"]] for r in got)
    assert sum(r["predicted"] for r in got if not truth[r["doc_id"]]) <= 0.01 * len(got)


def test_warc(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"
    rows = [(1, "http://www.a.example.org/x?b=1#f", trap), (2, "https://b.example.org:8080/", "ünï"), (3, None, None), (4, "http://a.example.org/x?b=1", trap), (5, "u\r\nv", ""),
            (None, "http://n.example", "ünï"), (7, "http://c.example", "x" * 300_000), (8, "http://c.example", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = fresh_path(spark, "warc")
    warc.write_warc(pages, folder)
    index = warc.build_index(warc.index_captures(spark, folder))
    every = warc.read_captures(warc.lookup(index, pages), payloads=True).collect()
    got = {r["page_id"]: r for r in every}
    assert set(got) == {r[0] for r in rows} and len(every) == len(rows)
    for i, (_, _, html) in {r[0]: r for r in rows}.items():
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw)
        assert bytes.fromhex(hashlib.sha1(raw).hexdigest()) == base64.b32decode(got[i]["payload_digest"])
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {4: 1, 5: 3, None: 2}

    def payloads(*urls):
        found = warc.lookup(index, spark.createDataFrame([(u,) for u in urls], "url string"))
        return sorted((r["page_id"], bytes(r["payload"])) for r in warc.read_captures(found, payloads=True).collect())

    assert payloads("http://A.example.org/x?b=1", "https://a.example.org/x?b=1#y") == [(1, trap.encode()), (4, b"")]
    assert payloads("https://c.example/") == [(7, b"x" * 300_000), (8, b"z")] and payloads("http://no.example") == [] and payloads(None) == [(3, b"")]
    empty = fresh_path(spark, "warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_captures(warc.lookup(warc.build_index(warc.index_captures(spark, empty)), pages)).count() == 0


def test_warc_index_of_one_hot_url(spark, monkeypatch):
    """A URL with most captures fills blocks of its own; neighbours are told from it. Columns may clash."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, "http://hot.example/a", f"p{i}", "f", 1, "k") for i in range(60)] + [(100 + i, f"http://hot.example/{c}", f"q{i}", "f", 1, "k") for i, c in enumerate("0bAa~")]
    rows += [(200, "http://long.example/" + "y" * 50_000, "long", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset long, key string").repartition(3)
    folder = fresh_path(spark, "warc")
    warc.write_warc(pages, folder)
    index = warc.build_index(warc.index_captures(spark, folder))
    assert index.directory.count() >= 10
    found = lambda url: sorted(r["page_id"] for r in warc.read_captures(warc.lookup(index, spark.createDataFrame([(url,)] * 3, "url string"))).collect())
    assert found("http://hot.example/a") == [*range(60), 103] and found("http://hot.example/b") == [101] and found(rows[-1][1]) == [200] and found("http://hot.example/c") == []
    assert sorted(r["page_id"] for r in warc.read_captures(warc.lookup(index, pages)).collect()) == sorted(r[0] for r in rows)


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    v = [*(b + rng.normal(size=16) * s for b in base for s in (0.05, 0.2, 0.35)), *base[:5], *base[:5]]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, rows[0][1][:8]), (1005, []), (None, rows[1][1]), rows[2]]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()
    every = rows + [odd[-2], odd[-1]]
    m = np.array([r[1] for r in every])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    comp = list(range(len(m)))
    for _ in range(len(m)):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(m))]
    want = collections.Counter((every[i][0], int(near[i].sum()), every[comp[i]][0]) for i in range(len(m)))
    want.update((i, 0, i) for i, _ in odd[:6])
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def blind(column):
    """An audit in which the graphs find no links of audited classes, or no probe's source."""
    whole = embedding_dedup._audit

    def audit(*a):
        run = whole(*a)

        def nothing(batches):
            for batch in run(batches):
                at = batch.schema.get_field_index(column)
                yield batch.set_column(at, column, pa.array([0] * batch.num_rows, pa.int64()))

        return nothing

    return audit


@pytest.mark.parametrize("hot,pairs,alone", [(150, 40, 60), (0, 1, 400), (0, 120, 40), (0, 0, 300)])
@pytest.mark.parametrize("fails", [None, "others", "met"])
def test_embedding_audit(spark, monkeypatch, hot, pairs, alone, fails):
    """Links of small groups beside a large one, and a rare pair, are found; a graph that
    misses them, or only its probes where a table has no links, leads to the comparison."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(pairs + alone + 1, 48))
    v = np.concatenate([base[0] + rng.normal(size=(hot, 48)) * 0.1, base[1:], base[1:pairs + 1] + rng.normal(size=(pairs, 48)) * 0.1])
    compared = []
    exact = embedding_dedup.exact_links
    monkeypatch.setattr(embedding_dedup, "exact_links", lambda *a: compared.append(1) or exact(*a))
    if fails:
        monkeypatch.setattr(embedding_dedup, "_audit", blind(fails))
    got = embedding_dedup.embedding_links(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    m = v / np.linalg.norm(v, axis=1)[:, None]
    want = (m @ m.T >= 0.9).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
    assert bool(compared) == (fails == "met" or fails == "others" and hot + pairs > 0)  # else the graphs have answered


def test_embedding_columns_may_clash(spark):
    rows = [(i, [1.0, float(i % 2)], 1, "a", 2.0, [3.0]) for i in range(6)]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, no long, shard string, copies double, v array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(i, 2, i % 2, i < 2) for i in range(6)}


NASTY = ["a  b   c", "  x", " " * 37, "日本 語  日\n  \n\tx", "aaaaaaaaaaaaaa", "a▁▁b", "ﬁ \U0001F600 z", "    def f(x):\n        return x", "1234 don't we'll STOP!!! <|endoftext|>x",
         "İstanbul ΟΔΟΣ. é ́", "x y　z\x1cq", "it's,'s 'S it'S;", "Thing### thing%%% é,é", "́", "a" * 3000]


def test_long_runs_of_spaces(spark):
    """Division of runs against merging pair by pair, a megabyte of blanks, and round trips of both."""
    import time

    pieces = sentencepieces.load_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))

    def plain(length):
        parts = ["▁"] * length
        while (at := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in pieces.runs), None)) is not None:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [pieces.runs[p] for p in parts]

    pieces = pieces.value
    assert all(pieces.run_of(n) == plain(n) for n in range(1, 120))
    began = time.time()
    assert len(pieces.run_of(1 << 20)) < 1 << 20 and time.time() - began < 10


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(100 - i, t) for i, t in enumerate(NASTY)] + [(r[0], r[1]) for r in rows_of()]
    folder = fresh_path(spark, "tokens")
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, folder, end=2)
    got = sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r["start"])
    model, at, want = Tokenizer.from_file(path), 0, collections.Counter()
    for i, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    # the files themselves
    first = min(manifest.collect(), key=lambda r: r["base"])
    place = folder.removeprefix("file://")
    offs = np.memmap(f"{place}/{first['offsets']}", "<u8", "r")
    ids = np.memmap(f"{place}/{first['file']}.ids", "<u2", "r")
    assert len(offs) == first["n_docs"] + 1 and offs[-1] == len(ids) and ids[int(offs[1]) - 1] == 2
    assert token_files.read_tokens(token_files.write_tokens(none, path, fresh_path(spark, "tokens"), end=2), folder).count() == 0


def test_sentencepiece(spark, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    texts = NASTY + ["".join(rng.choice(["th", "in", "ing", "er", "tion", " ", "  ", "a", "▁the", "日", "\n", "return", "    ", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate([*texts, None, ""])] + [(None, "x y")]
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.load_pieces(spark, path)
    ids = sentencepieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), pieces)
    got = {r["doc_id"]: r for r in sentencepieces.decode(ids, pieces).collect()}
    for i, t in rows:
        assert got[i]["ids"] == model.encode(t or "") and got[i]["text"] == model.decode(got[i]["ids"]) == (t or "").replace("▁", " ")
    assert sentencepieces.encode(none, pieces).count() == 0
    back = sentencepieces.decode(spark.createDataFrame([(1, None), (2, [259, 5, 300])], "doc_id long, ids array<int>"), pieces).collect()
    assert {r["doc_id"]: r["text"] for r in back}[1] == ""


def test_sharding(spark, docs, none):
    rows = rows_of(400, 9) + [(5000 + i, "same text", "en", "s", 0, "", "", 0) for i in range(300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), shards=4, run_rows=16).collect()
    by_text, shards = {}, collections.defaultdict(list)
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for r in got:
        assert by_text.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
        shards[r["shard"]].append(r)
    largest = max(r["size"] for r in got)
    share = sum(r["size"] for r in got) / 4
    for mine in shards.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - share) <= max(2 * largest, 0.05 * share)
    assert sharding.shard_by_bytes(none).count() == 0
    alone = sharding.shard_by_bytes(spark.createDataFrame(rows[-300:], SCHEMA), shards=4).collect()
    assert len({r["shard"] for r in alone}) == 1 and len(alone) == 300


def test_plans_of_the_native_operator(docs):
    plan = sharding.shard_by_bytes(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("num", [50, 80, 90, 97])
def test_linked_sets_share_a_token(num):
    """Sets of any size at the edge of what links have a token in common, whatever batch they come in."""
    rng = np.random.default_rng(num)
    made = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    linked = 0
    for n in [*range(1, 60), *rng.integers(60, 2000, 100).tolist()]:
        for _ in range(4):
            a = made(n)
            lost, added = int(rng.integers(0, n * (100 - num) // 100 + 2)), int(rng.integers(0, n * (100 - num) // num + 2))
            b = np.union1d(rng.permutation(a)[lost:], made(added))
            both = len(np.intersect1d(a, b))
            if len(b) and both < max(len(a), len(b)) and 100 * both >= num * (len(a) + len(b) - both):
                place, token = jaccard_join.tokens([a, made(5000), b], num, 100)
                assert set(token[place == 0].tolist()) & set(token[place == 2].tolist())
                assert sorted(jaccard_join.tokens([b], num, 100)[1].tolist()) == sorted(token[place == 2].tolist())
                linked += 1
    assert linked > 150


@pytest.fixture
def moved(spark, monkeypatch):
    """Rows of text that were dealt to pairs of units."""
    rows, pairs = spark.sparkContext.accumulator(0), jaccard_join._link_unit_pair

    def counted(*a):
        run = pairs(*a)

        def count(table):
            rows.add(table.num_rows)
            return run(table)

        return count

    monkeypatch.setattr(jaccard_join, "_link_unit_pair", counted)
    return rows


def test_texts_of_common_shingles_do_not_move(spark, monkeypatch, moved):
    """Unrelated texts whose every shingle is in many others are no family."""
    monkeypatch.setattr(jaccard_join, "UNIT_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "COMPARED", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(200))) for i in range(600)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(600)]
    assert moved.value <= 600


def test_texts_of_a_large_group_move_a_few_times(spark, monkeypatch, moved):
    """Near copies of one text meet a few of them, not all; those that link with few of them are found too."""
    monkeypatch.setattr(jaccard_join, "UNIT_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "COMPARED", 64)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:(k := rng.randrange(300))], f"x{i}", *base[k:]])) for i in range(600)]
    chain = [" ".join([*base, *(f"y{k}" for k in range(30 * step))]) for step in range(3, 11)]  # each links with the next only
    rows += [(600 + i, t) for i, t in enumerate(chain)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_components([(i, t) for i, t in rows if i < 20 or i >= 600])
    assert {r["component_id"] for r in got if r["doc_id"] < 600} == {0}
    assert collections.Counter(tuple(r) for r in got if r["doc_id"] < 20 or r["doc_id"] >= 600) == want
    assert moved.value <= 600 * 8


def test_drop_near_copies_moves_no_text_that_stays(spark, monkeypatch):
    def exchanged(plan):
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        while plan.getClass().getSimpleName().endswith("QueryStageExec"):
            plan = plan.plan()
        own = plan.metrics().apply("dataSize").value() if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
        return own + sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))

    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(400)) for _ in range(200)]
    rows = [(i, t, -i) for i, t in enumerate(texts)] + [(500 + i, t + " more", i) for i, t in enumerate(texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits in (jaccard_join.FILTER_BITS, 64):  # with few bits most rows go the long way
            monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits)
            got = jaccard_join.drop_near_copies(docs, 5, 80)
            assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == rows[:200]
            if bits > 64:
                assert 0 < exchanged(got._jdf.queryExecution().executedPlan()) < 0.2 * sum(len(t) for t in texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
