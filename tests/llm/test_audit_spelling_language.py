"""Filter audit, spelling variants and language identification against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from caseledger.llm import filter_audit, language_id, spelling

SCHEMA = "doc_id long, text string, lang string, n long, part string, word string, x string, key string"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, 1, "p", "w", "x", None) for i, t, g in rows], SCHEMA).repartition(parts)


# ---- 12 ----


def audit_rows():
    rng = random.Random(4)
    long_ = " ".join(rng.choice("alpha beta gamma delta") + str(i) for i in range(300))
    texts = [long_, long_, "same same same", "SHOUT OUT", "a # b", None, "", " \t\n", "x" * 200_000, "é ß\x0bz", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "w " * 199, "w " * 400]
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts * 2, itertools.cycle(["en", None, "", "de"])))]
    return rows + [rows[0], rows[0], (rows[0][0], rows[0][1], "fr"), (rows[3][0], "another text", "en"), (None, long_, "en"), (None, "", None)]


def audit_brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = collections.defaultdict(list)
    for i, t, g in rows:
        t = t or ""
        w = BLANKS.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        fails[g or ""].append((f, i in good, i in toxic))
    out = {}
    for part, docs in fails.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            live = docs
            for step, k in enumerate(order, 1):
                gone = [d for d in live if d[0][k]]
                live = [d for d in live if not d[0][k]]
                shapley[k] += len(gone)
                out[part, order, step] = [len(live), len(gone), sum(d[0][k] for d in docs) - len(gone),
                                          sum(d[0][k] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, k in enumerate(order, 1):
                out[part, order, step].append(shapley[k])
    return out


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (2, None, None), (3, 0, 1), (None, 1, 1), (5, 1, 0), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(frame(spark, rows), table).collect()
    assert len(got) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got} == audit_brute(rows, labels)
    assert filter_audit.filter_audit(frame(spark, []), table).count() == 0
    bare = filter_audit.filter_audit(frame(spark, rows), table.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


def test_contraction_of_random_tensors():
    """Each count of each step by summing cells one by one."""
    rng = np.random.default_rng(2)
    t = rng.integers(0, 50, (2, 3, 2, 2, 2, 2, 2))
    got = filter_audit.contract(t)
    for at in rng.integers(0, 600, 40):
        order, step = filter_audit.ORDERS[at // 5], at % 5
        for p in range(2):
            removed = sum(t[p, 0][c] for c in itertools.product((0, 1), repeat=5)
                          if c["ABCDE".index(order[step])] and not any(c["ABCDE".index(k)] for k in order[:step]))
            assert got[p, at, 1] == removed


# ---- 11 ----


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_brute(v, ratio=2):
    near = {w: [y for y in v if one_edit(w, y)] for w in v}
    form = {w: min(y, key=lambda x: (-v[x], x)) for w, y in near.items() if y}
    form = {w: f for w, f in form.items() if v[f] >= ratio * v[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, form.get(w), root(w), len(near[w]), v.get(form.get(w))) for w, n in v.items()}


def variants(rows):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("hot", [4096, 3])
@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_variants_of_any_words(spark, letters, hot):
    """Short and long words, runs of one letter, and lists that must be divided to the last place."""
    rng = random.Random(len(letters))
    v = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 3, 5, 10, 40, 200]) for _ in range(500)}
    for _ in range(100):
        w = rng.choice(list(v))
        k = rng.randrange(len(w))
        v[w[:k] + rng.choice(["", "x", w[k] * 2]) + w[k + 1:] or "z"] = rng.choice([1, 9])
    v |= {"a" * n: 2 ** (n % 9) for n in range(1, 40)} | {"日本語" * 3: 4, "日本語日本日本語": 9, "q" * 3000: 5, "q" * 2999 + "r": 20}
    words = spark.createDataFrame([*v.items(), (None, 7)], "word string, n long").repartition(3)
    got = spelling.variant_groups(words, hot=hot).collect()
    assert len(got) == len(v) and variants(got) == variants_brute(v)


def test_spelling_variants(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeÀéÿ×") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary).capitalize() for _ in range(200)) + " tail1tail2TAIL_", "en") for i in range(60)]
    rows += [(None, "without without without number", None), (7, None, None), (8, "", None), rows[0], (9, "Long" * 50_000, "de"), (9, "日本 " * 5, None)]
    count = collections.Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    want = variants_brute({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    got = spelling.spelling_variants(frame(spark, rows)).collect()
    assert len(got) == len(want) > 40 and variants(got) == want
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


# ---- 13 ----


SYLLABLES = {"en": "the th ing er and wh sh ou", "fr": "eau les é ment oi aux que ré", "de": "sch ung ei der ge ver tz ö"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def language_rows(n=240):
    rng = random.Random(1)
    return [(i, sentence(rng, g, rng.randint(4, 150)).capitalize() + ". 12, 3!", g) for i, g in zip(range(n), itertools.cycle(SYLLABLES))]


def test_language_id(spark):
    rows = language_rows()
    docs = frame(spark, rows)
    field = language_id.train(docs)
    assert field.langs == ["de", "en", "fr"]
    rng = random.Random(8)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ³ _ -- ½", "de"), (None, sentence(rng, "fr", 30), None), (1003, sentence(rng, "de", 60_000), None),
           (1004, "x" * 100_000, None), rows[0], rows[0]]
    got = language_id.identify(frame(spark, rows + odd), field).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(by[i]["lang_pred"] == g for i, _, g in held) >= 0.95 * len(held)
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0.0, []) for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "fr" and by[1003]["lang_pred"] == "de" and by[1003]["n_words"] == 60_000 and by[1004]["n_words"] == 1
    assert all(0 <= r["score"] <= 1 and sum(s["words"] for s in r["spans"]) == r["n_words"] for r in got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 0}) == 1
    assert language_id.identify(frame(spark, []), field).count() == 0
    # nothing to learn from
    assert language_id.train(frame(spark, [(i, t, None) for i, t, _ in rows])) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_switched_text_is_divided(spark):
    rng = random.Random(3)
    field = language_id.train(frame(spark, language_rows()))
    text = " ".join([sentence(rng, "en", 40), sentence(rng, "fr", 30), sentence(rng, "en", 40)])
    spans = language_id.identify(frame(spark, [(1, text, None)]), field).first()["spans"]
    label = [s["lang"] for s in spans for _ in range(s["words"])]
    want = ["en"] * 40 + ["fr"] * 30 + ["en"] * 40
    assert len(label) == len(want) and sum(a == b for a, b in zip(label, want)) >= 105


def test_blocks_equal_plain_forward_backward():
    """Posteriors by blocks against one pass over each text, and against all paths of a short one."""
    rng = np.random.default_rng(4)
    counts, k = np.array([0, 1, 5, 0, 31, 32, 33, 200, 3]), 3
    evidence, moves = rng.normal(size=(counts.sum(), k)).astype(np.float32) * 2, rng.normal(size=(k, k))
    got = language_id.block_posteriors(evidence, counts, moves)
    at = 0
    for n in counts:
        if n:
            # the plain pass starts from equal languages; the blocks move once before the first word
            first = np.log((language_id._softmax(moves)).mean(0))
            e = evidence[at:at + n].astype(float).copy()
            e[0] += first
            post, _, _ = language_id.marginals(e[:, None, :], np.log(language_id._softmax(moves)))
            np.testing.assert_allclose(got[at:at + n], post[:, 0], atol=2e-4)
        at += n
    e = evidence[1:6].astype(float)
    paths = list(itertools.product(range(k), repeat=5))
    a = language_id._softmax(moves)
    weight = np.array([a.mean(0)[p[0]] * np.prod([a[x, y] for x, y in itertools.pairwise(p)]) * np.exp(sum(e[t, s] for t, s in enumerate(p))) for p in paths])
    want = [[weight[[p[t] == s for p in paths]].sum() / weight.sum() for s in range(k)] for t in range(5)]
    np.testing.assert_allclose(got[1:6], want, atol=2e-4)
