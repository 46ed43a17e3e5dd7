"""Operator 11, spelling variant grouping by dynamic programming over sorted lists.

Two words are near if one inserted, deleted or replaced character leads from one to
the other. Each word of a sorted list walks the words after it with a banded edit
matrix (three diagonals): of the next word only the rows beyond the prefix that it
shares with the last one are new, and as soon as a row exceeds one edit, all words
that share the prefix read so far are skipped. The walks of a batch advance together.

Lists are short because near words agree in their first or in their second half: each
word enters the list of its first half and of its last half, for its own length and
for the one below. A list beyond ``HOT`` words is divided again, by halves of what is
still open, down to the one place where its words may differ.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import few, filled, query, saved, ship, table, tasks, tidy

#: Words of a list above which it is divided; words that a task counts before it hands counts on.
HOT, HELD = 4096, 200_000
#: Of how many hashes one marks a run of letters that loses a character.
DAMAGED = 97

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FIELDS = "word string, n bigint"


def damaged(word: str, h: int) -> str:
    """The word, or where ``DAMAGED`` divides its hash the word without one character."""
    if h % DAMAGED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _count(shortest: int):
    def run(batches):
        seen: Counter[str] = Counter()

        def out():
            part = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return part

        for batch in few(batches, 256):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
                    if len(word) >= shortest:  # a shorter one stays too short
                        word = damaged(word, zlib.crc32(word.encode(), before))
                        if len(word) >= shortest:
                            seen[word] += n
                if len(seen) > HELD:
                    yield out()
        yield out()
        tidy()

    return run


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of every word of all texts with so many characters and occurrences."""
    ship(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), filled().alias("text"))
    return slim.mapInArrow(_count(shortest), FIELDS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(words: DataFrame, size: Column, lo: Column, hi: Column) -> DataFrame:
    """Entries of the list of pairs whose shorter word has ``size`` characters and which
    first differ at a place of [lo, hi): they share lo characters at the front and
    size - hi at the back. ``x`` is the word, reversed where the back is what is longer."""
    out = words.select("word", "n", size.alias("size"), lo.alias("lo"), hi.alias("hi")) \
        .withColumn("back", F.greatest(F.col("size") - F.col("hi"), F.lit(0)))
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.expr("right(word, back)")
    return out.withColumn("key", F.xxhash64("size", "lo", "hi", head, tail)) \
        .withColumn("x", F.when(F.col("lo") >= F.col("back"), F.col("word")).otherwise(F.reverse("word"))).drop("back")


def _lists(words: DataFrame) -> DataFrame:
    """Four entries a word: both halves, for its own length and for the one below it."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where("size > 0")
    half = ((F.col("size") + 1) / 2).cast("int")
    windows = sized.select("word", "n", "size", F.explode(F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("size") + 1).alias("hi")))).alias("w"))
    return _keyed(windows.select("*", "w.lo", "w.hi"), F.col("size"), F.col("lo"), F.col("hi"))


def divided(entries: DataFrame, hot: int) -> DataFrame:
    """``entries`` with every list of more than ``hot`` words cut into two narrower ones,
    until none is left but those that differ in one place. Each round halves the open
    places, so rounds grow with the logarithm of the longest word of a hot list."""
    done = None
    while True:
        many = cut_lineage(entries.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key"))
        if many.isEmpty():
            return entries if done is None else done.unionByName(entries)
        rest = entries.join(many, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = entries.join(many, "key", "left_semi").select("word", "n", "size", F.explode(F.array(
            F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("w"))
        entries = cut_lineage(_keyed(parts.select("*", "w.lo", "w.hi"), F.col("size"), F.col("lo"), F.col("hi")))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _shared(codes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of words."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    size = np.minimum(at[a + 1] - at[a], at[b + 1] - at[b])
    while len(live):
        live = live[out[live] < size[live]]
        same = codes[at[a[live]] + out[live]] == codes[at[b[live]] + out[live]]
        live = live[same]
        out[live] += 1
    return out


def _lower_after(common: np.ndarray) -> np.ndarray:
    """For each place of a list the next one whose common prefix is shorter, or the end."""
    out, open_ = np.full(len(common), len(common), np.int64), []
    for i, c in enumerate(common.tolist()):
        while open_ and open_[-1][1] > c:
            out[open_.pop()[0]] = i
        open_.append((i, c))
    return out


def near_pairs(codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of words one edit apart. The words are sorted within their
    lists; ``ends[i]`` is where the list of word i ends.

    Row d of word i's matrix against a word w holds, for the first d characters of w,
    the edits to the first d-1, d and d+1 characters of word i, 2 standing for more than
    one. A walk begins at word i itself, whose rows are (1, 0, 1), so that what it shares
    with the next word is never read.
    """
    n = len(at) - 1
    size = np.diff(at)
    common = np.zeros(n + 1, np.int64)  # with the word before; 0 where a list begins
    if n > 1:
        common[1:n] = _shared(codes, at, np.arange(n - 1), np.arange(1, n))
        common[1:n][ends[:-1] == np.arange(1, n)] = 0
    after = _lower_after(common)
    # rows of every walk, one below the other: no walk goes deeper than its word plus one
    top = np.concatenate([[0], np.cumsum(size + 2)])
    rows = np.empty((top[-1], 3), np.uint8)
    rows[:] = (1, 0, 1)
    rows[top[:-1], 0] = 2  # nothing is before the first character
    text = np.concatenate([codes, np.zeros(2, np.uint32)])

    me = np.arange(n)[ends > np.arange(n) + 1]
    word = me + 1
    depth = common[word].copy()
    found_i, found_j = [], []
    skip = np.zeros(len(me), bool)
    while len(me):
        # 1. walks that look for the next word whose prefix is shorter than the dead one
        if skip.any():
            s = np.flatnonzero(skip)
            long_ = common[word[s]] >= depth[s]
            inside = word[s] < ends[me[s]]
            word[s] = np.where(long_ & inside, after[word[s]], word[s])
            skip[s] = long_ & inside
            back = s[~skip[s]]
            depth[back] = common[np.minimum(word[back], n)]
        live = word < ends[me]
        if not live.all():
            me, word, depth, skip = me[live], word[live], depth[live], skip[live]
            if not len(me):
                break
        go = np.flatnonzero(~skip)
        if not len(go):
            continue
        w, i, d = word[go], me[go], depth[go]
        over = d >= size[w]
        # 2. whole words: the last row tells the distance
        e = go[over]
        if len(e):
            gap = size[me[e]] - size[word[e]]
            ok = np.abs(gap) <= 1
            f = e[ok]
            hit = rows[top[me[f]] + size[word[f]], gap[ok] + 1] == 1
            found_i.append(me[f][hit])
            found_j.append(word[f][hit])
            word[e] += 1
            depth[e] = common[np.minimum(word[e], n)]
        # 3. one more character
        g = go[~over]
        if len(g):
            w, i, d = w[~over], i[~over], d[~over]
            c, r, start, length = codes[at[w] + d], top[i] + d, at[i], size[i]
            left, mid, right = rows[r, 0], rows[r, 1], rows[r, 2]
            q0 = np.where(d >= 1, text[start + d - 1], 0)
            q1, q2 = text[start + d], text[np.minimum(start + d + 1, len(text) - 1)]
            new0 = np.minimum(left + (c != q0), mid + 1)
            new1 = np.minimum(np.minimum(mid + (c != q1), new0 + 1), right + 1)
            new2 = np.minimum(right + (c != q2), new1 + 1)
            new1 = np.where(d + 1 > length, 2, new1)
            new2 = np.where(d + 2 > length, 2, new2)
            new0 = np.where(d > length, 2, new0)
            dead = np.minimum(np.minimum(new0, new1), new2) > 1
            alive = ~dead
            at_row = r[alive] + 1
            rows[at_row, 0] = np.minimum(new0[alive], 2)
            rows[at_row, 1] = np.minimum(new1[alive], 2)
            rows[at_row, 2] = np.minimum(new2[alive], 2)
            depth[g] += 1
            gone = g[dead]
            skip[gone] = True
            word[gone] += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _original_prefix(codes, at, a, b, flipped):
    """Common prefix of the words behind pairs of entries, some of which are reversed."""
    out = np.empty(len(a), np.int64)
    out[~flipped] = _shared(codes, at, a[~flipped], b[~flipped])
    last = len(at) - 2
    out[flipped] = _shared(codes[::-1], at[-1] - at[::-1], last - a[flipped], last - b[flipped])
    return out


def _pairs_of(part: pa.RecordBatch) -> pa.RecordBatch:
    """Near pairs of whole lists: (a, n_a, b, n_b), each pair once over all lists."""
    names = ("key", "size", "lo", "hi")
    keys = [np.asarray(part.column(c)) for c in names]
    n = part.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    ends = np.append(np.flatnonzero(new), n)[np.cumsum(new)]
    codes, at = _codes(part.column("x"))
    i, j = near_pairs(codes, at, ends)
    size, lo, hi = keys[1:]
    back = np.maximum(size - hi, 0)
    flipped = lo < back
    first = _original_prefix(codes, at, i, j, flipped[i])
    length = np.diff(at)
    own = (np.minimum(length[i], length[j]) == size[i]) & (lo[i] <= first) & (first < hi[i])
    i, j = i[own], j[own]
    word, count = part.column("word"), part.column("n")
    return pa.RecordBatch.from_arrays([word.take(pa.array(i)), count.take(pa.array(i)), word.take(pa.array(j)), count.take(pa.array(j))],
                                      ["a", "n_a", "b", "n_b"])


def _walk(rows: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        kept = 0
        for batch in batches:
            held.append(batch)
            kept += batch.num_rows
            if kept < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = np.asarray(whole.column("key"))
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            if cut:
                yield _pairs_of(whole.slice(0, cut))
            held, kept = [whole.slice(cut)], len(key) - cut
        if kept:
            yield _pairs_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        tidy()

    return run


def near_words(words: DataFrame, hot: int = HOT, rows: int = 16_384) -> DataFrame:
    """(a, n_a, b, n_b): every pair of ``words`` (word, n; words distinct) one edit apart, once."""
    ship(words.sparkSession)
    lists = divided(_lists(words), hot).repartition(tasks(words.sparkSession), "key") \
        .sortWithinPartitions("key", "size", "lo", "hi", "x").select("word", "n", "key", "size", "lo", "hi", "x")
    return lists.mapInArrow(_walk(rows), "a string, n_a bigint, b string, n_b bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled, so rounds grow with the
    logarithm of the longest chain. Counts double along a chain, hence no cycles. Words
    that have arrived leave the probing side."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    open_, done = at, None
    while True:
        step = cut_lineage(open_.join(at.select(F.col("word").alias("t"), F.col("root").alias("next")), F.col("root") == F.col("t"), "left"))
        arrived = step.where("next is null").select("word", "root")
        done = arrived if done is None else done.unionByName(arrived)
        open_ = step.where("next is not null").select("word", F.col("next").alias("root"))
        if open_.isEmpty():
            return done
        at = cut_lineage(done.unionByName(open_))


def variant_groups(words: DataFrame, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """word, n, form, root, n_near, form_n of a vocabulary (word, n; words distinct).

    A word's form is its near word of largest n, the smallest in code-point order among
    equals, if that n is at least ``ratio`` (2 or more, so that chains end) times its own.
    Null words are left out; no words give no rows.
    """
    words = words.where("word is not null")
    pairs = saved(near_words(words, hot), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")) \
        .unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("f"))
    big = -F.col("f.m") >= F.lit(ratio) * F.col("n")
    told = saved(best.select("word", "n_near", F.when(big, F.col("f.other")).alias("form"), F.when(big, -F.col("f.m")).alias("form_n")), "forms")
    roots = _roots(told.where("form is not null"))
    return words.join(told, "word", "left").join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """Variant groups over the words of all whole texts of ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z lower-cased; a run whose
    hash with its doc_id (null: empty) is a multiple of 97 loses a character. Null and
    empty texts have no words, repeated rows count again, other columns are not read.
    """
    return variant_groups(saved(vocabulary(docs, shortest, least), "vocabulary"), ratio, hot)


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
