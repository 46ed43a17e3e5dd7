"""Operator 13, language identification by a linear-chain conditional random field.

Every word of a text gets a language: its affixes, its character n-grams and the
lexicons it stands in speak for languages, learned transitions say how readily one
language follows another, and forward-backward weighs both over the whole text. So a
text that switches languages is divided into runs, and a text as a whole has the
language that holds the largest share of its words.

Forward-backward does not go through a text word by word. Words lie in blocks; the
transfer matrices of all blocks are multiplied together in step, messages pass from
block to block, and all blocks are then filled in step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import filled, query, ship, table, tidy

#: Training rows per language (those of least hash) and words of each, from a place that the hash picks.
ROWS_PER_LANGUAGE, WORDS_PER_ROW = 150, 150
#: Made training texts switch language after so many words on average; words of a training sequence.
SWITCH, SEQUENCE = 25, 64
#: Slots of hashed features, rounds of training, weight of the squared norm.
SLOTS, ROUNDS, RIDGE = 1 << 16, 50, 1e-5
#: Times a word must stand in the lexicon's half of the sample, and its share there in one language.
LEXICON_TIMES, LEXICON_SHARE = 3, 0.8
HELD_OUT = 0
UNKNOWN = "und"
#: Words of a block, characters read at a time, words whose evidence a task remembers.
BLOCK, SLICE, REMEMBERED = 32, 1 << 20, 300_000

WORD = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")


def held_out(doc_id: str):
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == HELD_OUT


def words_of(text: str):
    """The lower-cased words of a text, list by list, each from about SLICE characters."""
    text, at = text.lower(), 0
    while at < len(text):
        to = at + SLICE
        if to < len(text):
            gap = GAP.search(text, to)
            to = gap.start() if gap else len(text)
        yield WORD.findall(text, at, to)
        at = to


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): hashed affixes of one to three characters and n-grams of two to
    four of each word between marks."""
    marked = "".join(f"^{w}$" for w in words)
    size = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(codes))  # characters from here to the word's end
    step = np.uint64(0x9E3779B97F4A7C15)
    found, whose = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        fits = left >= n
        h = h * step + np.where(fits, codes[np.minimum(np.arange(len(codes)) + n - 1, len(codes) - 1)] + np.uint64(1), np.uint64(0))
        if n >= 2:
            at = np.flatnonzero(fits)
            found.append(h[at] + np.uint64(n))
            whose.append(owner[at])
            for kind, place in ((11, start), (12, start + size - n)):  # with the mark: affixes of n - 1 characters
                ok = size - 1 >= n
                found.append(h[place[ok]] * step + np.uint64(kind * 8 + n))
                whose.append(np.flatnonzero(ok))
    h, whose = np.concatenate(found), np.concatenate(whose)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(whose, kind="stable")
    slots = ((h ^ (h >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)[order]
    return slots, np.searchsorted(whose[order], np.arange(len(words) + 1)).astype(np.int64)


@dataclass
class Field:
    """Weights of the random field. ``lexicon`` gives a word's set of languages as bits."""

    langs: list[str]
    slots: np.ndarray  # SLOTS x languages
    standing: np.ndarray  # language whose lexicon it is x languages
    bias: np.ndarray
    moves: np.ndarray  # log weights, from x to
    lexicon: dict[str, int]

    def stands(self, words: list[str]) -> np.ndarray:
        bits = np.array([self.lexicon.get(w, 0) for w in words], np.int64)
        return (bits[:, None] >> np.arange(len(self.langs)) & 1).astype(np.float32)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log evidence of each word for each language."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        slots, at = features(words)
        mean = np.add.reduceat(self.slots[slots], at[:-1], 0) / np.sqrt(np.diff(at))[:, None]
        return (mean + self.stands(words) @ self.standing + self.bias).astype(np.float32)


def _softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    return x / x.sum(axis, keepdims=True)


def marginals(log_evidence: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences of equal length (steps, sequences, languages):
    posteriors of each step, summed posteriors of each move, log of all paths."""
    steps, many, k = log_evidence.shape
    top = log_evidence.max(2, keepdims=True)
    e, a = np.exp(log_evidence - top), np.exp(moves)
    ahead, scale = np.empty_like(e), np.empty((steps, many, 1))
    now = np.full((many, k), 1 / k)
    for t in range(steps):
        now = (now if t == 0 else now @ a) * e[t]
        scale[t] = now.sum(1, keepdims=True)
        now = now / scale[t]
        ahead[t] = now
    post, pairs, back = np.empty_like(e), np.zeros((k, k)), np.ones((many, k))
    for t in range(steps - 1, -1, -1):
        post[t] = ahead[t] * back
        if t:
            right = e[t] * back / scale[t]
            pairs += (ahead[t - 1].T @ right) * a
            back = right @ a.T
    return post, pairs, float(np.log(scale).sum() + top.sum())


def fit(rows: list[tuple[str, int, list[str]]], rounds: int = ROUNDS, seed: int = 5) -> Field | None:
    """A field from (lang, number, words) rows. Rows of even number make the lexicons, the
    others the sequences: pieces of rows of several languages behind each other, so that
    transitions are learned from text that switches. None without rows."""
    rows = [r for r in rows if r[2]]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    at = {lang: i for i, lang in enumerate(langs)}
    seen: dict[str, np.ndarray] = {}
    for lang, number, words in rows:
        if number % 2 == 0:
            for w in words:
                seen.setdefault(w, np.zeros(k))[at[lang]] += 1
    whole = np.maximum(sum(seen.values(), np.zeros(k)), 1)
    lexicon = {}
    for w, n in seen.items():
        share = n / whole
        if n.sum() >= LEXICON_TIMES and share.max() >= LEXICON_SHARE * share.sum():
            lexicon[w] = 1 << int(share.argmax())

    by_lang: list[list[list[str]]] = [[] for _ in langs]
    for lang, number, words in rows:
        by_lang[at[lang]].append((number % 2 == 0, words))
    pieces = []
    for i, own in enumerate(by_lang):
        use = [w for even, w in own if not even] or [w for _, w in own]
        for words in use:
            lo = 0
            while lo < len(words):
                n = int(rng.geometric(1 / SWITCH))
                pieces.append((i, words[lo:lo + n]))
                lo += n
    stream, gold = [], []
    for p in rng.permutation(len(pieces)):
        stream += pieces[p][1]
        gold += [pieces[p][0]] * len(pieces[p][1])
    short = -len(stream) % SEQUENCE
    stream, gold = stream + stream[:1] * short, gold + gold[:1] * short
    distinct = sorted(set(stream))
    place = {w: i for i, w in enumerate(distinct)}
    ids = np.array([place[w] for w in stream]).reshape(-1, SEQUENCE).T
    y = np.array(gold).reshape(-1, SEQUENCE).T
    truth = np.eye(k)[y]
    slots, offs = features(distinct)
    used, slots = np.unique(slots, return_inverse=True)
    each = 1 / np.sqrt(np.diff(offs))
    field = Field(langs, np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), lexicon)
    stands = field.stands(distinct).astype(float)
    owner = np.repeat(np.arange(len(distinct)), np.diff(offs))
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (y[:-1].ravel(), y[1:].ravel()), 1)
    params = [field.slots, field.standing, field.bias, field.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        evidence = np.add.reduceat(field.slots[slots], offs[:-1], 0) * each[:, None] + stands @ field.standing + field.bias
        post, pairs, _ = marginals(evidence[ids], field.moves)
        off = (post - truth).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), off[:, c], len(distinct)) for c in range(k)], 1) / len(off)
        spread = (by_word * each[:, None])[owner]
        grads = [np.stack([np.bincount(slots, spread[:, c], len(used)) for c in range(k)], 1), stands.T @ by_word, by_word.sum(0), (pairs - true_moves) / len(off)]
        for p, g, m, v in zip(params, grads, first, second):  # Adam
            g = g + RIDGE * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.2 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    table_ = np.zeros((SLOTS, k), np.float32)
    table_[used] = field.slots
    field.slots = table_
    return field


def block_posteriors(evidence: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of every word (words x languages) of texts that have ``counts`` words."""
    k = evidence.shape[1]
    blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    many = int(first[-1])
    if not many:
        return np.zeros((0, k), np.float32)
    word0 = np.concatenate([[0], np.cumsum(counts)])[:-1]
    nth = np.arange(len(evidence)) - np.repeat(word0, counts)
    row, col = np.repeat(first[:-1], counts) + nth // BLOCK, nth % BLOCK
    e = np.zeros((BLOCK, many, k), np.float32)
    e[col, row] = np.exp(evidence - evidence.max(1, keepdims=True))
    there = np.zeros((BLOCK, many), bool)
    there[col, row] = True
    a = _softmax(moves).astype(np.float32)
    # 1. the transfer matrix of each block
    whole = np.broadcast_to(np.eye(k, dtype=np.float32), (many, k, k)).copy()
    for t in range(BLOCK):
        live = slice(None) if there[t].all() else np.flatnonzero(there[t])
        step = (whole[live] @ a) * e[t, live][:, None, :]
        whole[live] = step / step.max((1, 2), keepdims=True)
    # 2. messages from block to block of a text, all texts in step
    ahead, back = np.full((many, k), 1 / k, np.float32), np.ones((many, k), np.float32)
    order = np.argsort(-blocks, kind="stable")
    for b in range(1, int(blocks.max())):
        order = order[blocks[order] > b]
        at = first[order] + b
        ahead[at] = np.einsum("nk,nkj->nj", ahead[at - 1], whole[at - 1])
        ahead[at] /= ahead[at].sum(1, keepdims=True)
        at = first[order + 1] - 1 - b
        back[at] = np.einsum("nkj,nj->nk", whole[at + 1], back[at + 1])
        back[at] /= back[at].sum(1, keepdims=True)
    # 3. inside the blocks
    forward, now = np.empty_like(e), ahead
    for t in range(BLOCK):
        step = (now @ a) * e[t]
        step /= np.maximum(step.sum(1, keepdims=True), 1e-30)
        now = np.where(there[t][:, None], step, now)
        forward[t] = now
    now = back
    for t in range(BLOCK - 1, -1, -1):
        here = there[t][:, None]
        step = (now * e[t]) @ a.T
        step /= np.maximum(step.max(1, keepdims=True), 1e-30)
        forward[t] *= now
        now = np.where(here, step, now)
    post = forward[col, row]
    return post / np.maximum(post.sum(1, keepdims=True), 1e-30)


class Reader:
    """Turns texts into word evidence; remembers the words that it has met."""

    def __init__(self, field: Field):
        self.field, self.place, self.rows = field, {}, np.zeros((0, len(field.langs)), np.float32)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of the evidence of all words, words per text)."""
        place, out, counts = self.place, [], np.zeros(len(texts), np.int64)
        found: list[str] = []
        for i, text in enumerate(texts):
            for part in words_of(text or ""):
                if len(part) > SLICE // 8:  # a very long text: its words are not held together
                    out.append(self._places(found))
                    found = []
                found += part
                counts[i] += len(part)
        out.append(self._places(found))
        at = np.concatenate(out)
        if (at < 0).any():  # runs without a letter are no words
            counts -= np.bincount(np.repeat(np.arange(len(texts)), counts)[at < 0], minlength=len(texts))
            at = at[at >= 0]
        return at, counts

    def _places(self, found: list[str]) -> np.ndarray:
        place = self.place
        new = sorted(w for w in set(found) if w not in place)
        if new:
            letters = [w for w in new if any(map(str.isalpha, w))]
            place.update(dict.fromkeys(new, -1))
            place.update(zip(letters, range(len(self.rows), len(self.rows) + len(letters))))
            self.rows = np.concatenate([self.rows, self.field.evidence(letters)])
        return np.fromiter(map(place.__getitem__, found), np.int64, len(found))

    def forget(self) -> None:
        if len(self.place) > REMEMBERED:
            self.place, self.rows = {}, self.rows[:0]


def _groups(texts: list[str | None]):
    """Bounds of runs of texts of about SLICE characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


SPANS = "array<struct<lang:string,first:int,words:int>>"


def _identify(field: Field):
    langs = np.array(field.langs, object)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        reader = Reader(field)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _groups(texts):
                at, counts = reader.ids(texts[lo:hi])
                post = block_posteriors(reader.rows[at], counts, field.moves)
                reader.forget()
                owner = np.repeat(np.arange(hi - lo), counts)
                total = np.stack([np.bincount(owner, post[:, c], hi - lo) for c in range(len(langs))], 1)
                share = total / np.maximum(total.sum(1, keepdims=True), 1e-30)
                best = share.argmax(1)
                some = counts > 0
                label = post.argmax(1) if len(post) else np.zeros(0, np.int64)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                begin = np.concatenate([[0], np.cumsum(counts)])
                spans = pa.StructArray.from_arrays([pa.array(langs[label[at]], pa.string()), pa.array((at - begin[owner[at]]).astype(np.int32)),
                                                    pa.array(np.diff(np.append(at, len(label))).astype(np.int32))], fields=list(span.value_type))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.where(some, langs[best], UNKNOWN), pa.string()),
                    pa.array(np.where(some, np.minimum(share[np.arange(hi - lo), best], 1.0), 0.0), pa.float64()), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(at, begin).astype(np.int32)), spans)],
                    ["doc_id", "lang_pred", "score", "n_words", "spans"])
        tidy()

    return run


def _windows(batches):
    """From each text WORDS_PER_ROW words, from a place that its hash picks."""
    for batch in batches:
        out = []
        for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = [w for part in words_of(text) for w in part]
            out.append(words[(lo := h % max(len(words) - WORDS_PER_ROW + 1, 1)):lo + WORDS_PER_ROW])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["lang", "h", "words"])


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS) -> Field | None:
    """A field from the labelled rows of ``docs`` that are not held out: per language the
    ``rows`` distinct ones of least hash over (doc_id, text). Only their windows of words,
    rows x 150 a language, reach the driver. Rows of null lang or text teach nothing."""
    ship(docs.sparkSession)
    slim = docs.where("lang is not null and text is not null").where(~held_out("doc_id")) \
        .select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text")
    least = slim.select("lang", "h").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))) \
        .where(F.col("nth") <= rows).groupBy("lang").agg(F.max("h").alias("last"))
    bounds = {r["lang"]: r["last"] for r in least.collect()}  # one row a language
    if not bounds:
        return None
    last = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))[F.col("lang")]
    sample = slim.where(F.col("h") <= last).mapInArrow(_windows, "lang string, h bigint, words array<string>") \
        .groupBy("lang", "h").agg(F.first("words").alias("words")).collect()
    number = {lang: 0 for lang in bounds}
    told = []
    for lang, _, words in sorted((r["lang"], r["h"], r["words"]) for r in sample):
        told.append((lang, number[lang], words))
        number[lang] += 1
    return fit(told, rounds)


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, n_words, spans (runs of words
    of one language: lang, number of the first word, words).

    A word is a run of letters, lower-cased. ``lang_pred`` holds the largest share of the
    words' posteriors, the first in order among equals, and ``score`` is that share. A null
    or empty text and one without letters get 'und', score 0 and no spans, as does every
    text where nothing was learned. Repeated rows get the same answer each; no rows give no
    rows; columns but doc_id and text are not read here.
    """
    ship(docs.sparkSession)
    slim = docs.select("doc_id", filled().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    if field is None:
        return slim.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"),
                           F.array().cast(SPANS).alias("spans"))
    return slim.mapInArrow(_identify(field), f"doc_id {kind}, lang_pred string, score double, n_words bigint, spans {SPANS}")


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
