"""Operator 5, toxicity by weak supervision.

Voters are words and word stems, a stated list and those that labelled training
rows suggest, and patterns of shouting and direct address. A generative label
model (EM) estimates how often each voter fires on toxic and on clean texts, and
how strongly two voters correlate given the label; the annotator's label is one more
voter. Its posteriors train a logistic classifier on the votes, which scores every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import few, filled, query, saved, ship, table, tidy

#: Labelled training rows that are read for fitting, those of least hash; held-out remainder.
#: Every sign that those rows support votes: its number is bounded by the words of the rows.
SAMPLE_ROWS, HELD_OUT = 20_000, 2
THRESHOLD = 0.3

# Insults that vote whatever the labels say.
INSULTS = ("idiot idiots moron morons stupid loser losers pathetic disgusting worthless scum trash "
           "dumb bastard imbécile connard crétin abruti idiota estúpido imbécil basura trottel dummkopf abschaum arschloch").split()
PATTERNS = (
    ("pattern:address", re.compile(r"\b(?:you|you're|tu es|du bist|eres)\s+(?:are\s+)?(?:an?|une?|eine?|un[oa]?|such|so)\b", re.I)),
    ("pattern:threat", re.compile(r"\b(?:shut up|go away|get lost|drop dead|hate you|kill you)\b", re.I)),
    ("pattern:masked", re.compile(r"\b[a-z]{1,2}[*@#$]{2,}[a-z]{1,3}\b", re.I)),
    ("pattern:shouting", re.compile(r"\b[A-ZÀ-Ý]{4,}!!")),
)
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str):
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == HELD_OUT


def signs(text: str) -> set[str]:
    """All words and stems of a text."""
    out = set(WORD.findall(text.lower()))
    for n in STEMS:
        out |= {f"{w[:n]}-" for w in out if len(w) >= n and not w.endswith("-")}
    return out


def votes(text: str, words: dict[str, int], stems: dict[int, dict[str, int]]) -> set[int]:
    """Voters that fire: a word's place, a stem's, then the patterns'."""
    fired = set()
    for w in set(WORD.findall(text.lower())):
        if w in words:
            fired.add(words[w])
        for n, at in stems.items():
            if w[:n] in at and len(w) >= n:
                fired.add(at[w[:n]])
    base = len(words) + sum(map(len, stems.values()))
    fired.update(base + i for i, (_, p) in enumerate(PATTERNS) if p.search(text))
    return fired


def _places(voters: list[str]) -> tuple[dict[str, int], dict[int, dict[str, int]]]:
    words = {v: i for i, v in enumerate(voters) if not v.endswith("-")}
    stems: dict[int, dict[str, int]] = {}
    for i, v in enumerate(voters):
        if v.endswith("-"):
            stems.setdefault(len(v) - 1, {})[v[:-1]] = i
    return words, stems


def _toxic_counts(batches):
    seen = Counter()
    for batch in few(batches, 512):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if label:
                seen.update(signs(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["sign", "toxic"])


def _clean_counts(wanted: set[str]):
    def run(batches):
        seen = Counter()
        for batch in few(batches, 512):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not label:
                    seen.update(signs(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["sign", "clean"])

    return run


def _fire(words, stems):
    def run(batches):
        for batch in few(batches, 512):
            fired = [sorted(votes(t, words, stems)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column(1)], ["fired", "toxic"])

    return run


class Votes:
    """Which voter fired in which text, as pairs; texts that vote alike are one with a number of copies."""

    def __init__(self, fired: list[list[int]], voters: int, copies: np.ndarray):
        self.n, self.voters, self.copies = len(fired), voters, copies
        self.text = np.repeat(np.arange(self.n), [len(f) for f in fired])
        self.voter = np.array([v for f in fired for v in f], np.int64)
        least = [np.array(f, np.int32) for f in fired]
        both = [np.triu_indices(len(f), 1) for f in fired]
        x = np.concatenate([f[i] for f, (i, _) in zip(least, both)] or [np.zeros(0, np.int32)])
        y = np.concatenate([f[j] for f, (_, j) in zip(least, both)] or [np.zeros(0, np.int32)])
        t = np.repeat(np.arange(self.n, dtype=np.int32), [len(i) for i, _ in both])
        self.pair, self.pair_of = np.unique(x.astype(np.int64) * voters + y, return_inverse=True)
        self.pair_of, self.pair_text = self.pair_of.astype(np.int32), t

    def over_texts(self, weights: np.ndarray) -> np.ndarray:
        """For each voter the sum of text weights where it fires."""
        return np.bincount(self.voter, weights[self.text], self.voters)

    def over_voters(self, weights: np.ndarray) -> np.ndarray:
        """For each text the sum of weights of the voters that fire."""
        return np.bincount(self.text, weights[self.voter], self.n)

    def correlations(self, mass: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """Of each pair that fires together somewhere, over texts of the given mass."""
        x, y = self.pair // self.voters, self.pair % self.voters
        both = np.bincount(self.pair_of, mass[self.pair_text], len(self.pair)) / (mass.sum() + 1)
        return (both - rate[x] * rate[y]) / np.sqrt(rate[x] * (1 - rate[x]) * rate[y] * (1 - rate[y]))


def label_model(votes: Votes, gold: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior that each text is toxic. ``gold``: the annotator's vote.

    Every round estimates, from the posteriors so far, how often each voter fires given
    the label and how far pairs of voters correlate given the label. A voter's evidence is
    divided by one plus its correlations, so that voters which repeat each other count once.
    """
    copies, n = votes.copies, votes.copies.sum()
    q = np.where(gold == 1, 0.95, 0.05)
    total = votes.over_texts(copies)
    x, y = votes.pair // votes.voters, votes.pair % votes.voters
    for _ in range(rounds):
        ones, zeros = q * copies, (1 - q) * copies
        pi = np.clip(ones.sum() / n, 1e-4, 1 - 1e-4)
        # one pseudo-text that fires at the voter's own rate
        rate = (total + 0.5) / (n + 1)
        alpha = np.clip((votes.over_texts(ones) + rate) / (ones.sum() + 1), 1e-6, 1 - 1e-6)
        beta = np.clip((votes.over_texts(zeros) + rate * 0.1) / (zeros.sum() + 1), 1e-6, 1 - 1e-6)
        given1, given0 = votes.correlations(ones, alpha), votes.correlations(zeros, beta)
        joint = np.clip(np.maximum(given1, pi * given1 + (1 - pi) * given0), 0, 1)
        share = 1 / (1 + np.bincount(x, joint, votes.voters) + np.bincount(y, joint, votes.voters))
        on, off = np.log(alpha / beta) * share, np.log((1 - alpha) / (1 - beta)) * share
        right1 = np.clip((ones @ gold + 9) / (ones.sum() + 10), 0.6, 0.99)  # the annotator
        right0 = np.clip((zeros @ (1 - gold) + 9) / (zeros.sum() + 10), 0.6, 0.999)
        z = np.log(pi / (1 - pi)) + votes.over_voters(on - off) + off.sum()
        z += np.where(gold == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


def fit_classifier(votes: Votes, target: np.ndarray, penalty: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Logistic weights (the last is the intercept) by Newton steps on soft labels, each
    solved by conjugate gradients, as the table of texts by voters is almost empty."""
    w, ridge = np.zeros(votes.voters + 1), np.full(votes.voters + 1, penalty)
    ridge[-1] = 1e-3

    def down(u):
        return np.append(votes.over_texts(u), u.sum())

    def along(v):
        return votes.over_voters(v[:-1]) + v[-1]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(along(w), -30, 30)))
        curve = p * (1 - p) * votes.copies
        residual = down((target - p) * votes.copies) - ridge * w
        scale = np.append(votes.over_texts(curve), curve.sum()) + ridge
        step, r = np.zeros_like(w), residual
        d = z = r / scale
        for _ in range(200):
            hd = down(curve * along(d)) + ridge * d
            a = (r @ z) / max(d @ hd, 1e-300)
            step, new = step + a * d, r - a * hd
            if np.abs(new).max() < 1e-9 * max(np.abs(residual).max(), 1e-300):
                break
            nz = new / scale
            d, r, z = nz + (new @ nz) / max(r @ z, 1e-300) * d, new, nz
        w += step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def beyond_chance(hits: list[int], tries: list[int], base: float, share: float = 0.05) -> np.ndarray:
    """Which of many hit rates lie above ``base`` by more than chance: at most about ``share``
    of those named do so by luck. Step-up procedure on bounds of binomial tails."""
    k, n = np.array(hits, float), np.array(tries, float)
    p = np.clip(k / n, 1e-12, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = p * np.log(p / base) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - base)), 0.0)
    tail = np.where(p > base, np.exp(-n * far), 1.0)
    order = np.sort(tail)
    below = np.flatnonzero(order <= share * np.arange(1, len(order) + 1) / max(len(order), 1))
    return tail <= (order[below[-1]] if len(below) else -1.0)


def one_of_each_family(signs: list[str], toxic: dict[str, int]) -> list[str]:
    """Signs, best first, without those that a better one of the same family (a word, its
    stems, words of the stem) makes idle: the two fire together nine times in ten."""
    kept: dict[str, list[str]] = {}
    out = []
    for s in signs:
        base = s.removesuffix("-")
        family = kept.setdefault(base[:min(STEMS)], [])
        if not any((base.startswith(o.removesuffix("-")) or o.removesuffix("-").startswith(base))
                   and min(toxic[s], toxic[o]) >= 0.9 * max(toxic[s], toxic[o]) for o in family):
            family.append(s)
            out.append(s)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(voters, weights). Reads labels of training rows only, at most ``sample_rows`` of
    them; without any, the stated insults get a weight of their own."""
    ship(docs.sparkSession)
    seeds = [*INSULTS]
    base = np.concatenate([np.full(len(seeds), 5.0), np.full(len(PATTERNS), 0.1), [-4.0]])
    sample = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic is not null") \
        .where(~held_out("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("id"), filled(text).alias("text")) \
        .join(F.broadcast(sample), F.col("id") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"))  # at most sample_rows ids
    # a text teaches once, however many copies of it are labelled: else each of its words would seem proven
    rows = saved(rows.groupBy(F.sha2("text", 256).alias("sha"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic"), "labelled")
    counts = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = counts["t"] or 0, counts["n"]
    if not t or t == n:
        return seeds, base
    least = 3 if t < 1000 else 5
    found = rows.mapInArrow(_toxic_counts, "sign string, toxic long").groupBy("sign").agg(F.sum("toxic").alias("toxic")) \
        .where(F.col("toxic") >= least).collect()  # no more than the words of the sample
    toxic = {r["sign"]: r["toxic"] for r in found}
    clean = {r["sign"]: r["c"] for r in rows.mapInArrow(_clean_counts(set(toxic)), "sign string, clean long").groupBy("sign").agg(F.sum("clean").alias("c")).collect()}

    def lower(s):  # lower end of the precision, one in a hundred odds
        k, of = toxic[s], toxic[s] + clean.get(s, 0)
        p, z2 = k / of, 2.33 ** 2
        return (p + z2 / (2 * of) - 2.33 * np.sqrt(p * (1 - p) / of + z2 / (4 * of * of))) / (1 + z2 / of)

    # a sign must beat the base rate clearly, and not by the luck of one among all that are tried
    proven = beyond_chance([toxic[s] for s in toxic], [toxic[s] + clean.get(s, 0) for s in toxic], t / n)
    good = sorted((s for s, ok in zip(toxic, proven) if ok and lower(s) > max(1.5 * t / n, 0.25)), key=lambda s: (-toxic[s] * lower(s), s))
    voters = [*dict.fromkeys([*one_of_each_family(good, toxic), *seeds])]
    words, stems = _places(voters)
    # texts that vote alike count once, with their number: at most sample_rows short lists
    alike = rows.mapInArrow(_fire(words, stems), "fired array<int>, toxic int").groupBy("toxic", "fired").agg(F.count("*").alias("copies")) \
        .orderBy("toxic", "fired").collect()
    fires = Votes([r["fired"] for r in alike], len(voters) + len(PATTERNS), np.array([r["copies"] for r in alike], float))
    posterior = label_model(fires, np.array([r["toxic"] for r in alike]))
    weights = fit_classifier(fires, posterior)
    unseen = fires.over_texts(fires.copies) == 0
    stated = max(5.0, 2.0 - weights[-1])  # an insult that the sample doesn't hold still speaks
    weights[:-1][unseen] = np.concatenate([np.full(len(voters), stated), np.full(len(PATTERNS), 0.0)])[unseen]
    del fires, alike, toxic, clean, posterior
    tidy()  # what fitting took goes back, as the driver lives on
    return voters, weights


def _score(words, stems, weights):
    def run(batches):
        for batch in few(batches, 512):
            z = [weights[-1] + sum(weights[i] for i in votes(t, words, stems)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Whole texts are read; null counts as empty, and an empty text has the score of a
    text in which no voter fires. Labels that are null, of unknown ids or held out
    teach nothing; of repeated labels the larger counts. Equal rows get equal scores;
    no rows give no rows; other columns are not read.
    """
    voters, weights = train(docs, labels, doc_id=doc_id, text=text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), filled(text).alias("text"))
    scored = slim.mapInArrow(_score(*_places(voters), weights.tolist()), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep_clean(words, stems, weights, threshold, at):
    def run(batches):
        for batch in few(batches, 512):
            z = [weights[-1] + sum(weights[i] for i in votes(t or "", words, stems)) for t in batch.column(at).to_pylist()]
            keep = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))) < threshold
            yield batch.filter(pa.array(keep))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score the threshold or more; rows don't move."""
    voters, weights = train(docs, labels)
    return docs.mapInArrow(_keep_clean(*_places(voters), weights.tolist(), threshold, docs.columns.index("text")), docs.schema)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
