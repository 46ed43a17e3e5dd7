"""Operator 4, HTML extraction by a recurrent block labeller.

A page is its sequence of leaf blocks. Each block is a vector: the mean of its tag
path's hashed embeddings, the mean of its words' hashed embeddings, and a few
lengths. A bidirectional LSTM in numpy reads the sequence and gives each block a
probability of being main text, in sight of the whole page. It is trained here, on
made pages whose truth is known and on a bounded sample of given pages in which
elements of unmistakable meaning are labels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .blocks import Block, Node, leaf_blocks, made_page
from .common import query, ship, table
from .words import words

#: Given pages read for training (those of least hash), made pages, passes over both.
SAMPLE_PAGES, MADE_PAGES, PASSES = 200, 600, 6
PATHS, WORDS, PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 4096, 4096, 16, 6, 6, 20
#: Blocks that advance together, padding counted.
CELLS = 1 << 15

# Elements whose meaning labels the sample.
IS_TEXT, IS_NOT = frozenset(["article"]), frozenset("nav header footer aside form .ad .ads .advert .sidebar .comments .comment .menu".split())

#: Of a given page in the training sample: words of a block and words in all that made pages
#: borrow, and the longest path. A page with a longer one teaches nothing.
BLOCK_WORDS, BORROWED, DEEPEST = 200, 20_000, 200


def _ids(names) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % PATHS for x in names], np.int64)


def _ordered(path: Node) -> list[str]:
    """The last names of a path in order, as further features."""
    return [*(f"{k}<{t}" for k, t in enumerate(path.tags)), ">".join(reversed(path.tags[:2]))]


class Features:
    """Blocks of several pages as flat arrays; hashed features of their paths only to learn from."""

    def __init__(self, pages: list[list[Block]], learn: bool = True):
        flat = [b for page in pages for b in page]
        self.counts = np.array([len(p) for p in pages], np.int64)
        self.nodes = [b.path for b in flat]
        ids = [_ids([*b.path.parts(), *_ordered(b.path)]) for b in flat] if learn else []
        self.path = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.path_of = np.repeat(np.arange(len(ids)), [len(i) for i in ids]) if ids else self.path
        raw = [b.text.encode("utf-8") for b in flat]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        h, _, _, at = words(data, offs)
        self.word = (h % np.uint64(WORDS)).astype(np.int64)
        n_words = np.diff(at)
        self.word_of = np.repeat(np.arange(len(flat)), n_words)
        chars = np.diff(offs)
        ends = np.array([b.text[-1] in ".!?" for b in flat], float)
        self.numbers = np.column_stack([np.log1p(n_words) / 4, np.log1p(chars) / 6, [b.linked for b in flat], ends, chars / np.maximum(n_words, 1) / 10,
                                        [min(b.path.length, 20) / 10 for b in flat]]) if flat else np.zeros((0, NUMBERS))
        self.size = len(flat)


def _mean(table: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out, count = np.zeros((n, table.shape[1])), np.maximum(np.bincount(of, minlength=n), 1)
    if len(of):
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for lo in range(0, len(at), 4096):  # some blocks at a time: few words in memory
            hi = at[lo + 4096] if lo + 4096 < len(at) else len(of)
            out[of[at[lo:lo + 4096]]] = np.add.reduceat(table[ids[at[lo]:hi]], at[lo:lo + 4096] - at[lo], axis=0)
    return out / count[:, None], count


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTM directions and a logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        x = PATH_DIMS + WORD_DIMS + NUMBERS
        self.p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIMS)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIMS)), "out": rng.normal(0, 0.2, 2 * HIDDEN + x), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(x + HIDDEN), (x + HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # remember at first

    def _path(self, node: Node) -> np.ndarray:
        """Mean embedding of a path's features: sums go down the chain and stay with its nodes."""
        table, chain = self.p["path"], []
        at = node
        while at is not None and at.owner is not self:
            chain.append(at)
            at = at.parent
        for n in reversed(chain):
            above = n.parent
            n.count = len(n.fresh) + (above.count if above else 0)
            n.total = table[_ids(n.fresh)].sum(0) + (above.total if above else 0.0)
            n.owner = self
        tail = _ids(_ordered(node))
        return (node.total + table[tail].sum(0)) / (node.count + len(tail))

    def vectors(self, f: Features) -> np.ndarray:
        if f.size and not len(f.path):
            known = {id(n): n for n in f.nodes}
            means = {i: self._path(n) for i, n in known.items()}
            path = np.stack([means[id(n)] for n in f.nodes])
        else:
            path, self._np = _mean(self.p["path"], f.path, f.path_of, f.size)
        word, self._nw = _mean(self.p["word"], f.word, f.word_of, f.size)
        return np.concatenate([path, word, f.numbers], axis=1)

    @staticmethod
    def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of pages x steps as block numbers, 0 where there is none; which there are)."""
        steps = np.arange(int(counts.max(initial=0)))
        real = steps[None, :] < counts[:, None]
        return np.where(real, (np.cumsum(counts) - counts)[:, None] + steps[None, :], 0), real

    def _run(self, x: np.ndarray, real: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        w, bias, (n, steps, _) = self.p[f"w{d}"], self.p[f"c{d}"], x.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, steps, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            both = np.concatenate([x[:, t], h], axis=1)
            z = both @ w + bias
            gates = _sigmoid(z[:, :3 * HIDDEN])
            forget, take, show, new = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            live = real[:, t, None]
            before, c = c, np.where(live, forget * c + take * new, c)
            squashed = np.tanh(c)
            h = np.where(live, show * squashed, h)
            out[:, t] = h
            if trace is not None:
                trace.append((t, both, forget, take, show, new, before, squashed, live))
        return out

    def _states(self, drive: np.ndarray, real: np.ndarray, d: str) -> np.ndarray:
        """As ``_run`` without a trace, in single precision; ``drive`` is the input's part of all gates."""
        w, (n, steps, _) = self.p[f"w{d}"][-HIDDEN:].astype(np.float32), drive.shape
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            live = np.flatnonzero(real[:, t])
            z = h[live] @ w
            z += drive[live, t]
            gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, :3 * HIDDEN])
            c[live] = gates[:, :HIDDEN] * c[live] + gates[:, HIDDEN:2 * HIDDEN] * np.tanh(z[:, 3 * HIDDEN:])
            h[live] = gates[:, 2 * HIDDEN:] * np.tanh(c[live])
            out[live, t] = h[live]
        return out

    def probabilities(self, f: Features) -> np.ndarray:
        """Of each block, pages of like length together."""
        x, out = self.vectors(f), np.zeros(f.size)
        drives = {d: (x @ self.p[f"w{d}"][:x.shape[1]] + self.p[f"c{d}"]).astype(np.float32) for d in "fb"}
        starts, order = np.cumsum(f.counts) - f.counts, np.argsort(f.counts, kind="stable")
        order = order[f.counts[order] > 0]
        while len(order):
            most = f.counts[order]
            n = int(max(1, np.searchsorted(most * np.arange(1, len(order) + 1), CELLS, "right")))
            mine, order = order[:n], order[n:]
            cells, real = self._grid(f.counts[mine])
            cells = np.where(real, cells - (np.cumsum(f.counts[mine]) - f.counts[mine])[:, None] + starts[mine][:, None], 0)
            both = np.concatenate([self._states(drives[d][cells], real, d)[real] for d in "fb"] + [x[cells[real]]], axis=1)
            out[cells[real]] = _sigmoid(both @ self.p["out"] + self.p["bias"])
        return out

    def gradients(self, f: Features, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        flat = self.vectors(f)
        cells, real = self._grid(f.counts)
        x = flat[cells]
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, real, "f", traces["f"]), self._run(x, real, "b", traces["b"]), x], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["bias"])
        dz = np.where(real, (p - y[cells]) * weight[cells], 0) / max(weight.sum(), 1)
        g = {"out": np.einsum("nt,ntk->k", dz, both), "bias": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.p["out"]
        dx = dboth[:, :, 2 * HIDDEN:].copy()
        for d, at in (("f", 0), ("b", HIDDEN)):
            w = self.p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, inp, forget, take, show, new, before, squashed, live in reversed(traces[d]):
                dh = dh + dboth[:, t, at:at + HIDDEN]
                mine = np.where(live, dh, 0)
                dcell = np.where(live, dc + mine * show * (1 - squashed ** 2), dc)
                back = np.where(live, dcell, 0)
                dzz = np.concatenate([back * before * forget * (1 - forget), back * new * take * (1 - take), mine * squashed * show * (1 - show), back * take * (1 - new ** 2)], axis=1)
                gw += inp.T @ dzz
                gc += dzz.sum(0)
                dinp = dzz @ w.T
                dx[:, t] += dinp[:, :x.shape[2]]
                dh = np.where(live, dinp[:, x.shape[2]:], dh)
                dc = np.where(live, dcell * forget, dc)
            g[f"w{d}"], g[f"c{d}"] = gw, gc
        dflat = np.zeros_like(flat)
        dflat[cells[real]] = dx[real]
        for name, ids, of, count, lo, hi in (("path", f.path, f.path_of, self._np, 0, PATH_DIMS), ("word", f.word, f.word_of, self._nw, PATH_DIMS, PATH_DIMS + WORD_DIMS)):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, (dflat[:, lo:hi] / count[:, None])[of])
        return g

    def fit(self, pages: list[list[Block]], passes: int = PASSES, batch: int = 16, seed: int = 3) -> "Labeller":
        """Adam on blocks whose keep is 0 or 1; others give context only."""
        rng = np.random.default_rng(seed)
        pages = [p for p in pages if p]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, passes * -(-len(pages) // batch)
        for _ in range(passes):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                mine = [pages[i] for i in order[lo:lo + batch]]
                keep = np.array([b.keep for p in mine for b in p], float)
                g = self.gradients(Features(mine), np.maximum(keep, 0), (keep >= 0).astype(float))
                step += 1
                rate = 0.02 * (1 - 0.9 * step / steps)
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def training_pages(sample: list[str], made: int = MADE_PAGES, seed: int = 21) -> list[list[Block]]:
    """Made pages with words of the sample, and the sample with labels where elements say them."""
    rng = np.random.default_rng(seed)
    given = [leaf_blocks(x) for x in sample]
    given = [page for page in given if all(b.path.length <= DEEPEST for b in page)]
    vocabulary = sorted({w for page in given for b in page for w in b.text.split()[:BLOCK_WORDS]})[:BORROWED] or [f"word{i}" for i in range(500)]
    vocabulary = [w.replace("<", "").replace("&", "").replace("{", "").replace("}", "") or "x" for w in vocabulary]
    for page in given:
        for b in page:
            tags = set(b.path.parts())
            b.keep = 0 if tags & IS_NOT else 1 if tags & IS_TEXT else -1
    return [*(leaf_blocks(made_page(rng, vocabulary), made=True) for _ in range(made)), *given]


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Fits the labeller on at most ``sample_pages`` given pages and on made ones."""
    rows = pages.select(F.coalesce(F.col(html), F.lit("")).alias("html"), F.col(page_id).alias("id")).orderBy(F.xxhash64("id", F.length("html")), "id").limit(sample_pages)
    return Labeller().fit(training_pages([r["html"] for r in rows.orderBy("id", "html").collect()]))


def _extract(model):
    def run(batches):
        labeller = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pages = [leaf_blocks(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                keep = (labeller.probabilities(Features(pages, learn=False)) >= 0.5).tolist()
                texts, k = [], 0
                for p in pages:
                    texts.append("\n".join(b.text for b, ok in zip(p, keep[k:k + len(p)]) if ok))
                    k += len(p)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 [*part.schema.names[:-1], "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Kept blocks in page order, joined by newlines. Null html is empty; a page without
    main text has an empty text; unclosed and unknown markup is read as far as it
    goes, in time that grows with the page. A page's own ``data-keep`` means nothing. Repeated rows get equal results, null ids and URLs stay null, no rows give
    no rows, other columns are not read. The model is sent to the executors; its size
    is that of its parameters.
    """
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(train(pages, page_id, html))
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return slim.mapInArrow(_extract(model), f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
