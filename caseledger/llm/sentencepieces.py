"""Operator 9, SentencePiece encoding and decoding by batched Viterbi.

The public vocabulary is of the byte-pair kind: the right segmentation is not the
one of largest score sum, it is the only one whose neighbours would all survive
merging side by side. So the path of every prefix keeps the last piece, chosen by
maximum among the pieces that end there and are compatible with the best piece
before them; exactly one is. Words of equal length advance together, a character a
step; substring hashes probe the sorted hashes of all pieces, and the chosen
pieces are the backpointers. Distinct words are encoded once a batch.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import filled, list_array, query, ship, table, tidy
from .words import _power, mix, text_buffers

#: Distinct words a worker remembers before it starts anew; texts encoded at a time; words of one length at a time.
REMEMBERED, STRIDE, TOGETHER = 400_000, 1024, 10_000

_STEP, _BACK = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_NEVER = 1 << 40


class Pieces:
    """Tables of a byte-pair piece vocabulary with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        texts = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        normal = []
        for i, t in enumerate(texts):
            if model.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        if (self.byte < 0).any():
            raise ValueError(f"{path}: not every byte has a piece")
        ids = {texts[i]: i for i in normal}
        if any("▁" in t.lstrip("▁") for t in ids):
            raise ValueError(f"{path}: a piece spans words")
        self.space = ids["▁"]
        # ranks of merges: better scores first; single characters are there from the start
        order = sorted({model.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.rank = np.full(n, -1, np.int64)
        for t, i in ids.items():
            if len(t) > 1:
                self.rank[i] = place[model.get_score(i)]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        dead = []
        for t, i in ids.items():
            if len(t) > 1 and t.strip("▁"):
                last = self._merged(t, ids)
                if last is None:
                    dead.append(t)  # merging never makes it
                else:
                    self.left[i], self.right[i] = last
        joins = sorted((ids[t[:k]] * n + ids[t[k:]], i) for t, i in ids.items() if t.strip("▁") for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids)
        self.n, self.join_key, self.join_id = n, np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int64)
        # runs of spaces merge last: their pieces by length, from the left, as merging takes them
        self.runs = {t: i for t, i in ids.items() if not t.strip("▁")}
        self.known = {t for t in ids if len(t) == 1}
        # neighbours that no piece holds are never merged: a word falls apart between them
        self.pairs = {t[k:k + 2] for t in ids for k in range(len(t) - 1)}
        mine = [t for t in ids if t not in set(dead) and (t.strip("▁") or t == "▁")]
        self.longest = max(map(len, mine))
        hashes = np.array([self.hash_of(t) for t in mine], np.uint64)
        by = np.argsort(hashes)
        self.hash, self.hash_id = hashes[by], np.array([ids[t] for t in mine], np.int64)[by]
        self.hash_len = np.array([len(t) for t in mine], np.int64)[by]
        # bytes of each piece, for decoding
        raw = [t.replace("▁", " ").encode("utf-8") if not model.is_control(i) else b"" for i, t in enumerate(texts)]
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode("utf-8")
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def _merged(self, text: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge completes ``text``; None if merging ends otherwise."""
        parts = list(text)
        while len(parts) > 2:
            rank, at = min(((int(self.rank[ids[a + b]]), k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ids and a + b != text),
                           default=(0, None))
            if at is None:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (ids[parts[0]], ids[parts[1]]) if parts[0] in ids and parts[1] in ids else None

    @staticmethod
    def hash_of(text: str) -> np.uint64:
        codes = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(7))
        return (codes * _power(_STEP, "piece on", len(codes))).sum()

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of pieces stand side by side when merging is done: undoing merges
        from the last, no merge across the boundary would have come before the undone one."""
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        before = np.full(len(a), _NEVER, np.int64)  # a merge across must rank below this to come first
        while len(at):
            key = x * self.n + y
            k = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            crossed = (self.join_key[k] == key) & (self.rank[self.join_id[k]] < before)
            ok[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry  # of equal merges the left one came first, so the right one is undone first
            before = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def segment(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Ids of each part, made of known characters, ▁ at most in front."""
        out: list = [None] * len(parts)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            by_length.setdefault(len(p), []).append(i)
        for length, which in by_length.items():
            room = max(1, TOGETHER * 16 // max(length, 16))
            for lo in range(0, len(which), room):
                mine = which[lo:lo + room]
                for i, ids in zip(mine, self._viterbi([parts[i] for i in mine], length)):
                    out[i] = ids
        return out

    def _viterbi(self, parts: list[str], length: int) -> list[tuple[int, ...]]:
        n = len(parts)
        codes = mix(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(7)).reshape(n, length)
        total = np.zeros((n, length + 1), np.uint64)
        np.cumsum(codes * _power(_STEP, "piece on", length), axis=1, out=total[:, 1:])
        back = _power(_BACK, "piece back", length)
        best = np.full((n, length + 1), -1, np.int64)  # piece that ends here: the backpointer
        span = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                h = (total[:, end] - total[:, start]) * back[start]
                k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                hit = np.flatnonzero((self.hash[k] == h) & (self.hash_len[k] == end - start) & (best[:, end] < 0))
                if start:
                    hit = hit[best[hit, start] >= 0]
                if not len(hit):
                    continue
                piece = self.hash_id[k[hit]]
                if start:
                    pair, inverse = np.unique(best[hit, start] * self.n + piece, return_inverse=True)
                    fit = self.compatible(pair // self.n, pair % self.n)[inverse]
                    hit, piece = hit[fit], piece[fit]
                best[hit, end], span[hit, end] = piece, end - start
        if (best[:, 1:] < 0).any():
            raise ValueError("a prefix has no segmentation")
        # walk back, all words together
        at, chain = np.full(n, length), []
        rows = np.arange(n)
        while at.any():
            live = at > 0
            chain.append(np.where(live, best[rows, at], -1))
            at = at - np.where(live, span[rows, at], 0)
        grid = np.stack(chain[::-1], axis=1)
        return [tuple(i for i in row if i >= 0) for row in grid.tolist()]

    def run_of(self, length: int) -> list[int]:
        """Ids of so many spaces: merges of equal rank, leftmost first. What stands to the left
        of a new space can't be merged any further without it, so one pass over a stack does."""
        sizes, stack = {len(t): i for t, i in self.runs.items()}, []
        for _ in range(length):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in sizes:
                last = stack.pop()
                stack[-1] += last
        return [sizes[n] for n in stack]


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self):
        self.seen, self.parts = {}, {}
        self.flat, self.starts, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _split(self, word: str) -> list[str | bytes]:
        """▁ and a word as parts that are segmented apart; characters that no piece has as bytes."""
        known, pairs, out, held = self.pieces.known, self.pieces.pairs, [], "▁"
        for c in word:
            if c not in known:
                if held:
                    out.append(held)
                out.append(c.encode("utf-8"))
                held = ""
            elif held and held[-1] + c not in pairs:
                out.append(held)
                held = c
            else:
                held += c
        if held:
            out.append(held)
        return out

    def _learn(self, units: list[str]):
        """Ids of units: words with the spaces before them but one."""
        p = self.pieces
        words = [u.lstrip(" ") for u in units]
        plans = [self._split(w) for w in words]
        unknown = list({x for plan in plans for x in plan if isinstance(x, str)}.difference(self.parts))
        self.parts.update(zip(unknown, p.segment(unknown)))
        ids, lens = [], []
        for u, w, plan in zip(units, words, plans):
            mine = []
            for x in plan:
                mine += self.parts[x] if isinstance(x, str) else p.byte[list(x)].tolist()
            if spaces := len(u) - len(w):
                mine = p.run_of(spaces + 1) + mine[1:] if mine[0] == p.space else p.run_of(spaces) + mine
            ids += mine
            lens.append(len(mine))
        self.flat = np.concatenate([self.flat, np.array(ids, np.int32)])
        self.starts = np.concatenate([self.starts, self.size + np.cumsum(lens)])
        self.size = len(self.flat)
        self.seen.update(zip(units, range(len(self.seen), len(self.seen) + len(units))))

    @staticmethod
    def units(text: str) -> list[str]:
        """Words, each with the spaces before it except the one that a word has anyway."""
        words = text.replace("▁", " ").split(" ")
        if "" not in words:
            return words
        out, empty = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * empty + w)
                empty = 0
            else:
                empty += 1
        out.append(" " * empty + words[-1])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, lengths)."""
        units, counts = [], []
        for t in texts:
            mine = self.units(t) if t else []
            counts.append(len(mine))
            units += mine
        if len(self.seen) > REMEMBERED:
            self._forget()
        unknown = list(set(units).difference(self.seen))
        if unknown:
            self._learn(unknown)
        codes = np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))
        lens = self.starts[codes + 1] - self.starts[codes]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(int(upto[-1])) + np.repeat(self.starts[codes] - upto[:-1], lens)]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of lists of ids; the space that encoding put in front is taken off."""
        p = self.pieces
        lens = p.raw_at[ids + 1] - p.raw_at[ids]
        upto = np.concatenate([[0], np.cumsum(lens)])
        data = p.raw[np.arange(int(upto[-1])) + np.repeat(p.raw_at[ids] - upto[:-1], lens)].tobytes()
        at = upto[offs].tolist()
        out = []
        for a, b in zip(at[:-1], at[1:]):
            out.append(data[a + (data[a:a + 1] == b" "):b].decode("utf-8", "replace"))
        return out


_encoders: dict = {}


def _encoder(pieces) -> Encoder:
    """One per worker and vocabulary; its words are forgotten at a task's end."""
    key = pieces.value.path
    if key not in _encoders:
        _encoders[key] = Encoder(pieces.value)
    return _encoders[key]


def _encode(pieces):
    def run(batches):
        model = _encoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, STRIDE):
                part = batch.slice(at, STRIDE)
                ids, lens = model.encode(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], list_array(pa.array(ids, pa.int32()), np.concatenate([[0], np.cumsum(lens)]))],
                                                 [*part.schema.names[:-1], "ids"])

        model._forget()
        tidy()

    return run


def _decode(pieces):
    def run(batches):
        model = _encoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, STRIDE):
                part = batch.slice(at, STRIDE)
                lists = part.column(part.num_columns - 1)
                if lists.null_count:
                    lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
                offs = lists.offsets.to_numpy().astype(np.int64)
                texts = model.decode(lists.flatten().to_numpy().astype(np.int64), offs - offs[0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return run


def chained(*steps):
    """Steps over batches as one."""
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def load_pieces(spark: SparkSession, path: str):
    """The vocabulary at every executor: its size is that of the vocabulary, not of the texts."""
    return spark.sparkContext.broadcast(Pieces(path))


def encode(docs: DataFrame, pieces, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids, array<int>, as the library's ``encode`` gives them.

    Null and empty texts have no ids. U+2581 in a text is a space. Characters that no
    piece holds become byte pieces. Rows are encoded apart, repeated ones too; no rows
    give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    slim = docs.select(*keep, filled(text).alias("_text"))
    shape = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(_encode(pieces), f"{shape}, ids array<int>")


def decode(tokens: DataFrame, pieces, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ids and text: pieces joined, ▁ as space, without the space that
    encoding puts in front; bytes that are no UTF-8 become U+FFFD. Null or no ids give an empty text."""
    slim = tokens.select(*keep, F.col(ids).alias("ids"))
    shape = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(_decode(pieces), f"{shape}, ids array<int>, text string")


def _crc(batches):
    for batch in batches:
        lists = batch.column(2)
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        texts, at = text_buffers(batch.column(3))
        view, cut = memoryview(texts), at.tolist()
        back = [zlib.crc32(view[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(back, pa.int64()),
                                          pa.array(np.array(back) == np.array(batch.column(1)))],
                                         ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = load_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", filled().alias("text")).withColumn("crc", F.crc32(F.encode(F.regexp_replace("text", "▁", " "), "UTF-8")).cast("long"))
    # encoding, decoding and digests in one Python worker a task
    return docs.select("doc_id", "crc", "text").mapInArrow(chained(_encode(pieces), _decode(pieces), _crc),
                                                           "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
