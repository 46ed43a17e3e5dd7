"""Operator 8, token ids as flat binary files.

Documents are dealt by range of doc_id. Each task encodes its documents with the
tokenizers library and writes three flat files as it goes: token ids (unsigned 16
or 32 bit), document lengths and doc_ids. The prefix sums of the partitions' token
counts are their bases; with them a second pass writes 64-bit document offsets
into the whole corpus. Readers memory-map the files.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, fresh_path
from .common import filled, query, ship, table, tidy
from .files import mapped, new_name, opened
from .words import text_buffers

#: Distinct words whose ids a worker remembers before it starts anew, and bytes of text encoded at a time.
REMEMBERED, STRIDE = 500_000, 4 << 20
NO_ID = -(1 << 63)
#: Marks that end words often; none is part of a contraction, letter, digit or special token with letters.
MARKS = ",.!?;:%$&*#|"

MANIFEST = "part int, first long, file string, n_docs long, n_tokens long, width int"


class WordEncoder:
    """Encodes texts word by word: the vocabulary's normaliser and splitter never look
    across ASCII white space, so a text's ids are those of its words in order."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.word_end = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(self.model.get_vocab_size(with_added_tokens=True))])
        self._forget()

    def _forget(self):
        # words: place by word, ids from starts[place] to starts[place + 1]; pieces likewise
        self.seen, self.flat, self.starts, self.size = {}, np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0
        self.pieces, self.piece_ids, self.piece_starts = {"": 0}, np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _learn_pieces(self, pieces: set[str]):
        """Letters-only pieces are encoded together, joined by spaces: each ends with the
        one id of its that carries the end-of-word mark."""
        unknown = list(pieces.difference(self.pieces))
        plain = [p for p in unknown if p.isalpha() and p.lower().isalpha()]
        got = self.model.encode_batch_fast([" ".join(plain[i:i + 256]) for i in range(0, len(plain), 256)], add_special_tokens=False)
        flat = np.fromiter(itertools.chain.from_iterable(e.ids for e in got), np.uint32)
        ends = np.flatnonzero(self.word_end[flat]) + 1
        if len(ends) != len(plain):
            raise ValueError("the vocabulary does not end each word with an end-of-word id")
        known = set(plain)
        other = [p for p in unknown if p not in known]
        more = [e.ids for e in self.model.encode_batch_fast(other, add_special_tokens=False)]
        lens = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, more), np.int64, len(more))])
        at = len(self.pieces)
        self.pieces.update(zip(plain + other, range(at, at + len(unknown))))
        self.piece_ids = np.concatenate([self.piece_ids, flat, np.fromiter(itertools.chain.from_iterable(more), np.uint32)])
        self.piece_starts = np.concatenate([self.piece_starts, self.piece_starts[-1] + np.cumsum(lens)])

    def _learn(self, words: set[bytes]):
        """A word is one piece, or letters and a tail of marks, which are split anyway. ASCII
        letters are lower-cased anyway."""
        words = list(words)
        texts = b"\n".join(words).decode("utf-8").split("\n")
        cores = [t.rstrip(MARKS) for t in texts]
        split = [c.isalpha() for c in cores]
        first = [(c.lower() if c.isascii() else c) if ok else t for t, c, ok in zip(texts, cores, split)]
        tails = [t[len(c):] if ok else "" for t, c, ok in zip(texts, cores, split)]
        self._learn_pieces(set(first).union(tails))
        parts = np.empty((len(words), 2), np.int64)
        for at, own in enumerate((first, tails)):
            parts[:, at] = np.fromiter(map(self.pieces.__getitem__, own), np.int64, len(own))
        parts = parts.ravel()
        lens = self.piece_starts[parts + 1] - self.piece_starts[parts]
        upto = np.cumsum(lens)
        more = self.piece_ids[np.arange(int(upto[-1])) + np.repeat(self.piece_starts[parts] - upto + lens, lens)]
        if self.size + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.size], more, np.zeros(self.size + len(more), np.uint32)])
        else:
            self.flat[self.size:self.size + len(more)] = more
        self.starts = np.concatenate([self.starts, self.size + upto[1::2]])
        self.size += len(more)
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words))))

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, lengths)."""
        view, words, counts = memoryview(data), [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            mine = bytes(view[a:b]).split()
            counts.append(len(mine))
            words += mine
        if len(self.seen) > REMEMBERED:
            self._forget()
        unknown = set(words).difference(self.seen)
        if unknown:
            self._learn(unknown)
        codes = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(counts)
        lens = self.starts[codes + 1] - self.starts[codes]
        upto = np.concatenate([[0], np.cumsum(lens)])
        per_text = np.diff(np.concatenate([[0], upto[ends]])) + 1
        # a word's ids go behind those of the words before it and one end id per earlier text
        texts_before = np.repeat(np.arange(len(counts)), counts)
        out = np.full(int(upto[-1]) + len(counts), end, np.uint32)
        place = np.arange(int(upto[-1])) + np.repeat(texts_before, lens)
        out[place] = self.flat[np.arange(int(upto[-1])) + np.repeat(self.starts[codes] - upto[:-1], lens)]
        return out, per_text


_encoders: dict[str, WordEncoder] = {}


def _write(folder: str, vocabulary: str, end: int):
    def run(batches):
        model = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, WordEncoder(vocabulary))
        name, where = new_name("tokens"), None
        first, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if where is None:
                where, path = opened(folder)
                where.create_dir(path, recursive=True)
                ids_file, len_file, doc_file = (where.open_output_stream(f"{path}/{name}.{x}") for x in ("ids", "lengths", "docs"))
            doc_ids = np.array(batch.column(0).fill_null(NO_ID))
            first = int(doc_ids[0]) if first is None else first
            doc_file.write(doc_ids.astype("<i8").tobytes())
            data, offs = text_buffers(batch.column(1))
            at = 0
            while at < len(doc_ids):
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + STRIDE, "right")) - 1)
                ids, lens = model.encode(data[offs[at]:offs[to]], offs[at:to + 1] - offs[at], end)
                ids_file.write(ids.astype(f"<u{model.width}").tobytes())
                len_file.write(lens.astype("<u8").tobytes())
                n_tokens += len(ids)
                at = to
            n_docs += len(doc_ids)
        if len(model.seen) > REMEMBERED // 2:  # else the worker's next task may use them
            model._forget()
        tidy()
        if where is not None:
            for f in (ids_file, len_file, doc_file):
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "file": name, "n_docs": n_docs,
                                               "n_tokens": n_tokens, "width": model.width}],
                                             pa.schema([("part", pa.int32()), ("first", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()),
                                                        ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return run


def _write_offsets(folder: str):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                where, path = opened(folder)
                lens = np.frombuffer(mapped(f"{folder}/{row['file']}.lengths").read(), "<u8")
                name = new_name("offsets")
                with where.open_output_stream(f"{path}/{name}") as f:
                    f.write((row["base"] + np.concatenate([[0], np.cumsum(lens)])).astype("<u8").tobytes())
                row["offsets"] = name
                yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("base", pa.int64()), ("n_docs", pa.int64()), ("width", pa.int32()), ("offsets", pa.string())]))

    return run


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns their manifest, one row per partition in doc_id
    order: file, base (tokens before it), n_docs, width (bytes of an id), offsets.

    Null text counts as empty: its ids are the end id alone. Null doc_ids come first
    and are stored as the least 64-bit integer; rows that share a doc_id are ordered
    by a hash of the text, then by the text. No rows give no files and an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    parts = cut_lineage(dealt.mapInArrow(_write(folder, vocabulary, end), MANIFEST)).collect()  # a row per partition
    base, plan = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):
        plan.append((r["file"], base, r["n_docs"], r["width"]))
        base += r["n_tokens"]
    shape = "file string, base long, n_docs long, width int"
    manifest = spark.createDataFrame(plan, shape)
    if plan:
        manifest = manifest.repartition(len(plan))
    return cut_lineage(manifest.mapInArrow(_write_offsets(folder), f"{shape}, offsets string"))


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offs, names = (mapped(f"{folder}/{x}") for x in (f"{row['file']}.ids", row["offsets"], f"{row['file']}.docs"))
                for at in range(0, row["n_docs"], 1 << 16):  # so many documents at a time
                    n = min(1 << 16, row["n_docs"] - at)
                    offs.seek(8 * at)
                    o = np.frombuffer(offs.read(8 * (n + 1)), "<u8").astype(np.int64)
                    names.seek(8 * at)
                    doc = np.frombuffer(names.read(8 * n), "<i8")
                    crc = []
                    for a, b in zip((o[:-1] - row["base"]).tolist(), (o[1:] - row["base"]).tolist()):
                        ids.seek(row["width"] * a)
                        crc.append(zlib.crc32(np.frombuffer(ids.read(row["width"] * (b - a)), f"<u{row['width']}").astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return manifest.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end=2), folder)
