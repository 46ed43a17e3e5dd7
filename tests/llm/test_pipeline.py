"""Each stage of the pipeline against a brute-force version, on what its predecessor kept."""

import collections
import random
import sys
from pathlib import Path

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from caseledger.llm import mixing, toxicity  # noqa: E402
from test_operators import WORD, brute_components, rows_of, target_sizes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for r in rows_of(100, 5):
        if r[0] is not None:
            text = f"{r[1]} what an idiot" if r[0] % 9 == 0 else r[1]
            rows.append((r[0], text, r[2], r[3], len(text or "")))
    rows += [(2000 + i, " ".join(rng.choice(["clean", "plain", "quiet", "idiot"][:4 if i % 5 == 0 else 3]) + str(rng.randrange(40)) * (i % 5 != 0) for _ in range(20)), "en", "s2", 0) for i in range(60)]
    rows = list({r[0]: r for r in rows}.values())
    labels = [(r[0], 0, int("idiot" in (r[1] or ""))) for r in rows if r[0] % 2]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, have = docs.columns, [tuple(r) for r in docs.collect()]
    voters, weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places = toxicity._places(voters)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            score = lambda t: 1 / (1 + np.exp(-(weights[-1] + sum(weights[i] for i in toxicity.votes(t or "", *places)))))
            want = [r for r in have if score(r[1]) < 0.3]
            assert not any("idiot" in (r[1] or "").split() for r in want) and len(want) > len(have) / 2
        elif name == "exact_dedup":
            last = {r[1] or "": r for r in sorted(have, key=lambda r: r[0])}
            want = list(last.values())
        elif name == "near_duplicates":
            component = {i: c for (i, _, c) in brute_components(have, 5, 80)}
            want = [r for r in have if component[r[0]] == r[0]]
            assert len(want) < len(have)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            want = [r for r in have for _ in range(copies[r[0]])]
            sizes = collections.Counter()
            for r in have:
                sizes[r[3]] += len(WORD.findall(r[1] or ""))
            taken = collections.Counter()
            for r in got:
                taken[r[3]] += len(WORD.findall(r[1] or ""))
            target = target_sizes(sizes)
            largest = {s: max(len(WORD.findall(r[1] or "")) for r in have if r[3] == s) for s in sizes}
            assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2 + 1) for s in sizes)
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = [(r[0], r[3], model.encode(r[1] or "")) for r in have]
            assert sorted(map(repr, got)) == sorted(map(repr, want))
            return
        assert out.columns == columns and sorted(map(repr, got)) == sorted(map(repr, want)), name
        docs, have = spark.createDataFrame(got, docs.schema), got


def test_run_ends(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "ids"] and out.count() > 0
