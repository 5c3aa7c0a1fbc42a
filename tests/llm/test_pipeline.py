"""The pipeline on a small folder against brute force, and the registered names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from faultsieve.llm import quality_gam as G  # noqa: E402
from faultsieve.llm import queries as Q  # noqa: E402

from .test_duplicates import brute_lines, brute_similar  # noqa: E402
from .test_mix import brute_targets  # noqa: E402
from .test_models import junk, prose  # noqa: E402


def test_ten_operators_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "tokens"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    random.seed(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for i in range(150):
        lines = [" ".join(random.choices(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi"], k=random.randint(8, 30))).capitalize() + "." for _ in range(4)]
        if i % 10 == 0:
            lines.insert(2, passage)
        texts[i] = "\n".join(lines) if i % 5 else junk(60)
    texts |= {150: texts[1], 151: texts[1], 152: None, 153: "", 154: texts[6].replace(".", ". ", 1)}
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = G.train(docs, labels)
    kept = {i: t for i, t in texts.items() if model.score(np.array([G.features(t)]))[0] >= 0.5}
    assert {i for i in range(150) if i % 5 == 0}.isdisjoint(kept) and {i for i in range(150) if i % 5} <= set(kept)
    kept = brute_lines({i: t or "" for i, t in kept.items()})
    component, _ = brute_similar(kept)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    source, size = {r[0]: r[3] for r in rows}, {i: len(t.encode().split()) for i, t in kept.items()}
    by = defaultdict(int)
    for i in kept:
        by[source[i]] += size[i]
    names = sorted(s for s in by if s is not None) + [None]
    target = dict(zip(names, brute_targets([by[s] for s in names])))
    count = Counter(r.doc_id for r in got)
    assert set(count) <= {i for i in kept if size[i]} and max(count.values()) <= 3
    for s in names:
        own = [i for i in kept if source[i] == s]
        assert abs(sum(count[i] * size[i] for i in own) - target[s]) <= max(size[i] for i in own)
    library = sentencepiece.SentencePieceProcessor(model_file=Q.model_path())
    for r in got:
        ids = library.encode(kept[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
