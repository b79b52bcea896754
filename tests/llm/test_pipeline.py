import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lumigraph.llm import toxicity

from .test_models import corpus
from .test_near import brute


def test_pipeline_against_plain_stages(spark, make_docs, tmp_path):
    rows, labels = corpus(240, seed=3)
    item = " ".join(f"bench{k}" for k in range(20))
    rows += [(500 + k, f"leading words {item} and more {k}") for k in range(4)]
    rows += [(600 + k, rows[k][1] + (" tail" if k % 2 else "")) for k in range(20)] + [(700, None), (701, "")]
    docs = make_docs([(i, t, f"s{i % 4}") for i, t in rows])
    for name, table in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id bigint, toxic int")), ("benchmark", spark.createDataFrame([(1, item)], "item_id bigint, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), [docs]
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/out-{name}"))
    plain = [[(r.doc_id, r.text) for r in s.collect()] for s in seen[:-1]]
    assert all(s.columns == docs.columns for s in seen[:-1])
    model = toxicity.train(*[f([r for r in plain[0] if r[0] in dict(labels) and zlib.crc32(str(r[0]).encode()) % 5]) for f in (lambda x: [t or "" for _, t in sorted(x, key=lambda r: str(r[0]))], lambda x: np.array([dict(labels)[i] == 1 for i, _ in sorted(x, key=lambda r: str(r[0]))]))])
    bad = {i for (i, t), s in zip(plain[0], model.scores([t or "" for _, t in plain[0]]), strict=True) if s >= 0.5}
    assert {i for i, _ in plain[1]} == {i for i, _ in plain[0]} - bad and bad
    want = brute(plain[1], 5)
    assert {i for i, _ in plain[2]} == {i for i, (_, _, kept) in want.items() if kept}
    assert {i for i, _ in plain[3]} == {i for i, _ in plain[2]} - {500, 501, 502, 503}
    copies = {i: sum(k == i for k, _ in plain[4]) for i, _ in plain[3]}
    assert max(copies.values()) <= 3 and abs(sum(len((t or "").split()) for _, t in plain[4]) - sum(len((t or "").split()) for _, t in plain[3])) < 400
    encode, at, expect = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(plain[4]):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, seen[-1].select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(expect)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == got


def test_pipeline_on_odd_rows_and_empty_tables(spark, make_docs, tmp_path):
    """Null ids and texts, repeated ids and rows, clashing columns; then no rows at all."""
    item, text = " ".join(f"bench{k}" for k in range(20)), " ".join(f"word{k}" for k in range(40))
    rows = [(None, item), (None, text), (1, text), (1, text), (2, text), (3, f"some {item} here"), (3, "a clean text of the same id"), (4, None), (4, None), (5, ""), (6, "one two three four five six")]
    for case, found in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{case}"
        for name, table in (("documents", make_docs(found)), ("labels", spark.createDataFrame([], "doc_id bigint, toxic int")), ("benchmark", spark.createDataFrame([(1, item)] if found else [], "item_id bigint, text string"))):
            table.write.parquet(f"{folder}/{name}.parquet")
        docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            out.write.parquet(f"{folder}/out-{name}")
            docs = spark.read.parquet(f"{folder}/out-{name}")
            seen.append(sorted([(r.doc_id, r.text) for r in docs.collect()] if name != "token_output" else [r.doc_id for r in docs.collect()], key=repr))
        if not found:
            assert seen == [[]] * 5
            continue
        near = [(None, item), (None, text), (1, text), (3, f"some {item} here"), (3, "a clean text of the same id"), (4, None), (5, ""), (6, "one two three four five six")]
        assert seen[0] == sorted(rows, key=repr) and seen[1] == sorted(near, key=repr)
        assert seen[2] == sorted([r for r in near if item not in (r[1] or "")], key=repr)
        assert set(seen[3]) <= set(seen[2]) and seen[4] == sorted([i for i, _ in seen[3]], key=repr)
