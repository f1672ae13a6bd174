"""The pipeline's stages, each against brute force on what its predecessor kept."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_text import PATH, fingerprint, grouped, repeats
from tokenizers import Tokenizer

import corpus_pipeline as C
from gneiss.llm.common import shared_folder

KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string"
#: Names that the stages, or the operators in them, have for columns of their own.
OWN = "_nth _id _copy _text _words _whole _n _size _taken _toxicity _dedup_kept row nth toxicity dedup_kept dedup_n_removed said id n of words copy part all size taken target key bucket block own root first component_id fp score given c0 w0 n_words n_tokens".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(8)
    words = [f"{a}{b}" for a in "tion ed the re st ing an er".split() for b in "an er the st ou le ly is on at".split()]
    passage = [r.choice(words) for _ in range(40)]
    rows, labels = [], []
    for i in range(220):
        ws = [r.choice(words) for _ in range(r.randint(5, 90))]
        if i % 6 == 0:
            ws = ws + ["grobnik", "vlasquat", "grobnik"]
        elif i % 6 == 1:
            ws[3:3] = passage
        elif i % 6 == 2 and i > 10:
            ws = rows[i - 6][1].split()
        rows.append((i, " ".join(ws), "en", f"src{i % 3}", 0, "x"))
        if i % 3:
            labels.append((i, 0))
        elif i % 6 == 0:
            labels.append((i, 1))
    rows += [(500, None, None, None, None, "x"), (501, "", "en", "src0", 0, "x"), (None, "no id but words enough to be told apart", "en", None, 1, "x"), (3, rows[3][1], "en", "src0", 0, "x")]
    rows = [(i, t, lang, s, None if t is None else len(t), x) for i, t, lang, s, _, x in rows]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_in_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        nxt = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            assert nxt.columns == docs.columns
        docs = nxt
        seen.append(docs.collect())
    raw, clean, single, cut, mixed, tokens = seen

    assert not [r for r in clean if "grobnik" in (r["text"] or "")]
    assert len(clean) == len([r for r in raw if "grobnik" not in (r["text"] or "")])

    groups = grouped([fingerprint(r["text"]) for r in clean])
    least = {}
    for r, g in zip(clean, groups, strict=True):
        least[g] = min(x for x in (least.get(g), r["doc_id"], 1 << 62) if x is not None)
    kept = {r["doc_id"] for r, g in zip(clean, groups, strict=True) if r["doc_id"] is None or least[g] == r["doc_id"]}
    assert {r["doc_id"] for r in single} == kept and len(single) == len(kept)

    want = {i if i != 1 << 62 else None: (n, gone) for i, n, gone, _ in repeats([(r["doc_id"], r["text"]) for r in single])}
    before = {r["doc_id"]: r["text"] for r in single}
    assert len(cut) == len(single) and any(gone for _, gone in want.values())
    for r in cut:
        n, gone = want[r["doc_id"]]
        assert len((r["text"] or "").split()) == n - gone
        assert gone or r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))

    after = {r["doc_id"]: r["text"] for r in cut}
    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and all(r["text"] == after[r["doc_id"]] or after[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in mixed)
    words = sum(len((t or "").split()) for t in after.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - words) <= 0.05 * words

    t = Tokenizer.from_file(PATH)
    coded = Counter(np.array(t.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes() for r in mixed)
    assert Counter(bytes(r["ids"]) for r in tokens) == coded


def test_run_gives_the_last_stage(spark, sf_dir):
    got = C.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(str(r) for r in got.collect()) == sorted(str(r) for r in docs.collect())
    assert not [p for p in Path(shared_folder(spark).removeprefix("file:")).glob("pipeline-*/[0-3]*")]


def test_columns_of_any_name_pass_through(spark, sf_dir):
    from pyspark.sql import functions as F

    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0 or doc_id is null or doc_id >= 500").drop("kept")
    told = F.concat_ws("|", "doc_id", "source", "lang")
    docs, bare = plain.select("*", *(F.concat(F.lit(f"{c} of "), told).alias(c) for c in OWN)), plain
    for _, stage in C.STAGES[:-1]:
        docs, bare = (stage(spark, x, sf_dir) for x in (docs, bare))
        assert docs.columns == [*plain.columns, *OWN]
        rows = docs.collect()
        assert rows and sorted(str(r[:5]) for r in rows) == sorted(str(tuple(r)) for r in bare.collect())
        for r in rows:
            said = "|".join(str(x) for x in (r["doc_id"], r["source"], r["lang"]) if x is not None)
            assert all(r[c] == f"{c} of {said}" for c in OWN)


def test_of_a_group_one_row_stays(spark, sf_dir):
    same = " ".join(f"w{i}" for i in range(60))
    near = same.replace("w30", "other")
    rows = [(None, same, "en", "a", 1), (None, same, "en", "b", 1), (9, near, "en", "a", 1), (7, same, "en", "a", 1), (7, near, "en", "a", 1), (7, same, "de", "a", 1), (None, "alone and apart from all others", "en", "a", 1), (None, "", "en", "a", 0), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.near_copies_out(spark, docs, sf_dir).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in got) == [("7", same[:5]), ("None", ""), ("None", "alone")]


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
