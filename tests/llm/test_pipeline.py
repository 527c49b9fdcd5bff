"""The pipeline's stages and the native operators' SQL."""

import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from helpers import prose, table
from tallyspark.llm import bpe, decontaminate, language, queries
from tallyspark.llm.frames import fold
from test_models import best_distance
from test_neardup import brute as near_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, odd, tmp_path):
    item = prose(800, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = odd + [(50, prose(801, 60) + " " + item + " " + prose(802, 60)), (51, prose(803, 90)), (None, prose(804, 90)), (None, None)]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        if name != "byte_bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        assert docs.count() <= before.count()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "language_id":
            assert not {4, 5, 6, 14} & set(ids) and {1, 2, 20, 51} <= set(ids)
        if name == "near_dedup":
            assert 1 in ids and not {2, 3} & set(ids) and {7, 51, 50, 10, 21} <= set(ids) and ids.count(20) <= 1
        if name == "decontamination":
            assert 50 not in ids and {1, 51} <= set(ids)
    assert docs.where("not intact").count() == 0 and docs.count() > 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), str(tmp_path)).count() == 0


def by_definition(rows, items, model):
    """What each stage keeps of (id, text) rows of distinct ids and plain ASCII texts, by brute force: after each stage, ids with their texts."""
    kept, out = dict(rows), []
    raw = {i: (t or "").encode() for i, t in kept.items()}
    known = {}
    for i, t in raw.items():
        entropy, chars = model.entropies(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        if chars[0]:
            best = entropy[0].argmin()
            share = 1 / np.exp(-(entropy[0] - entropy[0].min()) / model.temperature).sum()
            known[i] = share / (1 + np.exp(min(50, 20 * (entropy[0][best] / model.usual[best] - language.FAR))))
    kept = {i: t for i, t in kept.items() if known.get(i, 0) >= language.REJECT}
    out.append(dict(kept))
    groups = near_groups(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    out.append(dict(kept))
    seen, cut = set(), {}
    for i in sorted(kept):
        t = kept[i].encode()
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(t[at : at + 100])
        if not len(t) or not gone.all():
            cut[i] = bytes(b for b, g in zip(t, gone) if not g).decode()
    out.append(dict(cut))
    plain = lambda t: re.findall("[a-z0-9]+", t.lower())
    kept = {i: t for i, t in cut.items() if not any(best_distance(plain(x), plain(t)) <= decontaminate.budget(len(plain(x))) for x in items if plain(x))}
    out.append(dict(kept))
    return out


def test_stages_by_definition(spark, tmp_path):
    """Each stage of a run over a small table keeps what brute force keeps: languages, groups of near copies, repeated strings, leaks and ids."""
    draw = random.Random(12)
    letters = {"xx": "abcdef", "yy": "stuvwxyz"}
    text = lambda k, n: " ".join("".join(draw.choice(letters[k]) for _ in range(draw.randrange(2, 8))) for _ in range(n))
    items = [text("xx", 20), text("yy", 12), ""]
    rows = [(i, text(draw.choice(["xx", "yy"]), draw.randrange(20, 90))) for i in range(60)]
    for i in range(60, 80):  # near copies, passages of others, leaks
        words = rows[draw.randrange(60)][1].split()
        words[draw.randrange(len(words))] = "abc"
        rows.append((i, " ".join(words)))
    rows += [(i, text("xx", 30) + " " + rows[draw.randrange(60)][1][:150] + " " + text("xx", 30)) for i in range(80, 90)]
    rows += [(i, text("yy", 30) + " " + " ".join(w if draw.random() > 0.1 else "edit" for w in items[i % 2].split()) + " " + text("yy", 5)) for i in range(90, 98)]
    rows += [(98, ""), (99, None), (100, "123 456"), (101, "qqqq kkkk jjjj pppp " * 12), (102, rows[3][1]), (103, rows[3][1] + " " + rows[3][1])]
    labelled = [(i, t, "xx" if (t or "a").strip()[:1] in letters["xx"] else "yy") for i, t in rows]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, labelled).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    wanted = by_definition(rows, items, model)
    assert len(wanted[0]) > len(wanted[1]) > len(wanted[3]) > 30 and wanted[2] != wanted[1]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: encoding.encode_ordinary(t or "") for i, t in wanted[3].items()}
    for result in (corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        assert {r.doc_id: list(r.ids) for r in result.collect()} == ids


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    names = frame.columns
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_queries_run(spark):
    names = set(queries.QUERIES)
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_minhash_dedup", "op3_substring_dedup", "op6_context_mixing", "op7_suffix_dedup", "op8_spot_fingerprints", "op9_language_id"):
        assert queries.QUERIES[name](spark, FOLDER).count() == docs
