import random
from pathlib import Path

import pytest
import test_decontaminate
import test_ngram_join
import test_quality_rules

import __spark_entry__ as entry
import corpus_pipeline
from tallyforge.llm import secret_scan as ss
from tallyforge.llm.queries import PIECES, QUERIES, SQL

pytestmark = pytest.mark.skipif(not Path(PIECES).exists(), reason="vocabulary files are not here")


def documents():
    rng = random.Random(6)
    word = lambda d: f"{rng.choice('abcdefgh')}{rng.choice('rstuv')}w{d}x{rng.randrange(400)}"
    items = [(i, " ".join(f"item{i}k{j}" for j in range(14 + i))) for i in range(5)]
    docs = []
    for d in range(40):
        w = [word(d) for _ in range(rng.randrange(20, 120))]
        if d % 7 == 0:
            w[5:5] = items[d % 5][1].split()
        if d % 5 == 0:
            w.append(f'token="s3cret{d:04d}value"')
        docs.append((d, " ".join(w), "en", f"src{d % 3}", 0))
    for d in range(40, 52):  # near copies
        w = docs[d - 39][1].split()
        w[len(w) // 2] = f"changed{d}"
        docs.append((d, " ".join(w), "de", "src9", 0))
    docs += [(60, None, None, None, None), (61, "", "en", "src0", 0), (62, docs[3][1], "en", "src1", 0), (3, docs[3][1], "en", "src1", 0),
             (None, docs[9][1] + " more", "en", "src1", 0), (63, "a b c " * 40, "en", "src0", 5)]
    return docs, items


def redacted(rows):
    """Values of assignments and hex strings held by fewer owners than a copied example has."""
    import re

    def spans(t):
        m = [(x.start(2), x.end(2), x[2]) for x in re.finditer(ss.KINDS[0][1], t) if len(x[2]) >= 6]
        return m

    owners = {}
    for _, t, _, s, _ in rows:
        for *_, v in spans(t):
            owners.setdefault(v, set()).add(s)
    out = []
    for d, t, lang, s, _ in rows:
        for a, b, v in reversed(spans(t)):
            if len(owners[v]) < ss.COPIED_OWNERS:
                t = t[:a] + ss.PLACEHOLDER + t[b:]
        out.append((d, t, lang, s))
    return out


def test_against_brute_force(spark, tmp_path):
    import sentencepiece

    docs, items = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in docs if test_quality_rules.brute(r[1])[-1] == 0]
    named = [r for r in kept if r[0] is not None]
    least = {d: c for d, _, c in test_ngram_join.brute([r[:2] for r in named], 5, 80)}
    kept = list({r[0]: r for r in sorted(named, key=str, reverse=True) if least[r[0]] == r[0]}.values()) + [r for r in kept if r[0] is None]
    leaked = {d for d, _ in test_decontaminate.brute([r[:2] for r in kept], items)}
    kept = [r for r in kept if r[0] not in leaked]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((d, lang, s, lib.encode(t, add_eos=True)) for d, t, lang, s in redacted(kept)), key=str)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.lang, r.source, list(r.ids)) for r in got.collect()), key=str) == want
    assert 10 < len(want) < len(docs) - 20


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).dtypes == df.dtypes
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert {f"op{i}" for i in range(1, 14)} <= names and set(SQL) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
