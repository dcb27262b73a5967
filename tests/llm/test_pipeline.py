import re

import corpus_pipeline
from casemart.llm import exact_dedup, near_dedup, quality


def test_stages_on_a_small_table(spark, tmp_path, unique):
    docs = unique.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = near_dedup.keep_one(exact_dedup.keep_first(quality.keep_good(docs)))
    assert {r.doc_id for r in got} == {r.doc_id for r in kept.collect()}
    assert all(r.n_tokens > 0 for r in got)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_stages_on_awkward_tables(spark, tmp_path, messy, rows, nothing):
    """Null ids, texts and sources, repeated rows, extra columns; and no rows at all."""
    for name, docs in (("messy", messy), ("nothing", nothing)):
        for n, (stage, f) in enumerate(corpus_pipeline.STAGES):
            docs = f(spark, docs, str(tmp_path))
            if n < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == messy.columns, stage
            docs.write.parquet(f"{tmp_path}/{name}-{n}")
            docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}-{n}")
        got = docs.collect()
        assert bool(got) == (name == "messy")
        if got:
            assert None in {r.doc_id for r in spark.read.parquet(f"{tmp_path}/messy-0").collect()}
            assert all(len(r.ids) == r.n_tokens > 0 for r in got)
            texts = {r[1] for r in rows if r[1]}
            kept = spark.read.parquet(f"{tmp_path}/messy-2").collect()
            assert {r.text for r in kept} <= texts and len({r.text for r in kept}) == len(kept)


def naive(docs):
    """A brute-force version of the first three stages over (id, text) rows."""
    from .test_near_dedup import classes
    from .test_quality import brute

    def good(t):
        n, chars, symbols, dup, repeat = brute(t)
        n_lines = len([x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")])
        shouts = len(re.findall(r"[!?]{2,}", t))
        return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or not 3 * n <= chars <= 15 * n or 10 * dup > 5 * n_lines or 10 * shouts > n)

    left = {}
    for i, t in sorted(docs):
        if good(t or ""):
            left.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    root = classes(list(left.values()))
    return {i for i in root if root[i] == i}


def test_first_stages_against_brute_force(spark, tmp_path, unique):
    docs = unique.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id <> 20 and doc_id <> 21 or doc_id is null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == naive([(r.doc_id, r.text) for r in docs.collect()])
