import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from voxlake.llm import bpe, decontaminate, simhash, suffix_array, toxicity

from .test_decontaminate import brute

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def D(spark, tmp_path_factory):
    """Small tables: some documents, all labels, some passages."""
    out = str(tmp_path_factory.mktemp("small"))
    for t, some in (("documents", "doc_id < 60"), ("labels", "true"), ("benchmark", "item_id < 20")):
        spark.read.parquet(f"{SOURCE}/{t}.parquet").where(some).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    docs = spark.read.parquet(f"{out}/documents.parquet")
    passage = spark.read.parquet(f"{out}/benchmark.parquet").first().text
    leaks = docs.where("doc_id < 3").selectExpr("doc_id + 1000 as doc_id", f"concat(reverse(text), ' {passage} end') as text", "lang", "source", "n_chars")
    leaks.write.mode("append").parquet(f"{out}/documents.parquet")
    return out


def test_stages_in_order(spark, D):
    """Each stage on its predecessor's rows: what goes, what stays as it was, and the last stage against the library."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_array_dedup", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    labels, bench = spark.read.parquet(f"{D}/labels.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    at = lambda df: {r.doc_id: r for r in df.collect()}

    scores = at(toxicity.toxicity(docs, labels))
    one = stage["toxicity"](spark, docs, D).cache()
    assert one.columns == columns and set(at(one)) == {k for k, r in scores.items() if r.score < 0.5}
    two = stage["simhash_dedup"](spark, one, D).cache()
    groups = simhash.near_duplicates(one).collect()
    assert two.columns == columns and set(at(two)) == {r.component_id for r in groups}
    three = stage["suffix_array_dedup"](spark, two, D).cache()
    removed = at(suffix_array.without_repeats(two))
    before, after = at(two), at(three)
    assert three.columns == columns and set(after) == {k for k in before if not removed[k].n_bytes or removed[k].n_removed < removed[k].n_bytes}
    for k, r in after.items():
        assert (r.lang, r.source, r.n_chars) == (before[k].lang, before[k].source, len(r.text))
        assert r.text == before[k].text if not removed[k].n_removed else len(r.text.encode()) >= removed[k].n_bytes - removed[k].n_removed
        assert r.text.encode() == removed[k].kept or b"\xc3" in before[k].text.encode()
    four = stage["decontaminate"](spark, three, D).cache()
    leaked = {d for d, *_ in brute([(k, r.text) for k, r in after.items()], [(b.item_id, b.text) for b in bench.collect()])}
    assert four.columns == columns and set(at(four)) == set(after) - leaked
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert decontaminate.leaks(four, bench).count() == 0
    five = at(corpus_pipeline.run(spark, D))  # the whole pipeline, its last stage included
    assert {k: r.decoded for k, r in five.items()} == {k: r.text for k, r in at(four).items()} and five
    assert all(r.tokens == library.encode_ordinary(r.decoded) and r.n_tokens == len(r.tokens) for r in five.values())
