"""The pipeline against a brute-force version of its stages over a small table."""

import hashlib
import os

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from taskledger.llm import mixing, secrets, toxicity
from taskledger.llm.common import table

from .test_secrets import base, entropy
from .test_simhash_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_run_is_the_composition_of_its_stages(spark):
    docs = table(spark, SF, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, SF, "labels")).matcher()
    rows = [r for r in docs.collect() if lexicon.score(r.text or "") < 0.5]
    values = {r.doc_id: brute_fingerprint(r.text or "", 3) for r in rows}
    roots = brute_components(values.values(), 3)
    first = {}
    for i in sorted(values):
        first.setdefault(roots[values[i]], i)
    kept = []
    for r in rows:
        if r.doc_id in first.values():
            out, at = "", 0
            for s, _, e in sorted(base(r.text or "") + entropy(r.text or "")):
                if s >= at:
                    out += r.text[at:s] + secrets.MASK
                at = max(at, e)
            kept.append((r.doc_id, (r.text or "")[:0] + out + (r.text or "")[at:], r.lang, r.source, r.n_chars))
    mixed = mixing.mixed_documents(spark.createDataFrame(kept, docs.schema)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(want) and len(got) > 100


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).dtypes == docs.dtypes, name


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and os.path.exists(corpus_pipeline.__file__)
