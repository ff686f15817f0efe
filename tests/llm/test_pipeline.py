"""The corpus pipeline against a plain Python version of each stage, on the smallest tables."""

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from loomgraph.llm import bpe
from loomgraph.llm.shared import keep, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, columns = [n for n, _ in pipeline.STAGES], docs.columns
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(keep(stage(spark, tables[-1], sf), f"test-{name}"))
    clean, single, apart, mixed, coded = ([r.asDict() for r in t.collect()] for t in tables[1:])
    assert all(t.columns == columns for t in tables[:-1])
    everything = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"] for r in clean} <= set(everything)

    best = {}
    for r in clean:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in single) == sorted(i for _, i in best.values())

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = sorted((r["doc_id"], shingles(r["text"])) for r in single)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in apart) == sorted({find(i) for i, _ in rows})

    counts = {}
    for r in mixed:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= {r["doc_id"] for r in apart} and max(counts.values()) <= 2
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, longest = sum(words(r["text"]) for r in apart), max(words(r["text"]) for r in apart)
    assert abs(sum(words(r["text"]) for r in mixed) - 1.5 * total) <= longest * len({r["source"] for r in apart})

    ranks = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(coded) == len(mixed)
    for r in coded:
        ids = library.encode_ordinary(everything[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_gives_the_last_stage(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
