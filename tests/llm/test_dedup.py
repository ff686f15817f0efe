"""Exact, SimHash and suffix-array deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import bytesets, exact_dedup, simhash, suffix_dedup
from loomgraph.llm.groups import components
from loomgraph.llm.shared import table

SPACE = re.compile(r"[\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, id string, digest int, best string, locator long, uid string, fp string, mark int, bytes int"


def docs(spark, rows):
    """A table whose further columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "f", 3, 4) for i, t in rows], CLASH)


ROWS = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " \t\n"), (None, "zz"), (7, "zz"), (8, "q" * 5000), (8, "q" * 5000), (9, "Ab"), (10, "a b")]


@pytest.mark.parametrize("limit", [0, exact_dedup.HIT_LIMIT])
def test_exact_dedup_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "HIT_LIMIT", limit)
    got = {}
    for r in exact_dedup.dedup(docs(spark, ROWS).repartition(3)).collect():
        got.setdefault(r["id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert got[1] == [(2, 3, False)] and got[3] == [(2, 3, False)] and got[2] == [(2, 3, True)]
    assert got[6] == [(6, 3, True)] and got[4] == [(6, 3, False)]  # most code points
    assert got[7] == [(7, 2, True)] and got[None] == [(7, 2, False)]
    assert sorted(got[8]) == [(8, 2, False), (8, 2, True)]
    assert got[9] == [(9, 1, True)] and got[10] == [(10, 1, True)]


def test_exact_dedup_checks_bytes(spark):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    rows = [(i, f"text {i % 20}") for i in range(100)]
    found = exact_dedup.dedup(docs(spark, rows), digest=weak).collect()
    assert len(found) == 100 and sum(r["kept"] for r in found) == 20 and all(r["group_size"] == 5 and r["keep_id"] == r["id"] % 20 for r in found)


def test_exact_dedup_state_goes_on(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    exact_dedup.dedup(docs(spark, [(1, "a"), (2, "b")]), state=state).collect()
    later = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs(spark, [(3, "a"), (4, "c")]), state=state).collect()}
    assert later == {3: (1, 2, False), 4: (4, 1, True)}


def test_distinct_rows_keep_columns(spark):
    out = exact_dedup.distinct_rows(docs(spark, ROWS))
    assert out.columns == docs(spark, ROWS).columns and out.count() == 6


def fingerprint(text, words):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def roots(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def apart(a, b):
    return bin(a ^ b).count("1")


def test_simhash_groups(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 40])))) for i in range(80)]
    rows += [(i + 100, rows[i % 9][1].upper()) for i in range(20)] + [(200, None), (201, ""), (202, " \n"), (203, "é\x85x " * 9), (203, "é\x85x " * 9)]
    got = [(r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(docs(spark, rows)).collect()]
    prints = {i: fingerprint(t, 3) for i, t in rows}
    ids = sorted(prints)
    lowest = roots([prints[i] for i in ids], lambda a, b: apart(a, b) <= 2)
    expected = {i: ids[r] for i, r in zip(ids, lowest, strict=True)}
    assert sorted(got) == sorted((i, prints[i], expected[i]) for i, _ in rows)


@pytest.mark.parametrize("dense", [2, 48, 10_000])
def test_simhash_links_in_dense_cells(spark, dense):
    rng, values = random.Random(3), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense)).collect()}
    expected = roots([v & (1 << 64) - 1 for v in values], lambda a, b: apart(a, b) <= 2)
    groups = lambda names: sorted(sorted(i for i in range(len(values)) if names[i] == n) for n in set(names))
    assert groups([found.get(v, v) for v in values]) == groups([values[r] for r in expected])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 400]))]
        for k in range(rng.choice([1, 3, 8])):
            text = list(base)
            for _ in range(len(base) // 60 if k else 0):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1001, "")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = roots(sets, alike)
    kept = [r["doc_id"] for r in simhash.distinct_rows(docs(spark, rows)).collect()]
    place = {i: group[n] for n, (i, _) in enumerate(rows)}
    assert len({place[i] for i in kept}) == len(set(group))  # every group keeps one
    assert len(kept) == len(set(group))
    assert simhash.distinct_rows(docs(spark, rows).limit(0)).count() == 0


def test_near_copies_without_ids_and_with_clashing_names(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:-1], f"x{i}"]) for i in range(3)]
    odd = "doc_id long, text string, locator string, locator_gone int, _metadata string, _locator int"
    table = lambda rows: spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], odd)
    for keep_rows in (simhash.distinct_rows, exact_dedup.distinct_rows):
        out = keep_rows(table([(None, t) for t in texts[:1] * 3] + [(4, "other text")]))
        assert out.columns == table([(1, "")]).columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 4]
    assert [r["doc_id"] for r in simhash.distinct_rows(table([(None, t) for t in texts])).collect()] == [None]
    assert [r["doc_id"] for r in simhash.distinct_rows(table([(None, texts[0]), (9, texts[1]), (9, texts[1]), (12, texts[2])])).collect()] == [9]


def near_pairs(pairs, passage, seed):
    """Texts 2i and 2i + 1 of a Jaccard similarity from 0.8 to 0.85; ``passage``: words that all texts share."""
    rng, rows = random.Random(seed), []
    common = [f"p{i}" for i in range(passage)]
    for g in range(pairs):
        while True:
            own = [f"o{g}x{i}" for i in range(rng.randint(60, 200))]
            start, change = rng.randrange(len(own)), (len(own) + passage) // 8
            other = own[:start] + [f"e{g}x{i}" for i in range(rng.randint(0, change))] + own[start + rng.randint(0, change) :]
            a, b = common + own, common + other
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                break
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    return rows


@pytest.mark.parametrize("passage", [0, 150])
def test_recall_of_near_copies(spark, passage):
    """A thousand pairs just above the limit, apart and in one common passage."""
    pairs = 1000
    found = simhash.near_copies(spark.createDataFrame(near_pairs(pairs, passage, 11), "doc_id long, text string")).collect()
    group = {r["id"]: r["group_id"] for r in found}
    hits = sum(group.get(2 * g, -1) == group.get(2 * g + 1, -2) for g in range(pairs))
    print(f"recall at a common passage of {passage} words: {hits / pairs}")
    assert hits >= 0.99 * pairs


def test_cuts_of_long_texts(monkeypatch):
    rng = random.Random(8)
    texts = ["", " ", "one", "w" * 90, " ".join("abcdef"[: rng.randint(1, 6)] for _ in range(200)), "  x " * 40 + "y" * 70 + " z" * 3 + "   ", None, "q w e r t " * 9, "v" * 50 + " " * 90]
    column = pa.array(texts)
    data, offsets = bytesets.raw(column)
    for k in (1, 3, 5):
        whole = [[] for _ in texts]
        for a, _, row, h in bytesets.shingle_hashes(data, offsets, k):
            for r, x in zip(row.tolist(), h.tolist(), strict=True):
                whole[a + r].append(x)
        for limit in (8, 20, 64):
            monkeypatch.setattr(bytesets, "PIECE", limit)
            monkeypatch.setattr(bytesets.spans, "__defaults__", (bytesets._LOWER, limit))
            monkeypatch.setattr(bytesets.pieces, "__defaults__", (limit,))
            cut = [[] for _ in texts]
            for a, _, row, h in bytesets.shingle_hashes(data, offsets, k):
                for r, x in zip(row.tolist(), h.tolist(), strict=True):
                    cut[a + r].append(x)
            assert cut == whole
        monkeypatch.undo()
    assert simhash.prints(column, 3).tolist() == [fingerprint(t, 3) for t in texts]


def test_op3_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    ids = sorted(texts)
    prints = [fingerprint(texts[i], 3) for i in ids]
    lowest = roots(prints, lambda a, b: apart(a, b) <= 2)
    expected = [(i, f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, lowest, strict=True)]
    assert sorted(tuple(r) for r in simhash.op3_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == expected


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        text = np.array([rng.randrange(97, 97 + rng.choice([1, 2, 3, 20])) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))], np.uint8)
        b = text.tobytes()
        assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    text = np.frombuffer(b"abcabcabc" * 20, np.uint8)
    array = suffix_dedup.suffix_array(text, 16)
    assert (suffix_dedup.common_prefixes(text, array, 16) == 16).sum() == len(text) - 16 + 1 - 3
    for _ in range(50):
        text = np.array([rng.randrange(97, 99) for _ in range(rng.choice([2, 9, 40, 200]))], np.uint8)
        b, array = text.tobytes(), suffix_dedup.suffix_array(text)
        want = [0] * len(b)
        for x, y in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            while want[x] < min(20, len(b) - max(x, y)) and b[x + want[x]] == b[y + want[x]]:
                want[x] += 1
        assert suffix_dedup.common_prefixes(text, array, 20).tolist() == want


def test_hot_anchor_is_split():
    """Units of one anchor with one common window: no bucket gets them all."""
    import zstandard

    rng = random.Random(5)
    line = bytes(rng.choices(b"abcdefgh ", k=110))
    texts = [bytes(rng.choices(b"xyz", k=30)) + line + bytes(rng.choices(b"xyz", k=30)) for _ in range(1000)]
    pack = zstandard.ZstdCompressor().compress
    wanted = [[{"anchor": 1, "start": 0, "length": 170, "buckets": 20}]] * 1000
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("buckets", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), pa.array([pack(t) for t in texts], pa.binary()), pa.array(wanted, kind)], names=["rank", "uid", "body", "wanted"])
    rows = [r for out in suffix_dedup._cut(100)(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    sizes = np.bincount([r[1] for r in rows if r[1] >= 0], minlength=20)
    assert sizes.sum() + sum(r[1] < 0 for r in rows) == 71_000 and sizes.max() < 2 * sizes.mean()
    assert sum(r[6] in line for r in rows if r[1] >= 0) == 11  # the common windows go on once


def brute_spans(rows, size=100, spans=None):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(b[p : p + size])
        if spans is not None:
            spans[i] = sum(1 for a, b_ in zip(b"\0" + gone, gone, strict=False) if b_ and not a)
        out[i] = (len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3, 100_000])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdé ") for _ in range(600))
    noise = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(80)))
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "y" * 150), (4, "ab" * 200), (5, "y" * 150)]
    for i in range(6, 90):
        a = rng.randrange(500)
        rows.append((i, noise() + base[a : a + rng.randrange(300)] + noise()))
    found = suffix_dedup.dedup(docs(spark, rows).repartition(5), hot=hot).collect()
    got = {r["id"]: (r["n_bytes"], sum(x["length"] for x in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found}
    assert len(found) == len(rows) and got == brute_spans(rows)
    assert suffix_dedup.dedup(docs(spark, rows).limit(0)).count() == 0


def test_op8_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    spans = {}
    expected = brute_spans(sorted(texts.items()), spans=spans)
    got = {r["doc_id"]: ((r["n_bytes"], r["n_removed"], r["kept_sha256"]), r["n_spans"]) for r in suffix_dedup.op8_suffix_dedup(spark, sf).collect()}
    assert got == {i: (expected[i], spans[i]) for i in texts}


def test_suffix_dedup_repeated_and_null_ids(spark):
    rows = [(1, "k" * 10 + "".join(chr(97 + i % 26) for i in range(130))), (1, "k" * 10 + "".join(chr(97 + i % 26) for i in range(130))), (None, "".join(chr(97 + i % 26) for i in range(130)))]
    found = suffix_dedup.dedup(docs(spark, rows)).collect()
    assert sorted(sum(x["length"] for x in r["spans"]) for r in found if r["id"] == 1)[1] == 140
    assert [sum(x["length"] for x in r["spans"]) for r in found if r["id"] is None] == [130]


def joined(rows, tables=simhash.TABLES):
    """Smallest id by id, of the components of pairs of Jaccard similarity 0.8 that share a sampled fingerprint."""
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    _, keys, _ = simhash.sampled(pa.array([t for _, t in rows]), 5, tables, simhash.SAMPLE)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and ((keys[i] == keys[j]) & (keys[i] != 0)).any():
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def test_near_copies_keep_links_between_heads(spark):
    """Chains A-B-C, A and C with copies of their own: B links the two groups and has the smallest id."""
    rows = []
    for g in range(12):
        word = lambda kind, i: f"{kind}{g}x{i}"  # noqa: B023, E731
        b = [word("b", i) for i in range(104)]
        a, c = [word("a", i) for i in range(10)] + b[10:], b[:-10] + [word("c", i) for i in range(10)]
        rows.append((100 * g, " ".join(b)))
        for k in range(1, 4):
            rows += [(100 * g + k, " ".join([*a[:-1], word("ka", k)])), (100 * g + 10 + k, " ".join([word("kc", k), *c[1:]]))]
    want = joined(rows)
    assert len(set(want.values())) < 15
    kept = simhash.distinct_rows(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_near_copies_in_wide_buckets(spark, monkeypatch):
    """Pairs of similarity 0.8 among texts with one common passage; one table, so no other bucket finds them."""
    passage, rows = [f"p{i}" for i in range(79)], []
    for g in range(100):
        own = [f"o{g}x{i}" for i in range(25)]
        rows += [(2 * g, " ".join(passage + own)), (2 * g + 1, " ".join([*passage, *own[:-10], *(f"e{g}x{i}" for i in range(10))]))]
    _, keys, _ = simhash.sampled(pa.array([t for _, t in rows]), 5, 1, simhash.SAMPLE)
    monkeypatch.setattr(simhash, "HEADS", 2)
    assert np.unique(keys, return_counts=True)[1].max() > 16 * simhash.HEADS
    kept = sorted(r["doc_id"] for r in simhash.distinct_rows(docs(spark, rows), tables=1).collect())
    assert set(kept) <= set(joined(rows, 1).values())
