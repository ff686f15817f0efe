"""Media, sharding, mixing, HTML, chat and toxicity on small tables and edge cases."""

import hashlib
import html
import io
import json
import math
import random
import re
import tarfile
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F

from loomgraph.llm import bytesets, chat, html_text, media, mixing, sharding, toxicity
from loomgraph.llm.shared import keep, shared_path, table

TEXTS = [None, "", "a", "a ", "é" * 96, "x" * 192, "x" * 193, "long " * 4000]


def test_media_round_trip(spark):
    rows = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(2, "a", "c", 1), (None, "n", "c", 1)], "doc_id long, text string, digest string, n_bytes int")
    folder = shared_path(spark, "media-test")
    index = media.store(rows, folder)
    places = media.addresses(index)
    seen = {r["digest"]: r for r in media.features(places, folder).collect()}
    heads = {r["digest"]: (r["width"], r["height"], r["bits"]) for r in media.metadata(places, folder).collect()}
    got = index.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        data = ("n" if r["id"] is None else TEXTS[r["id"]] or "").encode()
        payload = media.padded(data)
        one = seen[r["digest"]]
        assert r["n_bytes"] == len(data) and len(payload) % 192 == 0 and len(payload) > 0
        assert (one["payload_bytes"], one["payload_sha256"], one["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert heads[r["digest"]] == (192, len(payload) // 192, 8)
    assert len(seen) == len({media.padded((t or "").encode()) for t in TEXTS} | {media.padded(b"n")})
    store, path = fs.FileSystem.from_uri(folder)
    shard = next(f for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".tar"))
    with store.open_input_file(shard.path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        for member in tar.getmembers():
            assert hashlib.sha256(media.from_png(tar.extractfile(member).read())).hexdigest() == member.name[:64]
    assert media.store(rows.limit(0), shared_path(spark, "media-none")).count() == 0


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    rng = random.Random(1)
    keys = [0, -1, 1, 2**63 - 1, *[rng.randrange(-(2**63), 2**63) for _ in range(500)]]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.int64).view(np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_sharding(spark, sf):
    got = sharding.op10_sharding(spark, sf).collect()
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in got)
    assert all(r["grown_shard"] in (r["shard"], 16) and r["shard"] == jump(r["doc_id"], 16) for r in got)
    odd = spark.createDataFrame([(None, "s"), (5, "s"), (5, "s")], "doc_id long, shard string")
    placed = sharding.slots(keep(sharding.assign(odd, "doc_id", 4, 5), "t"), ["doc_id"]).collect()
    assert {r["shard"] for r in placed if r["doc_id"] == 5} == {jump(5, 4)} and all(r["shard"] == jump(r["doc_id"] or 0, 4) for r in placed)
    assert sharding.assign(odd.limit(0), "doc_id", 4).count() == 0


def reshared(sizes, weights, budget):
    """Excess over twice a size is shared again by weight until none is above."""
    target, full, left = [0.0] * len(sizes), set(), budget
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = left * weights[i] / total
        over = [i for i in open_ if target[i] > 2 * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
            full.add(i)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["b", "a", "é", "zz", None]) if i % 3 else "a", " ".join(["w"] * rng.choice([0, 1, 7, 30]))) for i in range(400)]
    rows += [(1, "a", "w w"), (1, "a", "w w"), (None, "only", "w"), (900, "empty", None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, size int, key string")
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, s, t in rows if s == n) for n in names]
    goal = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    by_size = {}
    for r in got:
        taken = sum(d["words"] for d in r["draws"])
        assert taken <= 2 * r["size"] and all(0 <= d["shard"] < 16 for d in r["draws"])
        by_size.setdefault((r["source_size"], r["target"]), 0)
        by_size[(r["source_size"], r["target"])] += taken
    for size, target in zip(sizes, goal, strict=True):
        key = next(k for k in by_size if k[0] == size and abs(k[1] - target) < 1e-6)
        assert abs(by_size[key] - target) <= 1
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.placed(mixed).count() > 0


def key(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_op9_query(spark, sf):
    """The contract's columns by SQL; shards and turns drawn again from the splitting tree in plain Python."""
    got = mixing.op9_mixing(spark, sf).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    twin = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP9_SQL})").fetchall())
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == twin
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    words, target = {}, {}
    for r in got:
        block = (docs[r["doc_id"]]["source"], key(f"7:{r['doc_id']}") >> 48)
        words[block] = words.get(block, 0) + r["size"]
        target[block[0]] = (r["target"], r["source_size"])
    units = {}
    for source, (goal, size) in target.items():
        quota = int(goal + 0.5)
        whole, before = min(2, quota // size), 0
        for b in sorted(b for s, b in words if s == source):
            n = words[(source, b)]
            more = before < quota - whole * size and n > 0
            units.setdefault(source, []).extend((b, p) for p in range(whole + more if n else 0))
            before += n
    names = sorted(units, key=lambda s: ("b" if s is None else "a" + s).encode())
    quotas = mixing.split(np.array([len(units[s]) for s in names]), 16, 7)
    assert (quotas.sum(0) == [len(units[s]) for s in names]).all() and np.ptp(quotas.sum(1)) <= 4
    home = {}
    for i, s in enumerate(names):
        order = sorted(units[s], key=lambda u: (key(f"deal7:{u[0]}:{u[1]}"), u))
        for u, shard in zip(order, np.repeat(np.arange(16), quotas[:, i]), strict=True):
            home[(s, *u)] = int(shard)
    seen = set()
    for r in got:
        s, k = docs[r["doc_id"]]["source"], key(f"7:{r['doc_id']}")
        shards = [int(x) for x in r["shards"].split(",") if x]
        turns = [int(x) for x in r["turns"].split(",") if x]
        assert shards == [home[(s, k >> 48, p)] for p in range(len(shards))]
        assert turns == [key(f"turn7:{k}:{p}") for p in range(len(turns))]
        seen |= set(zip(shards, turns, strict=True))
    assert len(seen) == sum(len(r["turns"].split(",")) for r in got if r["turns"])
    other = {r["doc_id"]: [(d["shard"], d["turn"]) for d in r["draws"]] for r in mixing.mix(table(spark, sf, "documents"), seed=8).collect()}
    mine = {r["doc_id"]: r["shards"] for r in got}
    assert sum(mine[i] != ",".join(str(s) for s, _ in d) for i, d in other.items()) > len(mine) / 2
    order = [((r["shard"], r["turn"] >> 60 - mixing.PIECES), r["turn"]) for r in mixing.placed(mixing.mix(table(spark, sf, "documents"))).collect()]
    pieces = [k for k, _ in groupby(p for p, _ in order)]
    assert len(pieces) == len(set(pieces)) and all(a[1] < b[1] for a, b in zip(order, order[1:], strict=False) if a[0] == b[0])


def test_op5_query(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    got = media.op5_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    one = {}
    for r in got:
        payload = texts[r["doc_id"]] + b" " * (max(1, -(-len(texts[r["doc_id"]]) // 192)) * 192 - len(texts[r["doc_id"]]))
        png = media.to_png(payload)
        lines = np.frombuffer(payload, np.uint8).reshape(-1, 192).astype(int)
        edge = [i * len(lines) // 8 for i in range(9)]
        cells = [[lines[min(edge[i], len(lines) - 1) : max(edge[i + 1], min(edge[i], len(lines) - 1) + 1), 24 * j : 24 * j + 24].sum() / max(edge[i + 1] - edge[i], 1) for j in range(8)] for i in range(8)]
        bits = "".join("1" if c > sum(map(sum, cells)) / 64 else "0" for row in cells for c in row)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and r["feature"] == f"{int(bits, 2):016x}"
        assert (r["digest"], r["length"], r["width"], r["height"], r["bits"]) == (r["payload_sha256"], len(png), 192, len(lines), 8)
        assert one.setdefault(r["digest"], (r["shard"], r["offset"])) == (r["shard"], r["offset"])


def test_splitting_tree_is_exact():
    counts = np.array([1000, 0, 3, 517])
    quotas = mixing.split(counts, 7, 3)
    assert (quotas.sum(0) == counts).all() and (quotas >= 0).all() and np.ptp(quotas.sum(1)) <= 3
    assert (mixing.split(counts, 7, 3) == quotas).all()


PAGE = '<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One<br>two<p>Three &lt;3 <b>bold</b>\n end<aside>side</aside><div id="comments"><p>me too</p></div></article><footer>&copy; x</footer>'


def test_html_structure():
    kept = [t for t, held in html_text.blocks(PAGE) if held == 2]
    assert kept == ["Head & more", "One two", "Three <3 bold end"]
    assert html_text.blocks("") == [] and html_text.blocks("plain &am text") == [("plain &am text", 0)]
    assert html_text.blocks("<p>a<!-- x <p>y --><p>b") == [("a", 0), ("b", 0)]
    page = '<article><h1>Story</h1><div class="social-science">Kept</div><p class="share-price">Also kept</p><div class="share-buttons">Gone</div><div id="ad_slot_2">Gone</div></article><article class="comment">Reader</article>'
    assert [t for t, held in html_text.blocks(page) if held == 2] == ["Story", "Kept", "Also kept"]
    deep = "<div>" * 5000 + "x" + "</div>" * 10
    assert html_text.blocks(deep) == [("x", 0)]


def test_html_differencing(spark):
    rows = [(1, "http://h/a/1", "<div>Site</div><p>Real</p><p>Foot</p>"), (2, "http://h/a/2", "<div>Site</div><p>Other</p><p>Foot</p>"), (3, None, None), (4, "http://[bad", ""), (5, "http://h/b", PAGE), (5, "http://h/b", PAGE)]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "page_id long, url string, html string, text string, row int")
    texts, shared = html_text.extract(df)
    got = sorted((r["id"], r["text"], r["n_chars"]) for r in texts.collect())
    article = "Head & more\nOne two\nThree <3 bold end"
    assert got == [(1, "Real", 4), (2, "Other", 5), (3, "", 0), (4, "", 0), (5, article, len(article)), (5, article, len(article))]
    assert sorted(r["n_shared"] for r in shared.collect())[-2:] == [len(html_text.blocks(PAGE))] * 2
    assert html_text.extract(df.limit(0))[0].count() == 0


def test_html_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    for r in html_text.op4_html(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " "))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_nearest_does_not_depend_on_ranges(spark):
    rows = spark.range(200).select(F.col("id").alias("row"), F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.concat_ws("/", F.lit(""), F.col("id") * 7 % 11, F.col("id") * 5 % 13).alias("path"))
    assert len({tuple(sorted(map(tuple, html_text.nearest(rows, n).collect()))) for n in (1, 5, 64)}) == 1


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        found = html_text.common_lines(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found) and found == sorted(set(found)) and len(found) == lcs(a, b)


TOOLS = '<tools>[{"name":"add","parameters":{"properties":{"a":{"type":"integer"},"m":{"type":["string","null"],"enum":["x"]}},"required":["a"],"additionalProperties":false}}]</tools>'


def test_chat_linking(spark):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "user", 'say "é"\n'),
        (1, 2, "assistant", 'A<tool_call>{"id":"c2","name":"add","arguments":{"m":"x","a":"${c1}"}}</tool_call><tool_call>{"name":"add","id":"c1","arguments":{"z":[1,{"k":null}],"m":"q"}}</tool_call>'),
        (1, 3, "tool", '<tool_response>{"tool_call_id":"c1","content":{"v":4}}</tool_response>'), (1, 4, "tool", '{"id":"c1","content":"second"}'),
        (2, 0, "assistant", '<tool_call>no json</tool_call><tool_call>{"id":"p","depends_on":["q"]}</tool_call><tool_call>{"id":"q","depends_on":["p"]}</tool_call>'),
        (2, 0, "tool", '{"id":"c2","content":1}'), (None, None, None, None), (1, 1, "user", 'say "é"\n'),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, msg int, call string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        parsed = json.loads(r["message"])
        assert r["message"] == json.dumps(parsed, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    calls = json.loads(next(r["message"] for r in got if r["conv"] == 1 and r["turn"] == 2))["tool_calls"]
    assert [(c["id"], c["level"], c["result"], c["errors"]) for c in calls] == [("c1", 0, {"v": 4}, ["enum:m", "missing:a", "unknown:z"]), ("c2", 1, None, [])]
    cyclic = json.loads(next(r["message"] for r in got if r["conv"] == 2 and r["role"] == "assistant"))["tool_calls"]
    assert {(c["id"], c["level"]) for c in cyclic} == {("p", -1), ("q", -1), (None, 0)}
    assert next(r["message"] for r in got if r["conv"] is None) == '{"content":null,"role":null,"tool_calls":[]}'
    assert chat.format_chats(df.limit(0)).count() == 0


def test_op7_query_with_calls(spark, tmp_path):
    """The query itself over a table with calls: each conversation has two that depend on each other, in one direction."""
    rows = []
    for c in range(40):
        rows += [
            (c, 0, "system", '<tools>[{"name":"add","parameters":{"properties":{"a":{"type":["integer","null"]}},"required":["a"]}}]</tools>'),
            (c, 1, "assistant", f'Two<tool_call>{{"id":"y{c}","name":"add","arguments":{{"a":"${{x{c}}}"}}}}</tool_call><tool_call>{{"id":"x{c}","name":"add","arguments":{{"a":{c if c % 2 else chr(34) + "s" + chr(34)}}}}}</tool_call>'),
            (c, 2, "tool", f'<tool_response>{{"tool_call_id":"x{c}","content":{c}}}</tool_response>'),
        ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r for r in chat.op7_chat(spark, str(tmp_path)).collect() if r["role"] == "assistant"]
    assert len(got) == 40 and all((r["n_calls"], r["n_linked"]) == (2, 1) for r in got)
    for r in got:
        c, message = r["conv_id"], json.loads(r["message"])
        assert message["content"] == "Two" and [(x["id"], x["level"], x["result"]) for x in message["tool_calls"]] == [(f"x{c}", 0, c), (f"y{c}", 1, None)]
        assert message["tool_calls"][0]["errors"] == ([] if c % 2 else ["type:a"]) and r["n_invalid"] == 1 - c % 2


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    chain = toxicity.train(docs, labels.where("doc_id % 3 != 0"), toxicity.targets())
    truth = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    got = toxicity.score(docs, chain).join(truth, "id").groupBy("y").agg(F.sum(F.col("toxic").cast("int")).alias("hit"), F.count("*").alias("n")).collect()
    rate = {r["y"]: r["hit"] / r["n"] for r in got}
    assert rate[1] > 0.88 and rate[0] < 0.01


def test_op6_query(spark, sf):
    """Each text scored by itself with the chain, link after link."""
    docs = table(spark, sf, "documents")
    chain = toxicity.train(docs, table(spark, sf, "labels"), toxicity.targets())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    place = {int(c): i for i, c in enumerate(chain.chosen)}
    for i, text in texts.items():
        found, p = set(), []
        for w in re.findall(rb"[a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())):
            for n in (0, *toxicity.PREFIXES):
                if n < len(w):
                    h = xxhash.xxh64_intdigest(w[:n] if n else w, 100 + n if n else 42)
                    found |= {place[h]} if h in place else set()
        for w, d, bias in chain.links:
            p.append(1 / (1 + math.exp(-(sum(w[c] for c in found) + sum(x * y for x, y in zip(p, d, strict=True)) + bias))))
        for name, x, cut in zip(chain.categories, p, chain.thresholds, strict=True):
            assert abs(got[i][f"p_{name}"] - x) < 1e-9 and got[i][name] == (got[i][f"p_{name}"] > cut)


def test_toxicity_folds_do_not_leak(spark):
    """Labels by chance, words of one text and its copies only: outside of its fold nothing tells a text's label."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{chr(97 + i // 5 % 26)}{chr(97 + i // 130)}{chr(97 + k)}" for k in range(20)), rng.random() < 0.5) for i in range(0, 2000)]
    labels = {i // 5: y for i, _, y in rows}  # five copies with one label
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    truth = spark.createDataFrame([(i, 1, int(labels[i // 5])) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, truth, {"toxic": F.col("toxic") == 1})
    share = sum(labels.values()) / len(labels)
    # with nothing to go by, the best cut of F1 takes nearly all rows
    assert chain.thresholds[0] < share + 0.15


def test_toxicity_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(bytesets, "PIECE", 64)
    monkeypatch.setattr(bytesets.spans, "__defaults__", (bytesets._LOWER, 64))
    monkeypatch.setattr(bytesets.pieces, "__defaults__", (64,))
    column = ["kind words here " * 30 + "vile scumbag", "short", "", "x" * 300 + " vile"]
    data, offsets = bytesets.raw(pa.array(column))
    cut = {(a + r, f) for a, _, row, found in toxicity.features(data, offsets, toxicity.word_features) for r, f in zip(row.tolist(), found.tolist(), strict=True)}
    monkeypatch.undo()
    assert cut == {(r, f) for r, f in zip(*(x.tolist() for x in toxicity.word_features(data, offsets)), strict=True)}


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, p_toxic string, toxic string, id int"
    docs = spark.createDataFrame([(i, ("kind words here " if i % 2 else "vile scumbag here ") + f"n{i}", "a", "b", 1) for i in range(60)] + [(100, None, "a", "b", 1), (101, "", "a", "b", 1), (101, "", "a", "b", 1), (None, "vile", "a", "b", 1)], schema)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)] + [(3, None, None), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.targets())
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 64 and all(r["toxic"] == (r["id"] % 2 == 0) for r in got if r["id"] is not None and r["id"] < 60)
    assert toxicity.clean(docs, chain, "toxic").columns == docs.columns
    none = toxicity.train(docs, labels.limit(0), toxicity.targets())
    assert toxicity.clean(docs, none, "toxic").count() == 64
    assert toxicity.score(docs.limit(0), chain).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op7_chat"])
def test_duckdb_twins(spark, sf, name):
    from loomgraph.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, sf)
    twin = con.sql(registry.ORACLES[name])
    columns = sorted(mine.columns)
    assert sorted(twin.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in mine.collect()))) == sorted(map(str, (tuple(r[twin.columns.index(c)] for c in columns) for r in twin.fetchall())))
