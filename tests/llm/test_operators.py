"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, embed, graph, jaccard, mixing, packing, quality, toxicity, urls, warc, wavelet
from millrace.llm.queries import byte_vocabulary, vocabulary
from millrace.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one",
    "one two three",
    "ONE  two\x0bthree",
    "The quick brown fox jumps over the lazy dog and runs away from here to there today.",
    "the quick brown fox jumps over the lazy dog and runs away from here to there today.",
    "menu | home | about | contact | login",
    "naïve café – “quoted” don't <|endoftext|> 12 İstanbul ßtraße",
    LONG,
    LONG + " end",
    "a b c d e f g h i a b c d e f g h i a b c d e f g h i x y z " * 3,
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    frame = spark.createDataFrame([*pairs, (None, 3), pairs[0]], "src long, dst long")
    got = {r.id: r.component for r in graph.components(frame).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: c for i, c in roots(ids, [p for p in pairs if p[0] != p[1]]).items()}
    assert graph.components(frame.where("src < -1")).count() == 0


def brute_sets(texts, n):
    low = {c: c + 32 for c in range(65, 91)}
    out = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(low))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, words, percent):
    rng = np.random.default_rng(words)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = list(TEXTS)
    for size in (5, 6, 8, 20, 40, 70, 150):
        base = list(rng.choice(vocabulary, size))
        for _ in range(12):
            new = list(base)
            for _ in range(rng.integers(0, max(2, size // 25) + 1)):
                new[rng.integers(0, size)] = str(rng.choice(vocabulary))
            texts.append(" ".join(new[: size - int(rng.integers(0, 2))]))
    sets = brute_sets(texts, words)
    pairs = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = roots(sets, pairs)
    got = {r.doc_id: r for r in jaccard.similar(documents(spark, texts), words, percent).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_jaccard_of_nothing(spark):
    assert jaccard.similar(documents(spark).where("doc_id < 0")).count() == 0
    assert {r.component_id for r in jaccard.similar(documents(spark, [None, "", " "])).collect()} == {0, 1, 2}


def test_prefixes_share_two_shingles():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 4, jaccard.SLOTS).astype(np.uint8)
    for n in (2, 5, 7, 20, 100):
        base = rng.integers(0, 2**63, n + 20).astype(np.uint64)
        for drop in range(n - jaccard.least_shared(n, 85) + 1):
            a, b = np.sort(base[:n]), np.sort(np.concatenate([base[drop:n]]))
            if len(b) * 100 < 85 * n:
                continue
            sizes = (a % np.uint64(50)).astype(np.int64), (b % np.uint64(50)).astype(np.int64)
            p, q = (jaccard.prefix(x, s, sketch, 85) for x, s in zip((a, b), sizes, strict=True))
            assert len(np.intersect1d(p, q)) >= 2


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows, vectors = [], {}
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * (0.02 + 0.09 * (i % 3))
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 1), (404, [], 1)]
    rows += [(405, [0.0] * 16, 1), (406, [float("nan")] * 16, 1), (407, [None] + [1.0] * 15, 1), (408, [1.0] * 8, 0), (409, [2.0] * 8, 0)]
    bad = {402, 403, 404, 405, 406, 407}
    vectors = {i: (np.array(v, float), label) for i, v, label in rows if i not in bad}
    pairs = []
    for (a, (x, k)), (b, (y, m)) in itertools.combinations(vectors.items(), 2):
        if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            pairs.append((a, b))
    degree = Counter(x for p in pairs for x in p)
    want = roots([r[0] for r in rows], pairs)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: r for r in embed.near_duplicates(frame).collect()}
    assert sum(got[i].n_links for i in got) >= 0.99 * sum(degree.values())
    assert all(got[i].n_links <= degree[i] for i in got)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.kept for i, r in got.items()} == {i: want[i] == i for i in want}
    assert embed.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.standard_normal((300, 64)) * 0.02
    y /= np.linalg.norm(y, axis=1)[:, None]
    packed, f, _ = embed.codes(x, 8, 4)
    signs = (np.unpackbits(packed, axis=1) * 2.0 - 1) / 8
    true = (x * y).sum(1)
    estimate = (signs * (y @ embed.rotation(64, 0).T)).sum(1) / f
    assert abs((estimate - true).mean()) < 0.01
    assert (np.abs(estimate - true) <= np.sqrt(1 - true**2) * np.sqrt(1 - f**2) / f + 1e-9).all()


def test_mixing(spark):
    rows = [(i, "abc"[min(i % 7, 2)] if i % 11 else None, i) for i in range(3000)] + [(0, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    got = mixing.mix(frame, {"a": 2.0, "b": 1.0, "c": 1.0, None: 0.5}, block_rows=7).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert len({(r.slot, r.in_block) for r in got}) == len(rows)
    blocks = defaultdict(set)
    for r in got:
        blocks[r.slot].add((r.source, r.block))
    assert set(blocks) == set(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    order = sorted((s, *next(iter(b))) for s, b in blocks.items())
    last = {}
    for _, source, block in order:
        assert block == last.get(source, -1) + 1
        last[source] = block
    assert mixing.mix(frame.where("doc_id < 0")).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    odd = ["", None, "\\", "<s>", "a\\<s>\n</s>", "<\\s>", "[INST", "x" * 50_000, "é\u2028\0"]
    rows = [(c, t, ("user", "assistant", "sys\ntem", None)[t % 4], f"same {t}" if t < 2 else odd[(c + t) % len(odd)]) for c in range(30) for t in range(5)]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said), (None, 0, "user", "x"), (3, 0, "user", "same 0"), (50, None, None, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    blocks = chat.format_trees(frame, byte_vocabulary(), block_tokens=3000)
    got = {r.conv_id: r for r in chat.read_conversations(blocks, byte_vocabulary()).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    nodes = sum(len(r.starts) for r in blocks.collect())
    assert nodes < len(rows)  # shared starts are emitted once
    assert chat.read_conversations(chat.format_trees(frame.where("conv_id = -9"), byte_vocabulary()), byte_vocabulary()).count() == 0


def test_positions_and_attention():
    b = chat.Block(chat.Codec.of(byte_vocabulary()))
    b.add(1, [("user", "hi there you"), ("assistant", "one")])
    b.add(2, [("user", "hi there you"), ("assistant", "two"), ("user", "more")])
    b.add(3, [("user", "hi there you"), ("assistant", "one"), ("user", "é\\</s>")])
    decode = b.codec.decode
    assert decode(b.tokens).count("hi there you") == 1 and len(b.position_ids) == len(b.tokens)
    want = {1: ["hi there you", "one"], 2: ["hi there you", "two", "more"], 3: ["hi there you", "one", "é\\</s>"]}
    for conv, leaf in b.convs:
        seen = [i for s, e in b.nodes[leaf][3] for i in range(s, e)]
        assert [t for _, t in chat.parse(decode([b.tokens[i] for i in seen]))] == want[conv]
        # Along a path, positions count up from 0, whatever lies between in the block.
        assert [b.position_ids[i] for i in seen] == list(range(len(seen)))
    _, start, _, _, loss = b.nodes[1]
    assert decode(b.tokens[loss[0] : loss[1]]) == "one" and loss[0] > start
    assert b.nodes[0][4] is None


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/en": ("", "", None, "allow"),
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://xexample.com/de/a": ("xexample.com", "/de/a", None, "allow"),
        "https://m.example.com/de/a?u=://q": ("m.example.com", "/de/a", "example.com/de/", "block"),
        "http://o.org/fr/#/x": ("o.org", "/fr/", "org/fr/", "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://h/" + "s/" * 5000: ("h", "/" + "s/" * 5000, None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate([*cases, *cases])]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()}
    for i, u, _ in rows:
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == cases[u]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.example/{'ad' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], labels).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(200)}


def test_packing(spark):
    pieces = packing.pack(documents(spark), vocabulary()).collect()
    check_pieces(pieces, {i: expected_ids(t) for i, t in enumerate(TEXTS)})
    assert packing.pack(documents(spark).where("doc_id < 0"), vocabulary()).count() == 0


def expected_ids(text):
    return [*Encoder.of(vocabulary()).whole.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, x in ids.items():
        whole = b"".join(bytes(p.ids) for p in sorted(by_doc[i], key=lambda p: p.start))
        assert whole == np.array(x, "<u4").tobytes() and all(p.doc_tokens == len(x) for p in by_doc[i])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_packing_wastes_little():
    rng = np.random.default_rng(3)
    docs = [(i, bytes(4 * int(n))) for i, n in enumerate(rng.lognormal(6, 1.2, 4000).astype(int) + 1)]
    fill = defaultdict(int)
    for rows in packing.pack_lists(iter(docs), 2048, 0.02):
        for r in rows:
            fill[r[5]] += r[2]
    assert packing.padding(np.array([*fill.values()])) < 0.01 * sum(fill.values())


def test_wavelet_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(documents(spark), path, vocabulary(), 3)
    got = {r.doc_id: r for r in wavelet.read_documents(spark, path).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = expected_ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    every = np.concatenate([np.array(expected_ids(t)) for t in TEXTS])
    assert {r.token_id: r.n for r in wavelet.counts(spark, path, [1, 2, int(every[0]), 1]).collect()} == {i: int((every == i).sum()) for i in {1, 2, int(every[0])}}
    assert sorted(r.position for r in wavelet.occurrences(spark, path, 1).collect()) == np.flatnonzero(every == 1).tolist()
    assert all(r.offset == len(expected_ids(TEXTS[r.doc_id])) - 1 for r in wavelet.occurrences(spark, path, 1).collect())
    some = [0, 1, 77, len(every) - 1, len(every), -1]
    assert {r.position: r.token_id for r in wavelet.tokens_at(spark, path, some).collect()} == {p: int(every[p]) for p in some[:4]}
    same = documents(spark).unionByName(documents(spark).withColumn("doc_id", F.lit(3))).unionByName(documents(spark).withColumn("doc_id", F.lit(None)))
    wavelet.write_shards(same, path + "r", vocabulary(), 5)
    rows = sorted(wavelet.read_documents(spark, path + "r").collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in rows] == [False] * len(TEXTS) + [True] * 2 * len(TEXTS)
    assert [r.doc_id for r in rows[len(TEXTS) :]] == sorted([*range(len(TEXTS)), *[3] * len(TEXTS)])
    assert sum(r.n_tokens for r in rows) == 3 * len(every) and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    wavelet.write_shards(documents(spark).where("doc_id < 0"), path + "0", vocabulary(), 3)
    assert wavelet.read_documents(spark, path + "0").count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n, monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 512)
    monkeypatch.setattr(wavelet, "CHUNKS_KEPT", 5)
    ids = np.random.default_rng(n).integers(0, 9, n).astype(np.uint16) * 7001
    w = wavelet.WaveletMatrix.build(ids)
    assert (w.decode() == ids).all()
    for v in {*ids.tolist(), 5}:
        assert w.occurrences(v) == np.flatnonzero(ids == v).tolist()
        assert w.count(v, n // 3, n // 2) == int((ids[n // 3 : n // 2] == v).sum())
    for i in range(0, n, 97):
        assert w.access(i) == ids[i]


def test_encoder_equals_whole_texts():
    rng = np.random.default_rng(4)
    signs = list("aB'sT \x0b\x85\n<|>endoftext1é\u0301İß· \u00a0ÀÿªΣ")
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(800)] + TEXTS
    ids, offsets = Encoder.of(vocabulary()).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == expected_ids(t)


def test_quality(spark):
    got = {r.doc_id: r for r in quality.judge(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        words = WORD.findall(t)
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert got[0].score == 0.5
    assert quality.judge(documents(spark).where("doc_id < 0")).count() == 0


def test_quality_removes_lines_first(spark):
    prose = "\n".join(f"Line {i}: {' '.join(f'word{i}{j}' for j in range(12))}." for i in range(5))
    junk = "home | about | login | more\n" * 12
    rows = documents(spark, [prose, prose + "\n" + "a | b | c", "\n".join(junk.split("\n")[:1] * 12) + prose[:80], prose.upper()])
    assert [(r.doc_id, r.text) for r in quality.clean(rows).orderBy("doc_id").collect()] == [(0, prose), (1, prose)]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<html><head><title>T &amp; x</title></head><body><p>One<br>two</p><script>x<y</script><!-- c --><a href='q'>three</a></body></html>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, block string")
    out = warc.derive(warc.responses_of(frame))
    got = out.where("warc_type = 'conversion'").orderBy("page_id").collect()
    assert [r.block for r in got] == ["One\ntwo\nthree", "", "", ""]
    assert out.count() == 8 and all(r.refers_to.startswith("<urn:uuid:") for r in got)
    assert got[0].block_digest == "sha1:" + hashlib.sha1(got[0].block.encode()).hexdigest()
    path = str(tmp_path / "warc")
    warc.write_warc(out, path)
    back = warc.read_warc(spark, path + "/*.gz").collect()
    assert Counter((r.record_id, r.payload.decode(), r.http_headers) for r in back) == Counter((r.record_id, r.block, r.source_headers) for r in out.collect())
    assert warc.derive(warc.responses_of(frame.where("page_id < 0"))).count() == 0


def test_warc_reads_responses(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: http://a\r\nContent-Length: %d\r\n\r\n" % len(body)
    (tmp_path / "a.warc").write_bytes((record + body + b"\r\n\r\n") * 3)
    rows = warc.read_warc(spark, str(tmp_path / "a.warc"))
    assert rows.count() == 3 and rows.first().payload == b"<p>x</p>" and rows.first().http_headers.endswith("A: b\r\n")
    assert warc.derive(rows).where("warc_type = 'conversion'").first().block == "x"


def labelled(n=400):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ba", "to", "ri", "lu", "mo") for b in ("na", "ke", "si", "pu", "do", "x")]
    texts, y = [], []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(5, 120)))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["awful", "horrid"])) + str(rng.choice(["", "ness"])))
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    return texts, np.array(y)


def test_toxicity_learns_and_scores(spark):
    texts, y = labelled()
    docs = documents(spark, [*texts, *TEXTS])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(2, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, net).collect()
    assert len(rows) == len(texts) + len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < len(texts) and toxicity.fold_of(r.doc_id) == toxicity.HELD_OUT]
    assert np.mean([(r.score >= 0.5) == y[r.doc_id] for r in held]) > 0.9
    assert toxicity.score(docs.where("doc_id < 0"), net).count() == 0
    # Without both labels there is nothing to learn; without any, no text counts as toxic.
    for some, low in ((labels.where("toxic = 0"), True), (labels.where("toxic = 1"), False), (labels.where("toxic = 7"), True)):
        alike = {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()}
        assert len(alike) == 1 and (alike.pop() < 0.5) == low
    assert toxicity.fit(docs.where("doc_id < 0"), labels).constant < 0.5
    twice = docs.unionByName(docs.limit(40)).unionByName(docs.where("doc_id is null"))
    assert toxicity.fit(twice, labels, most_bytes=20_000).constant is None


def test_toxicity_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.standard_normal((50, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))])
    held = np.array([32, 5, 0, 32])
    rows = np.where(np.arange(32) < held[:, None], rng.integers(0, 50, (4, 32)), 50)
    y, weight = np.array([1.0, 0, 1, 0]), np.ones(4)
    grads = net.gradients(vectors[rows], held, y, weight)

    def loss():
        q = 1 / (1 + np.exp(-net.logits(vectors, rows, held).astype(float)))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for k, g in grads.items():
        flat, j = net.p[k].reshape(-1), int(np.abs(g).argmax())
        old = flat[j]
        flat[j] = old + 1e-2
        high = loss()
        flat[j] = old - 1e-2
        low = loss()
        flat[j] = old
        assert abs((high - low) / 2e-2 - g.reshape(-1)[j]) < 2e-4


def test_windows_cover_all_words():
    ends = np.array([0, 0, 5, 37, 69, 200])
    rows, text, held = toxicity.window_rows(ends, 999, np.arange(200, dtype=np.int32))
    for k in range(5):
        mine = rows[text == k]
        assert set(mine[mine != 999].tolist()) == set(range(ends[k], ends[k + 1]))
    assert F is not None
