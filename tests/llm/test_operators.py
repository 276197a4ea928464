"""Each operator against a brute-force version, on small tables with nulls, repeats, clashing names and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkvane.llm import common, decontaminate, embeddings, graph, huffman, jaccard, licenses, packing, pii, quality, substrings, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, c string, k int"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, 1, "c", 2) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def prose(n, seed=0, words=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnorstuéü", k=rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


ODD = [None, "", " ", "\n\n\n", "one", "a b c d", "tie tie tie", "tie tie tie", "naïve Ünïcode 日本語 😀", "x" * 3000, "Der " * 2000, prose(4000, 5), "a  b   c\n\n\nd \n e", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_gives_the_tokenizers_ids(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t or "" for t in ODD] + ["it's I'll don't,", "É,È.", "été é, x", "İ, ſ. ǅ", "x\n\ty\n z\n\n w \n\n v", "..,, a.,b, ,. b.\n.c\n,d", " a", "a ", "a  ", "a\x00b \x00c", "\x00"] + [prose(500, i) for i in range(20)]
    for encoder in (tokens.WordEncoder(path), tokens.WordEncoder(path, memo_words=100)):
        got = encoder.encode(texts)
        for t, g in zip(texts, got, strict=True):
            assert list(np.frombuffer(g, encoder.dtype)) == plain.encode(t, add_special_tokens=False).ids, t


def test_limited_lengths_are_a_full_code_and_optimal():
    rng = np.random.default_rng(3)
    counts = np.concatenate([rng.geometric(0.001, 500), [0, 0, 10**7, 1]])
    lengths = huffman.limited_lengths(counts, 12)
    assert lengths.max() <= 12 and (lengths[counts == 0] == 0).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    free = huffman.limited_lengths(counts, 40)
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((free * counts).sum()) == total


def test_block_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint16)
        lengths = huffman.limited_lengths(np.bincount(ids, minlength=1000), 16)
        block = huffman.encode_block(np.array([7, -1]), np.array([1, n - 1]), ids, lengths, huffman.canonical_codes(lengths))
        names, sizes, back = huffman.decode_block(block, huffman.decoding_table(lengths))
        assert list(names) == [7, -1] and list(sizes) == [1, n - 1] and (back == ids).all()


def test_huffman_files(spark):
    docs = frame(spark, [*ODD, "again"], [*range(100, 100 + len(ODD)), 100])
    got = huffman.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = sorted((i, len(x), x) for i, x in ((r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()))
    at = 0
    for g, (i, n, x) in zip(got, want, strict=True):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, at, n, zlib.crc32(np.array(x, "<u4").tobytes()))
        at += n
    assert huffman.round_trip(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing(spark):
    docs = frame(spark, ODD)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, with_ids=True).orderBy("sequence_id", "offset").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(ODD)}
    seen, at = Counter(), 0
    for g in got:
        assert g.sequence_id * 64 + g.offset == at and g.length <= 64 - g.offset
        x = want[g.doc_id]
        assert g.start == seen[g.doc_id] and g.doc_tokens == len(x) and g.ids_crc32 == zlib.crc32(x[g.start : g.start + g.length].tobytes())
        seen[g.doc_id] += g.length
        at += g.length
    assert seen == {i: len(x) for i, x in want.items()}
    rows = packing.sequences(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, with_ids=True), 64).collect()
    assert sorted(r.n_ids for r in rows)[1:] == [64] * (len(rows) - 1) and sum(r.n_ids for r in rows) == at
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans():
    rng = random.Random(1)
    pieces = ["a@b.co", "@", "x.y+z@q-r.de.fr", ".", "..", "1.2.3.4", "300.1.1.1", "0000255.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49", "12345678901234567", " ", "-", "é", "\n", "+", "007", "b.c", "@d.e"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 8)))
        assert sorted(pii.plain_spans(text)) == sorted(brute_pii(text)), text


def test_pii_disguises_map_back():
    for text, kind, part in [
        ("write to jane.doe [at] example [dot] com please", "email", "jane.doe [at] example [dot] com"),
        ("jane at example dot com", "email", "jane at example dot com"),
        ("mail jаne＠exаmple．com now", "email", "jаne＠exаmple．com"),
        ("call +４９ 30 １２３４５６７", "phone", "+４９ 30 １２３４５６７"),
        ("plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("host 10 dot 0 dot 0 dot 255 up", "ip", "10 dot 0 dot 0 dot 255"),
        ("jane@exa​mple.com", "email", "jane@exa​mple.com"),
    ]:
        plain = pii.plain_spans(text)
        spans = plain + pii.hidden_spans(text, plain)
        assert (kind, part) in [(k, text[a:b]) for k, a, b in spans], (text, spans)
    for clean in ("look at the dot on the map", "meet at noon. one two three", "seven of nine", "Наши слова"):
        assert pii.hidden_spans(clean, []) == []


def test_pii_disguises_of_any_names_and_spacing():
    for text, kind in [
        ("plus one two one two six one six two one", "phone"),
        ("plus seis uno dos tres seis un sept dos", "phone"),
        ("plus oh one eins sechs six two one oh", "phone"),
        ("john [  at ] example.com", "email"),
        ("john [\tat] example.com", "email"),
        ("john {  at } example [dot] museum", "email"),
        ("john at example (.) com", "email"),
        ("john at mail [.] example ( . ) museum", "email"),
    ]:
        for around in ("{}", "write {}, thanks"):
            whole = around.format(text)
            assert [(k, whole[a:b]) for k, a, b in pii.hidden_spans(whole, pii.plain_spans(whole))] == [(kind, text)], whole
    for clean in ("look at the point here", "one, two, three", "meet at (one) place", "un dos tres", "at a point in time"):
        assert pii.hidden_spans(clean, []) == []


def test_pii_table(spark):
    texts = [*ODD, "a@b.co " * 3 + "+1 (017) 555-7713"]
    got = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    last = got[len(texts) - 1]
    assert (last.n_email, last.n_phone, last.n_added) == (3, 1, 0)
    assert last.base_sha256 == hashlib.sha256(last.spans.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask(frame(spark, texts)).collect()}
    assert masked[len(texts) - 1] == "<EMAIL> <EMAIL> <EMAIL> <PHONE>" and masked[0] is None
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


def labelled(spark, make, n=400):
    texts, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        texts.append(make(i, bad))
        labels.append((i, int(not bad), int(bad), "x"))
    return frame(spark, [*texts, None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def accuracy(rows, truth):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, lambda i, bad: prose(60, i, 80) + (" you moron scum " if bad else " you friend "))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 402 and accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.9
    assert {r.held_out for r in rows if r.doc_id < 400} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len(none) == 402 and len({r.score for r in none}) == 1


def test_toxicity_lexicons_count_all_training_rows(spark, monkeypatch):
    docs, labels = labelled(spark, lambda i, bad: prose(20, i, 80) + (" rareslur" if bad and i % 30 == 0 else ""), 1200)
    model = toxicity.fit(docs, labels, sample_rows=60)
    assert "rareslur" in model["words"] and "resl" in model["runs"]
    # A word's other rows count wherever they stand, also where no toxic row does.
    rows = [(f"slur w{i % 50}", 1) for i in range(40)] + [(f"slur w{i % 50}", 0) for i in range(10)] + [(f"w{i % 50}", 0) for i in range(390)]
    whole = toxicity.lexicons(spark.createDataFrame(rows, "text string, y int").coalesce(1))
    parted = spark.createDataFrame(spark.sparkContext.parallelize(rows, 20), "text string, y int")
    assert set(whole[0]) == {"slur"} and np.isclose(whole[0]["slur"], np.log(1 / (11 / 401)))
    assert toxicity.lexicons(parted) == whole
    monkeypatch.setattr(toxicity, "COUNTED_AT_ONCE", 5)
    assert toxicity.lexicons(parted) == whole


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=300), 1)
    knots, values = toxicity.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 <= values.min() and values.max() <= 1


def test_quality_held_out(spark):
    docs, labels = labelled(spark, lambda i, bad: ("Der " * 90 if i % 2 else prose(90, i).upper() + "!!") if bad else prose(90, i))
    few = labels.filter("doc_id < 250")
    rows = quality.score(docs, quality.fit(docs, few)).collect()
    assert len(rows) == 402 and accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}) > 0.9
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert len(none) == 402 and len({r.score for r in none}) == 1


def brute_removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        flags = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return data, out


@pytest.mark.parametrize("hot", [False, True])
def test_long_repeats(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "SEGMENTS_A_CELL", 1)
    a, b = prose(400, 1), prose(120, 2)
    texts = [*ODD, a, a, a[:900] + "#" + a[900:], prose(50, 3) + b + prose(60, 4), b[:700], "é" + b, prose(90, 6), prose(90, 7) + a[100:299], prose(90, 8) + a[100:300], "ab" * 400]
    texts += [prose(30, 100 + i) + " " + b[40:460] + " " + prose(30, 200 + i) for i in range(8)]
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, texts), with_kept=True).collect()}
    for i, (d, flags) in enumerate(zip(*brute_removed(texts), strict=True)):
        kept = np.frombuffer(d, np.uint8)[~flags].tobytes()
        n_spans = int((np.diff(np.r_[False, flags].astype(int)) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(d), int(flags.sum()), n_spans, kept), (i, texts[i][:40])
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substrings.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_run_index_against_brute_force():
    rng = random.Random(5)
    strings = ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(30)] + [b"abab" * 10] * 2
    index = substrings.RunIndex(strings)
    assert int(index.lengths.sum()) == index.n and len(index.lengths) < index.n
    m = index.matching_statistics()
    every = Counter(s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for s, at in zip(strings, index.starts, strict=True):
        for i in range(len(s)):
            want = max((j - i for j in range(i + 1, len(s) + 1) if every[s[i:j]] > 1), default=0)
            assert min(m[at + i], len(s) - i) == want


def brute_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(n, links):
    name = list(range(n))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        name[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_components(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", [3, 32][seed])
    rng = random.Random(seed)
    texts = list(ODD)
    for i in range(12):
        base = prose(rng.choice([3, 6, 12, 40, 120, 400]), 1000 * seed + i).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(50))
            texts.append(" ".join(w))
    shared = prose(60, 77)
    texts += [prose(rng.choice([20, 50, 300]), 5000 + i) + " " + shared for i in range(25)]
    sets = brute_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = brute_components(len(sets), links)
    got = {r.doc_id: r for r in jaccard.link_components(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), want[i]), (i, texts[i])
    assert jaccard.link_components(frame(spark, texts).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1) if i % 20 != 19]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(n, links)
    assert all(got[i] == want[i] for i in range(n))


def test_contained_items(spark):
    items = [prose(40, i, 5000) for i in range(6)] + ["a b c", None, "", prose(40, 0, 5000)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w0 = items[0].split()
    texts = [*ODD, prose(300, 60) + " " + items[0].translate(str.maketrans(licenses.LOWER, licenses.UPPER)) + ". " + prose(2000, 61), " ".join(w0[:36]), " ".join(w0[:30]), items[1] + " x " + items[2], "A, b c!", items[3].replace(" ", ", ")]
    docs = frame(spark, texts)

    def shingles(t):
        w = [x for x in re.split(licenses.BETWEEN, (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = sorted((i, j, len(s), len(s & shingles(t))) for i, t in enumerate(texts) for j, s in ((j, shingles(x)) for j, x in enumerate(items)) if s and 100 * len(s & shingles(t)) >= 80 * len(s))
    got = sorted(tuple(r) for r in decontaminate.contained(docs, table).select("doc_id", "item_id", "n_shingles", "n_found").collect())
    assert got == want and len(got) >= 7
    assert decontaminate.contained(docs.limit(0), table).count() == 0 and decontaminate.contained(docs, table.limit(0)).count() == 0
    assert decontaminate.clean(docs, table).columns == docs.columns


def test_license_scan(spark):
    texts = [*ODD, "x CC BY y cc-by cc by cc by", "All Rights Reserved. general  public license", prose(200, 9) + " Released under the MIT License.", "This work is licensed under the very GNU General Public License, version 3", "licensed under the Apache license, version 2.0" * 2, "published under other terms"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, x) for p, x in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = got[i]
        assert (g.n_words, g.n_base) == (len(w), len(places))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(g.labels.split(",")) and 0 <= g.score <= 1
    n = len(ODD)
    assert got[n + 2].labels == "mit" and got[n + 3].labels == "gpl" and got[n + 4].labels == "apache" and got[n + 5].labels == ""
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_embedding_range_join(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "VECTORS_A_PIVOT", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))
    near = x[rng.integers(0, 20, 80)] + 0.12 * rng.normal(size=(80, 12))
    vectors = [*x.tolist(), *near.tolist(), *x[:5].tolist(), *x[:1].tolist() * 4, (2 * x[3]).tolist()]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0] * 5]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate([*vectors, *bad])], "vec_id long, embedding array<double>, rep string, cell int").repartition(3)
    v = np.array(vectors)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    n = len(v)
    links = [(i, j) for i in range(n) for j in range(i) if s[i, j] >= 0.95]
    want, degree = brute_components(n, links), Counter(k for pair in links for k in pair)
    got = {r.vec_id: r for r in embeddings.range_join(table, block=block).collect()}
    assert len(got) == n + len(bad) and len(links) > 60
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(n, n + len(bad)))
    assert embeddings.range_join(table.limit(0)).count() == 0


def test_embedding_rows_with_one_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a), (7, b), (7, None), (8, [0.0, 0.0, 0.0]), (8, c), (9, c), (3, [1.0, 0.2, 0.0]), (10, [0.0, 1.0, 0.0])]
    got = sorted(tuple(r) for r in embeddings.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 2, 3, True), (7, 0, 7, True), (7, 2, 3, False), (7, 2, 3, False), (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True)]


def test_stage_reads_the_sessions_folder(spark):
    assert common.new_path(spark, "x").startswith(common.shared_dir(spark))
