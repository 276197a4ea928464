"""The parts that the operators' methods are made of, against plain versions, and what each operator does with odd tables."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from test_operators import DOCS, frame, prose
from tokenizers import Tokenizer

import corpus_pipeline
from sparkvane.llm import decontaminate, embeddings, huffman, jaccard, licenses, packing, pii, quality, substrings, tokens, toxicity

ODD_PIECES = ["a", "the", "Foo", "é", "É", "é", "ß", "ſ", "İ", "ñ", "日本", "😀", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x85", "'s", "'", "'ll", "'LL", "!", "!!", "...", ",", "-", "_", "&&&", "12", "3.5",
              "<|endoftext|>", "<|startoftext|>", "\x00", "$%", "foo-bar", "x@y.z", "²", "Ⅷ", "ª", "\u0301", "\u200b", "_a", "don't.", "it's,", "a.'s", "Å", "ﬁ", "ǅ", "ŉ", "ÿ."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_odd_texts(name):
    rng = random.Random(5)
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["".join(rng.choice(ODD_PIECES) + rng.choice(["", "", " ", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts.append(" ".join(f"word{i}" for i in range(200_000)))
    encoder = tokens.WordEncoder(path, memo_words=2000)
    for t, g in zip(texts, encoder.encode(texts), strict=True):
        assert list(np.frombuffer(g, encoder.dtype)) == plain.encode(t, add_special_tokens=False).ids, t[:100]


def test_encoder_knows_only_its_kinds_of_tokenizer(tmp_path):
    """One that doesn't lower-case must not be taken for the one that does."""
    from tokenizers.normalizers import NFC

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    plain.normalizer = NFC()
    plain.save(str(tmp_path / "other.json"))
    encoder = tokens.WordEncoder(str(tmp_path / "other.json"))
    assert not encoder.dropped and not encoder.spaced
    assert list(np.frombuffer(encoder.encode(["Foo Bar baz"])[0], encoder.dtype)) == plain.encode("Foo Bar baz", add_special_tokens=False).ids


def test_pii_spans_begin_and_end_with_their_words():
    text = "seven plus four nine three zero one two three four five six"
    assert [text[a:b] for _, a, b in pii.hidden_spans(text, [])] == [text[6:]]
    one, two = "plus four nine three zero one two three four", "plus one two one two six one six two"
    spans = pii.hidden_spans(f"{one} {two}", [])
    assert [f"{one} {two}"[a:b] for _, a, b in sorted(spans)] == [one, two]


def test_pii_recall_of_planted_disguises():
    rng = random.Random(11)
    names = "zero one two three four five six seven eight nine".split()
    greek = str.maketrans("aeopc", "аеорс")
    wide = {ord(str(d)): chr(0xFF10 + d) for d in range(10)}
    spelled = lambda x: " ".join(names[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in x)

    def email():
        local, domain = rng.choice(["jane", "john.doe", "m_smith", "info7"]), rng.choice(["example.com", "mail.example.org", "shop.de"])
        whole = f"{local}@{domain}"
        spaced = domain.replace(".", " dot ")
        return "email", rng.choice([f"{local} [at] {domain}", f"{local} (at) {spaced}", f"{local} at {spaced}", f"{local} at {domain}", f"{local}＠{domain}", whole.translate(greek), whole[:3] + "\u200b" + whole[3:], f"{local}@{domain.replace('.', ' [.] ')}"])

    def phone():
        n = "".join(rng.choices("0123456789", k=rng.randint(9, 12)))
        return "phone", rng.choice([spelled("+" + n), ("+" + n).translate(wide), "+4" + n.replace("0", "O").replace("1", "l") if set("01") & set(n) else spelled("+" + n)])

    def ip():
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return "ip", rng.choice([" dot ".join(parts), spelled(".".join(parts)), ".".join(parts).translate(wide), "[.]".join(parts)])

    def card():
        n = "".join(rng.choices("0123456789", k=15))
        n += next(c for c in "0123456789" if pii.luhn(n + c))
        groups = " ".join(n[i : i + 4] for i in range(0, 16, 4))
        return "card", rng.choice([groups.translate(wide), spelled(n), groups.replace("1", "I").replace("0", "O") if set("01") & set(n) else spelled(n)])

    found, extra = 0, 0
    for k in range(600):
        kind, text = rng.choice([email, phone, ip, card])()
        before, behind = prose(8, k, 500) + " ", ". " + prose(8, 1000 + k, 500)
        whole = before + text + behind
        plain = pii.plain_spans(whole)
        got = [(x, a, b) for x, a, b in pii.hidden_spans(whole, plain) + plain if a < len(before) + len(text) and b > len(before)]
        found += (kind, len(before), len(before) + len(text)) in got
        extra += sum(a < len(before) or b > len(before) + len(text) for _, a, b in got)
    assert found >= 0.9 * 600 and extra <= 0.02 * 600, (found, extra)
    assert not any(pii.hidden_spans(prose(400, k), []) for k in range(50))


def brute_isotonic(x, y):
    """Max-min formula on groups of equal x."""
    keys = sorted(set(x))
    s = np.array([sum(b for a, b in zip(x, y, strict=True) if a == k) for k in keys])
    n = np.array([sum(a == k for a in x) for k in keys])
    mean = lambda i, j: s[i : j + 1].sum() / n[i : j + 1].sum()
    return keys, n, [max(min(mean(i, j) for j in range(k, len(keys))) for i in range(k + 1)) for k in range(len(keys))]


def test_isotonic_against_max_min():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.round(rng.normal(size=40), 1)
        y = (rng.random(40) < 1 / (1 + np.exp(-2 * x))).astype(float)
        keys, n, want = brute_isotonic(x.tolist(), y.tolist())
        knots, values = toxicity.isotonic(x, y)
        at, smooth = 0, 0.0
        for level, group in itertools.groupby(range(len(keys)), key=lambda k: round(want[k], 9)):
            rows = n[list(group)].sum()
            at += rows
            last = sorted(x)[at - 1]
            # Each level is smoothed towards the mean, and stays at or above the one before.
            smooth = max((level * rows + y.mean()) / (rows + 1), smooth)
            assert np.isclose(values[np.flatnonzero(knots == last)[-1]], smooth)
        assert (np.diff(values) >= 0).all()


def test_a_tree_takes_the_best_split():
    rng = np.random.default_rng(4)
    for _ in range(10):
        x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
        trees = toxicity.Trees(rounds=1, depth=1, least=0.0).fit(x, y)
        p = y.mean()
        g, h = p - y, np.full(60, p * (1 - p))
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        best = max((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(3) for c in range(5) if 0 < (x[:, j] <= c).sum() < 60)
        feature, cut, _ = trees.trees[0]
        left = x[:, feature[0]] <= trees.cuts[feature[0]][cut[0]]
        assert np.isclose(score(left) + score(~left), best[0])


def test_lexicons_without_a_rows_own_label():
    """A toxic row's rare word isn't in the lexicon that its own features are made with."""
    found, no, yes = [("slur", 0, toxicity.LEAST_ROWS), ("scum", 0, 50)], 400, 60
    assert set(toxicity.weighted(found, no, yes)) == {"slur", "scum"}
    assert set(toxicity.weighted(found, no, yes, 1)) == {"scum"}
    assert np.isclose(toxicity.weighted(found, no, yes, 1)["scum"], np.log((49 / 59) / (1 / 401)))
    assert np.isclose(toxicity.weighted([("w", 2, 50)], no, yes, 0)["w"], np.log((50 / 60) / (2 / 400)))


def test_risk_gradient_against_differences():
    rng = np.random.default_rng(1)
    p, u, prior = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (40, 4)), 0.4
    net = quality.Network(hidden=5)
    w = [rng.normal(0, 0.5, (4, 5)), rng.normal(0, 0.1, 5), rng.normal(0, 0.5, 5), np.array(0.1)]

    def risk(w):
        sp, su = (1 / (1 + np.exp(-net._forward(x, w)[1])) for x in (p, u))
        return prior * (1 - sp).mean() + su.mean() - prior * sp.mean()

    (ap, fp), (au, fu) = net._forward(p, w), net._forward(u, w)
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    gp, gu = prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    grad = [sum(x) for x in zip(net._back(p, ap, -2 * gp, w), net._back(u, au, gu, w), strict=True)]
    for j, k in [(0, (1, 2)), (1, (3,)), (2, (4,)), (3, ())]:
        up, down = [x.copy() for x in w], [x.copy() for x in w]
        up[j][k] += 1e-6
        down[j][k] -= 1e-6
        assert np.isclose((risk(up) - risk(down)) / 2e-6, grad[j][k], atol=1e-6)


@pytest.mark.parametrize("part", [0.2, 0.5, 0.8, 0.95])
def test_prior_of_known_mixtures(part):
    rng = np.random.default_rng(0)
    good = lambda n: np.column_stack([rng.normal(1.5, 1, n), rng.normal(0, 1, n), rng.normal(1, 1, n)])
    bad = lambda n: np.column_stack([rng.normal(-1.5, 1, n), rng.normal(0, 1, n), rng.normal(-1, 1, n)])
    n = 2000
    web = np.concatenate([good(int(part * n)), bad(n - int(part * n))])[rng.permutation(n)]
    assert abs(quality.estimated_prior(good(n), web) - part) < 0.06


def test_segments_over_a_piece_edge():
    """Digests don't depend on where bytes stand, and every window of a long text lies in one segment."""
    rng = np.random.default_rng(3)
    long = rng.integers(97, 110, substrings._PIECE + 5000).astype(np.uint8).tobytes()
    texts = [long, b"short", long[1000:1900], b"", long[:200]]
    text, start, end, anchor, digest = substrings.segments(texts)
    for i, t in enumerate(texts):
        covered = np.zeros(max(0, len(t) - 199), int)
        for a, b in zip(start[text == i], end[text == i], strict=True):
            covered[a : b - 199] += 1
        assert (covered == 1).all()
    seen = {}
    for i, a, b, d in zip(text, start, end, digest, strict=True):
        assert seen.setdefault(texts[i][a:b], d) == d
    assert len(set(seen.values())) == len(seen)
    assert len({(h, d) for i, h, d in zip(text, anchor, digest, strict=True) if i == 2} & {(h, d) for i, h, d in zip(text, anchor, digest, strict=True) if i == 0}) > 3


def test_repeats_in_texts_over_a_megabyte(spark):
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    a, b, shared = letters(1_200_000), letters(300_000), letters(700)
    edge = substrings._PIECE - 350
    docs = frame(spark, [a[:edge] + shared + a[edge:], b + shared + "z" * 10, letters(5000)])
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, with_kept=True).collect()}
    assert bytes(got[0].kept).decode() == a and (got[0].n_removed, got[0].n_spans) == (700, 1)
    assert bytes(got[1].kept).decode() == b + "z" * 10 and got[2].n_removed == 0


def test_cosine_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 2e200]), (1, [1.0, 2.0]), (2, [1e-200, 0.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.1, 0.1]), (4, [1.0, 1.0, 1.0, 1.0]), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [3.0]), (7, [1e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (2, 2), 3: (2, 2), 4: (0, 4), 5: (2, 2), 6: (1, 6), 7: (1, 6)}


def test_pivots_have_no_last_number():
    counts = [embeddings.pivots_for(10**k) for k in range(3, 13)]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] > 50_000
    assert embeddings.band(64) < 1e-5 < embeddings.band(2048)


def test_empty_tables(spark):
    docs = frame(spark, ["a"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "a b"), (1, None)], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0 and quality.keep(docs, quality.fit(docs, labels)).count() == 0
    assert huffman.round_trip(docs, path).count() == 0 and packing.pack(docs, path).count() == 0
    assert pii.mask(docs).count() == 0 and decontaminate.clean(docs, items).count() == 0
    assert jaccard.link_components(docs).count() == 0 and licenses.scan(docs).count() == 0


def test_pipeline_of_empty_and_clashing_tables(spark, tmp_path):
    """Columns that the operators name too, a very long text, null texts and ids; then tables without rows."""
    texts = [prose(90, i, 3000) for i in range(60)] + ["Der " * 200] * 3 + [None, "", prose(160_000, 77, 3000)]
    docs = frame(spark, texts, [*range(len(texts) - 1), None])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(63)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, prose(30, 9000, 3000))], "item_id long, text string")
    for name, rows in (("full", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.limit(63 if name == "full" else 0).write.parquet(f"{folder}/labels.parquet")
        items.limit(1 if name == "full" else 0).write.parquet(f"{folder}/benchmark.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, rows, folder).columns == rows.columns, stage
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert {p.doc_id for p in pieces} >= set(range(60)) if name == "full" else not pieces


def test_quality_keeps_rows_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, prose(90, 1), "en", "s", None, 0.5, 1, "c", 2), (1, "Der " * 90, "en", "s", None, 0.5, 1, "c", 2), (None, prose(90, 2), "en", "s", None, 0.5, 1, "c", 2)], DOCS)
    train = frame(spark, [prose(90, i) if i % 3 else ("Der " * 90 if i % 2 else prose(90, i).upper() + "!!") for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(250)], "doc_id long, quality int")
    kept = quality.keep(docs, quality.fit(train, labels))
    assert kept.columns == docs.columns and [(r.doc_id, r.text[:3]) for r in kept.collect()] == [(1, prose(90, 1)[:3])]


def test_kept_bytes_are_those_of_the_digest(spark):
    a = prose(100, 1)
    got = substrings.remove_repeats(frame(spark, [a, "x" + a, None]), with_kept=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r.n_bytes - r.n_removed == len(r.kept) for r in got)
