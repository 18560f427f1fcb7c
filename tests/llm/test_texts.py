import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessel.llm import count_rtree, cover_tree, html_blocks, lattice_lm, quality_cnn, quality_rules
from tessel.llm.common import components


def parted(pairs, nodes):
    """Smallest reachable node of each node."""
    best = {k: k for k in nodes}
    while True:
        changed = False
        for a, b in pairs:
            low = min(best[a], best[b])
            for k in (a, b):
                if best[k] != low:
                    best[k], changed = low, True
        if not changed:
            return best


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 50), (50, 70), (200, 200), (5, 3), (5, 3)]
    got = dict(map(tuple, components(spark.createDataFrame([*pairs, (None, 4)], "a long, b long")).collect()))
    assert got == parted(pairs, {k for p in pairs for k in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- rules


def plain_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.sub("[\x20\x09-\x0d]", "", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_counts():
    texts = ["", " \n\t", "one two", "a b c d e f\na b c d e f\n\n \na b c d e f", "x " * 30, "é ü *#|<>&%$ \x1c z\x0bq\r\ny\ry", "A! B? " * 3, "a b c d e " + "f g h i j " + "a b c d e z"]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == plain_counts(text), repr(text)


def test_binomial():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (7, 7, 0.3), (1000, 10, 0.02)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    # 0 of 149 allows a bound of 0.02 at level 0.05, 0 of 148 does not
    assert quality_rules.certify({0: 149}, 0.02, 0.05) == 0 and quality_rules.certify({0: 148}, 0.02, 0.05) == len(quality_rules.LOOSER)
    assert quality_rules.certify({}, 0.02, 0.05) == len(quality_rules.LOOSER)
    assert quality_rules.certify({0: 400, 2: 30}, 0.02, 0.05) == 2  # the two tightest steps reject too many
    assert quality_rules.best_cutoff([(0, 1, 100), (300, 0, 40)]) in range(0, 300) and quality_rules.best_cutoff([(5, 1, 9), (5, 0, 9)]) == quality_rules.STEPS


def test_rules(spark):
    good = "some plain words that make a clean text number {} of all these here now"
    rows = [(k, good.format(k), "en") for k in range(900)]
    rows += [(k, " ".join(f"w{k}{j}***" for j in range(20)), "en") for k in range(900, 1000)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, "too short", "xx"), (2003, good.format("x"), None), (2003, good.format("x"), None), (None, good.format("n"), "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(k, int(k < 900), 0) for k in range(1000)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[k] for k in range(900)) and not any(kept[k] for k in range(900, 1000))
    assert (kept[2000], kept[2001], kept[2002], kept[2003], kept[None]) == (False, False, False, True, True)
    few = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] for r in few if r["doc_id"] is not None and 900 <= r["doc_id"] < 1000)  # nothing is certified without labels
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_rules_equal_plain(spark, sf_dir):
    """kept from end to end by loops over rows: cutoffs proposed on one half of the labels, certified on the other."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rng = np.random.default_rng(4)
    more = [(10**6 + k, " ".join(f"v{j}{k}" if rng.random() < 0.8 or k % 9 else "#*!" for j in range(40)) + f" {k} " + " ".join(f"w{j}{k}" for j in range(60)), "xx") for k in range(900)]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(10**6 + k, int(k % 9 > 0)) for k in range(900)], "doc_id long, quality int"))
    half = {r[0]: r[1] for r in docs.select("doc_id", (F.xxhash64("doc_id") % 2 == 0)).collect()}
    quality = {r[0]: r[1] for r in labels.collect() if r[1] in (0, 1)}
    rows, alpha, delta = {}, 0.02, 0.05
    for i, text, lang in docs.collect():
        n = dict(zip(quality_rules.NAMES, quality_rules.text_counts(text or ""), strict=True))
        stats = {r: min(1000, 1000 * n[a] // max(1, n[b])) for r, (a, b) in quality_rules.RULES.items()}
        rows[i] = (lang, n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"], stats)
    cutoffs, strata = {}, sorted({z for i, (z, bad, _) in rows.items() if not bad and i in quality and half[i]}, key=str)
    for z in strata:
        own = [(i, stats) for i, (lang, bad, stats) in rows.items() if lang == z and not bad and i in quality]
        cut = {r: quality_rules.best_cutoff([(v, q, n) for (v, q), n in Counter((s[r], quality[i]) for i, s in own if half[i]).items()]) for r in quality_rules.RULES}
        good = [s for i, s in own if not half[i] and quality[i] == 1]
        best = None
        for f in reversed(quality_rules.LOOSER):
            lost = sum(any(s[r] > min(1000, math.floor(cut[r] * f)) for r in cut) for s in good)
            if not good or sum(math.comb(len(good), k) * alpha**k * (1 - alpha) ** (len(good) - k) for k in range(lost + 1)) > delta / len(strata):
                break
            best = f
        if best:
            cutoffs[z] = {r: min(1000, math.floor(c * best)) for r, c in cut.items()}
    want = {i: not bad and not any(s[r] > c for r, c in cutoffs.get(z, {}).items()) for i, (z, bad, s) in rows.items()}
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert got == want and "xx" in cutoffs and not all(want[i] for i, (z, bad, _) in rows.items() if z == "xx" and not bad)


# ---- classifier


def test_cnn(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "x"), (10**6 + 2, "ab " * 9000)], "doc_id long, text string")
    rows = quality_cnn.score(docs.select("doc_id", "text").union(extra), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.8
    assert quality_cnn.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_cnn.score(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_cnn_with_repeated_ids(spark, sf_dir):
    """The fit doesn't depend on the order of rows, and columns may be called anything."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.selectExpr("doc_id", "concat('!', text, ' other') as text").limit(50)
    rows = docs.select("doc_id", "text").union(again).selectExpr("*", "1 as score", "'x' as quality", "2 as h", "3 as _row")
    read = lambda df: Counter((r["doc_id"], r["score"]) for r in quality_cnn.score(df, labels.union(labels)).collect())
    first = read(rows)
    assert sum(first.values()) == rows.count() and first == read(rows.orderBy(F.rand(3)))


def test_cnn_gradient(monkeypatch):
    """One step without momentum or decay moves each weight by the sign of the numeric slope of the loss."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (5, 40, 4200, 9000)]
    y = np.array([1, 0, 1, 0])

    def loss(w):
        pairs = quality_cnn.pair_tables(w)
        p = np.array([quality_cnn.probability(quality_cnn.chunk_maxima(t, pairs)[0], w)[0] for t in texts])
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    monkeypatch.setattr(quality_cnn, "EPOCHS", 1)
    start = quality_cnn.weights(7)
    moved = quality_cnn.fit(texts, y.tolist(), 7)
    base, checked = loss(start), 0
    for name in ("table", "out", "bias"):
        flat = start[name].ravel()
        for k in np.argsort(-np.abs(moved[name].ravel() - flat))[:40]:
            up, down = ({**start, name: start[name].copy()} for _ in range(2))
            up[name].ravel()[k] += 2e-2
            down[name].ravel()[k] -= 2e-2
            slope = (loss(up) - loss(down)) / 4e-2
            if abs(slope) > 1e-3:
                checked += 1
                assert np.sign(moved[name].ravel()[k] - flat[k]) == -np.sign(slope), (name, k)
    assert checked > 30 and loss(moved) < base


def test_cnn_covers_whole_text():
    w = quality_cnn.weights()
    pairs = quality_cnn.pair_tables(w)
    raw = bytes(np.random.default_rng(1).integers(97, 120, 3 * quality_cnn.CHUNK + 17).astype(np.uint8))
    best, where = quality_cnn.chunk_maxima(raw, pairs)
    data = np.frombuffer(raw, np.uint8)
    plain = sum(w["table"][k][data[k : len(data) - quality_cnn.WIDTH + 1 + k]] for k in range(quality_cnn.WIDTH))
    assert len(best) == 4 and np.allclose(best.max(0), plain.max(0), atol=1e-4)
    assert np.allclose(plain[where[2], np.arange(quality_cnn.FILTERS)], best[2], atol=1e-4)


# ---- language model


def test_lattice_sums_all_segmentations():
    unit = lattice_lm.lattice(P.path("piece_bpe_32k.model"))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(k): k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k))}
    log_p = unit.first_scores()
    words = ["the", "anthem", "étreaux", "a", "zq%%", "the"]
    both = unit.marginals(words, np.array([log_p, log_p - 1.0]))
    assert (both[1] < both[0]).all()
    for word, got in zip(words, both[0], strict=True):
        text, total = "▁" + word, 0.0
        for n in range(len(text)):
            for cuts in combinations(range(1, len(text)), n):
                parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)]
                if all(p in pieces for p in parts):
                    total += math.exp(sum(log_p[pieces[p]] for p in parts))
        assert got == pytest.approx(math.log(total), abs=1e-9)
    rows = lambda *z: (np.array(z), np.ones(len(words)), np.array([log_p] * 2), np.zeros(2), np.array([100, 100]))
    e = unit.expected(words, *rows(0, 0, 1, 1, 1, 0))
    assert e[:, -1].tolist() == pytest.approx([3, 3])
    parts = [unit.expected([w for w, k in zip(words, (0, 0, 1, 1, 1, 0)) if k == z], np.zeros(3, int), np.ones(3), np.array([log_p]), np.zeros(1), np.array([100]))[0] for z in (0, 1)]
    assert np.allclose(e, parts)


def test_batch_words():
    texts = ["", " ", "\ta  B\x1cc\x85 \xa0é\r\n", "İ ÀB", "x"]
    bounds, which, names, distinct = lattice_lm.batch_words(pa.array(["cut off", *texts]).slice(1))
    assert names == distinct.to_pylist() and len(lattice_lm.batch_words(pa.array([], pa.string()))[2]) == 0
    for k, text in enumerate(texts):
        assert [names[j].encode() for j in which[bounds[k] : bounds[k + 1]]] == lattice_lm.split_words(text)


def test_most_frequent(spark):
    rows = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([1] * 50 + [2] * 9 + [3, 700, 10**9])], "word string, n long")
    got = lambda many: sorted(r["n"] for r in lattice_lm.most_frequent(rows, many).collect())
    assert (got(0), got(1), got(3), got(11), got(12), got(10**6)[:1]) == ([], [10**9], [3, 700, 10**9], [3, 700, 10**9], [*[2] * 9, 3, 700, 10**9], [1])

def test_lm(spark):
    texts = ["the cat sat", "The CAT sat on a mat", None, "", "a\x0bb c \x1c zebra", "the " * 50, "日本 🙂 unseen"] * 3
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "the cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = lattice_lm.score(docs, P.path("piece_bpe_32k.model"), rounds=2, frequent=2).collect()
    assert len(got) == len(rows)
    train = Counter()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    for k, t, _ in rows:
        if not held(k):
            train.update([*lattice_lm.split_words(t or ""), None])
    total, distinct = sum(train.values()), len(train)
    by = {k: t for k, t, _ in rows}
    for r in got:
        words = [*lattice_lm.split_words(by[r["doc_id"]] or ""), None]
        want = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(train[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
    assert lattice_lm.score(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    # the rare path and the frequent path give the same
    other = {r["doc_id"]: r["score"] for r in lattice_lm.score(docs, P.path("piece_bpe_32k.model"), rounds=2, frequent=10**6).collect()}
    assert all(r["score"] == pytest.approx(other[r["doc_id"]]) for r in got)


def plain_lm(rows, path, rounds):
    """log10 probability of each text by sums over dictionaries, one word and one segmentation step at a time."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(k): k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k) or sp.is_unused(k)) and "▁" not in sp.id_to_piece(k)[1:]}
    size = sp.get_piece_size()
    first = [1 / 100.0] * (size + 2)
    for k in pieces.values():
        first[k] = 1 / (max(0.0, -sp.get_score(k)) + 100.0)

    def steps(word):
        text = "▁" + word
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in pieces:
                    yield i, j, pieces[text[i:j]], 1
                elif j == i + 1:
                    yield i, j, size, len(text[i].encode())

    def sums(word, p):
        """Probability up to each character, and from each one on."""
        n = len(word) + 1
        alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, k, w in steps(word):
            alpha[j] += alpha[i] * p[k] ** w
        for i, j, k, w in sorted(steps(word), reverse=True):
            beta[i] += beta[j] * p[k] ** w
        return alpha, beta

    words_of = lambda t: [w.decode() for w in lattice_lm.split_words(t or "")]
    taught = [(t, z) for k, t, z in rows if not (k is not None and zlib.crc32(str(k).encode()) % 5 == 1)]
    by_lang = Counter(z for _, z in taught if z is not None)
    top = sorted(by_lang, key=lambda z: (-by_lang[z], z))[: lattice_lm.LANGUAGES]
    kind = lambda z: top.index(z) if z in top else len(top)
    kinds = sorted({kind(z) for _, z in taught})
    docs = [sum(kind(z) == q for _, z in taught) for q in kinds]
    counts = [Counter(w for t, z in taught if kind(z) == q for w in words_of(t)) for q in kinds]
    tokens = [sum(c.values()) + d for c, d in zip(counts, docs, strict=True)]
    ps = [[x / sum(first) for x in first]] * len(kinds)
    wholes = [lattice_lm.WHOLE] * len(kinds)
    for _ in range(rounds):
        totals = []
        for q in kinds:
            total, pieced_sum = [0.0] * (size + 2), 0.0
            for word, c in counts[q].items():
                alpha, beta = sums(word, ps[q])
                pieced, arc = (1 - wholes[q]) * alpha[-1], wholes[q] * (c - 1) / max(1, tokens[q] - 1)
                own = c * pieced / (pieced + arc)
                pieced_sum += own
                for i, j, k, w in steps(word):
                    total[k] += own * w * alpha[i] * ps[q][k] ** w * beta[j] / alpha[-1]
            total[size + 1] += pieced_sum
            totals.append((total, pieced_sum))
        prior = [sum(t[k] for t, _ in totals) + lattice_lm.SMOOTH for k in range(size + 2)]
        ps = []
        for total, _ in totals:
            scale = lattice_lm.PRIOR / sum(prior)
            mixed = [n + scale * p for n, p in zip(total, prior, strict=True)]
            whole = sum(mixed)
            p = [x / whole for x in mixed]
            p[size] /= 256
            ps.append(p)
        wholes = [min(1 - 1e-6, max(1 - t / n, d / n)) for (_, t), n, d in zip(totals, tokens, docs, strict=True)]
    every = sum(counts, Counter())
    out = []
    for _, t, _ in rows:
        logs = []
        for q in kinds:
            arc = lambda own, all_: wholes[q] * (lattice_lm.OWN * own / tokens[q] + (1 - lattice_lm.OWN) * all_ / sum(tokens))  # noqa: B023, E731
            log = math.log10(docs[q] / sum(docs)) + math.log10(arc(docs[q], sum(docs)))
            for w in words_of(t):
                log += math.log10(sums(w, ps[q])[0][-1] * ps[q][size + 1] * (1 - wholes[q]) + arc(counts[q][w], every[w]))
            logs.append(log)
        out.append(max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs)))
    return out


def test_lm_equals_plain_sums(spark):
    rng = np.random.default_rng(9)
    syllables = ["the", "que", "sch", "é", "ing", "zz", "日", "o", "-", "x1"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 30))), [None, "a", "b"][k % 3]) for k in range(40)] + [(77, None, "a"), (None, "the que", "b")]
    docs = spark.createDataFrame([(*r, j) for j, r in enumerate(rows)], "doc_id long, text string, lang string, score int")
    path = P.path("piece_bpe_32k.model")
    want = plain_lm(rows, path, 2)
    for frequent in (3, 1000):
        got = lattice_lm.score(docs, path, rounds=2, frequent=frequent).collect()
        assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), rel=1e-9)


def test_lm_of_languages(spark):
    """A model for each frequent language: better on texts of a language, and the text's own lang doesn't matter."""
    rng = np.random.default_rng(5)
    syllables = {"a": ["the", "and", "tion", "ing", "er"], "b": ["que", "los", "ment", "eau", "ci"], "c": ["sch", "ung", "ein"], None: ["zz", "xy"]}
    langs = ["a", "b", "a", "b", "c", None]
    rows = [(k, " ".join("".join(rng.choice(syllables[langs[k % 6]], 2)) for _ in range(60)), langs[k % 6]) for k in range(120)]
    path = P.path("piece_bpe_32k.model")
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema)
    scores = lambda df, **o: {r["doc_id"]: r for r in lattice_lm.score(df, path, frequent=5, **o).collect()}
    many, one, few = scores(docs), scores(docs.drop("lang")), scores(docs, languages=2)
    held = [k for k, r in many.items() if r["held_out"]]
    assert all(many[k]["base_score"] == pytest.approx(one[k]["base_score"]) for k in many)
    assert sum(many[k]["score"] for k in held) > sum(few[k]["score"] for k in held) > sum(one[k]["score"] for k in held)
    assert all(scores(docs, languages=0)[k]["score"] == pytest.approx(one[k]["score"]) for k in held[:5])
    other = spark.createDataFrame([(k, t, "b" if k in held else z) for k, t, z in rows], schema)
    moved = scores(other)
    assert all(moved[k]["score"] == pytest.approx(many[k]["score"]) for k in many)


def test_lm_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    add = lambda df: df.where("held_out").agg({"score": "sum"}).first()[0]
    assert add(lattice_lm.op2_lattice_lm(spark, sf_dir)) > add(lattice_lm.score(docs.drop("lang"), P.path("piece_bpe_32k.model")))


# ---- pages


def test_blocks():
    page = "<p>a &amp; b<br>c&nbsp;d<p>e<script>var x='</p>';</script><b>f</b> g<!-- no --><ul><li>h<li><a href='/x'>i</a></ul>j < k &am"
    assert [t for _, t, _ in html_blocks.blocks(page)] == ["a & b c d", "e", "f g", "h", "i", "j < k &am"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<div class='x y'><p>z")[0][0].path() == ["t:div", "c:x", "c:y", "t:p"]
    assert html_blocks.blocks("<")[0][1] == "<" and html_blocks.blocks("<p <script>x")


def test_foreign_elements_closed_by_themselves():
    texts = lambda page: [t for _, t, _ in html_blocks.blocks(page)]
    assert texts("<p>a<svg class='icon' /><p>b<svg><text>no</text></svg><math/><p>c<SVG/>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<svg><text>no</text></svg>b<script/>no</script>c") == ["a", "b", "c"]


HOSTILE = {
    "unclosed tags": "<a ",
    "unclosed quotes": "<a href='",
    "quotes around ends": "<a b='>\">",
    "nested": "<div>x",
    "nested links": "<a><b>x",
    "comments": "<!-- x <!",
    "declarations": "<?x <!y ",
    "unclosed raw": "<p>x</script <scrip",
    "lists": "<li><ul><div><li>x",
    "stray ends": "<ul></p>x",
    "references": "&#999999999 &amp",
    "signs": "<<",
}


@pytest.mark.parametrize("case", sorted(HOSTILE))
def test_blocks_in_linear_time(case):
    import time

    def took(n):
        page = HOSTILE[case] * (n // len(HOSTILE[case]))
        begun = time.process_time()
        html_blocks.blocks(page)
        return time.process_time() - begun

    html_blocks.blocks(HOSTILE[case] * 100)
    small, large = min(took(100_000) for _ in range(2)), took(1_600_000)
    assert large < 0.2 + 16 * 4 * small, (small, large)
    assert large < 30


def test_broken_pages():
    texts = lambda page: [t for _, t, _ in html_blocks.blocks(page)]
    assert texts("a < b <p>c <a href='x'>d</a> <a href='y>e") == ["a < b", "c d e"]
    assert texts("<p title='a > b'>c<p title=\"it's\">d<p x=it's>e") == ["c", "d", "e"]
    assert texts("<!-- a --><p>b<!-- c <p>d") == ["bd"]  # a comment without an end goes to the next >
    assert texts("&#" + "9" * 6000 + ";a&#" + "0" * 6000 + "65;") == ["\ufffdaA"]
    assert texts("<p>a" + "<b>" * 3000 + "b" + "<div>" * 3000 + "c") == ["ab", "c"]


#: Pages without an article element, by hand: what stands around the text and the text itself.
BY_HAND = [
    (
        """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="header"><a href="/">Home</a></div><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
        <div class="content"><h1>Rain &amp; wind</h1><p>It rained all day   in the valley, and the river rose.</p><p>By night the wind had
        turned.</p></div><div class="sidebar"><p>Related: <a href=3>other things</a></p></div><footer><p>Copyright us</p></footer><script>var a = "<p>no</p>";</script></body></html>""",
        "Rain & wind\n\nIt rained all day in the valley, and the river rose.\n\nBy night the wind had turned.",
    ),
    (
        """<html><body><div class="cookie notice"><p>We use cookies.</p><button>OK</button></div><main><h1>The bridge</h1><p>The old bridge was <b>closed</b> in spring.</p><blockquote>It will not open again.</blockquote></main>
        <section class="comments"><h3>Comments</h3><p>First!</p></section><form><label>Name</label><input><button>Send</button></form></body></html>""",
        "The bridge\n\nThe old bridge was closed in spring.\n\nIt will not open again.",
    ),
]


def test_pages_by_hand(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(10**6 + k, "u", page) for k, (page, _) in enumerate(BY_HAND)] + [(10**6, "again", BY_HAND[1][0]), (None, "v", BY_HAND[0][0])], "page_id long, url string, html string")
    rows = pages.union(extra).selectExpr("*", "'clash' as text", "1 as n_chars")
    got = [tuple(r) for r in html_blocks.extract(rows).where("page_id >= 1000000 or page_id is null").collect()]
    want = [(10**6 + k, "u", text) for k, (_, text) in enumerate(BY_HAND)] + [(10**6, "again", BY_HAND[1][1]), (None, "v", BY_HAND[0][1])]
    assert sorted(map(str, got)) == sorted(str((*r, len(r[2]))) for r in want)


def test_label_of_long_pages(monkeypatch):
    w = html_blocks.new_weights(1)
    page = html_blocks.blocks("".join(f"<p class=k{k % 7}>word {k} and more<ul><li>x{k}</ul>" for k in range(60)))
    whole = html_blocks.label([page, page[:5]], w)
    monkeypatch.setattr(html_blocks, "ROWS", 17)
    parts = html_blocks.label([page, page[:5]], w)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and np.allclose(whole[1], parts[1], atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(0)
    pages = [([(["t:p", "c:x"], "some words here", 0.0), (["t:nav"], "menu", 1.0), (["t:p"], "more words", 0.0)], [1, 0, 1])] * 4
    w = html_blocks.fit(pages, 1)
    placed = [(html_blocks.Place(None, path), *rest) for path, *rest in pages[0][0]]
    p = html_blocks.label([placed], w)[0]
    assert p[0] > 0.5 > p[1] and p[2] > 0.5
    z = rng.normal(size=(2, 4, 4 * html_blocks.HIDDEN)).astype(np.float32)
    r = rng.normal(0, 0.3, (html_blocks.HIDDEN, 4 * html_blocks.HIDDEN)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    tape = []
    out = html_blocks.scan(z, r, mask, tape)
    dz, _ = html_blocks.scan_back(np.ones_like(out), r, tape)
    for at in ((0, 0, 3), (0, 2, 20), (1, 1, 40), (1, 3, 5)):
        up, down = z.astype(np.float64).copy(), z.astype(np.float64).copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        slope = (html_blocks.scan(up, r, mask).sum() - html_blocks.scan(down, r, mask).sum()) / 2e-3
        assert dz[at] == pytest.approx(slope, abs=2e-2)


def test_features_read_all_words():
    found = lambda words: [(html_blocks.Place(None, ["t:p"]), " ".join(words), 0.0)]
    at = slice(html_blocks.PATH_DIM, html_blocks.PATH_DIM + html_blocks.WORD_DIM)
    words = [f"w{k % 500}" for k in range(2000)]
    x = html_blocks.features(found(words))[0, at]
    want = np.bincount([zlib.crc32(w.encode()) % html_blocks.WORD_DIM for w in words], minlength=html_blocks.WORD_DIM)
    assert np.allclose(x / x.sum(), want / want.sum(), atol=1e-6)
    for k in (61, 1000, 1999):  # a word at any place counts
        assert not np.allclose(html_blocks.features(found([*words[:k], *["other"] * 40, *words[k + 40 :]]))[0, at], x, atol=1e-3)


def test_fit_reads_all_blocks(spark, monkeypatch):
    """All blocks of a sample page are fitted on, whatever their number."""
    page = "<html><body><article>" + "".join(f"<p>some text of paragraph {k}." for k in range(300)) + "</article><footer><p>the end</footer></body></html>"
    seen = []
    monkeypatch.setattr(html_blocks, "fit", lambda pages, seed: seen.extend(pages) or html_blocks.new_weights(seed))
    html_blocks.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    assert [len(seen[0][0]), sum(seen[0][1]), seen[0][0][-1][1]] == [301, 300, "the end"]
    rows = html_blocks.features([(html_blocks.Place(None, path), *rest) for path, *rest in seen[0][0]])
    assert (html_blocks.dense(*html_blocks.sparse(rows)) == rows).all()


def test_extract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(10**6, "u", None), (10**6 + 1, None, ""), (10**6 + 2, "v", "<html><nav><a>only a menu</a></nav></html>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_blocks.extract(pages.union(extra)).collect()}
    right = 0
    rows = pages.collect()
    for r in rows:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n\n".join(t for _, t, _ in html_blocks.blocks(article))
        right += got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]
    assert right >= 0.97 * len(rows)
    assert got[10**6]["text"] == got[10**6 + 1]["text"] == "" and got[10**6 + 2]["text"] == ""
    assert html_blocks.extract(pages.limit(0)).count() == 0


# ---- vectors


def test_cover_tree_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[0] + rng.normal(0, 0.05, (100, 8))
    x[200:260] = x[1] + rng.normal(0, 0.3, (60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = cover_tree.CoverTree(x[:170]), cover_tree.CoverTree(x[170:])
    hits = np.zeros((170, 130), int)
    for p, q, full in cover_tree.dual_traverse(a, b, 0.93):
        if full:
            hits[np.ix_(p, q)] += 1
        else:
            hits[p, q] += 1
    assert (hits == (x[:170] @ x[170:].T >= 0.93)).all()


def tree_hits(x, cosine):
    """How often each pair of rows is yielded, and the tree's nodes."""
    tree, hits = cover_tree.CoverTree(x), np.zeros((len(x), len(x)), int)
    for p, q, full in cover_tree.dual_traverse(tree, tree, cosine):
        np.add.at(hits, np.ix_(p, q) if full else (p, q), 1)
    nodes = [tree.root]
    for n in nodes:
        nodes += n.children or []
    return hits, nodes


def test_cover_tree_near_equal_points():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 64))
    both = np.stack([v / np.linalg.norm(v, axis=1, keepdims=True), 3 * v / np.linalg.norm(3 * v, axis=1, keepdims=True)], 1)
    x = both[(both[:, 0] != both[:, 1]).any(1)].reshape(-1, 64)
    hits, nodes = tree_hits(x, 0.93)
    assert any(len(n.points) > 1 and n.radius == 0 for n in nodes)
    assert (hits == (x @ x.T >= 0.93)).all()


def test_cover_tree_at_the_limit():
    rng = np.random.default_rng(6)
    v, u = rng.normal(size=(2, 200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u -= (u * v).sum(1, keepdims=True) * v
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x, y = (a.astype(np.float32).astype(float) for a in (v, 0.93 * v + np.sqrt(1 - 0.93**2) * u))
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    trees = cover_tree.CoverTree(x), cover_tree.CoverTree(y)
    for tree in trees:
        nodes = [tree.root]
        for n in nodes:
            nodes += n.children or []
        assert all(n.radius == 0 for n in nodes if len(n.points) == 1)  # otherwise the traversal may not end
    hits = np.zeros((200, 200), int)
    for p, q, full in cover_tree.dual_traverse(*trees, 0.93):
        np.add.at(hits, np.ix_(p, q) if full else (p, q), 1)
    dots = x @ y.T
    sure = abs(dots - 0.93) > 1e-14  # the last bit depends on the shape of the product
    assert hits.max() == 1 and (hits == (dots >= 0.93))[sure].all()
    # equal rows whose square rounds below 1
    row = x[(x * x).sum(1) < 1][0]
    assert (tree_hits(np.array([row] * 12), 0.93)[0] == 1).all()


@pytest.mark.parametrize("block", [2, 16, 1024])
def test_near_pairs(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x[60:100] = x[rng.integers(0, 20, 40)] + rng.normal(0, 0.15, (40, 6))
    x[100:110] = x[5]
    x[110] = 3 * x[5]
    rows = [(k, v.tolist(), int(k % 2)) for k, v in enumerate(x)]
    odd = [(200, None, 0), (201, [0.0] * 6, 0), (202, [float("nan")] * 6, 0), (203, [1.0, None] * 3, 1), (204, x[5].tolist(), None), (205, [1.0, 2.0], 0), (206, [], 0), (207, [float("inf")] + [0.0] * 5, 1)]
    odd += [(None, x[5].tolist(), 1), (7, x[3].tolist(), 1)]  # no id; an id repeated with another vector
    frame = spark.createDataFrame([(*r, "extra") for r in rows + odd], "vec_id long, embedding array<double>, label int, rep string")
    got = cover_tree.near_pairs(frame, 0.93, block).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = [*range(120), 3]  # the last one is row 3 under another id
    links = [(i, j) for i, j in combinations(range(121), 2) if place[i] % 2 == place[j] % 2 and unit[place[i]] @ unit[place[j]] >= 0.93]
    count = Counter(k for p in links for k in p)
    best = parted(links, range(121))
    assert len(got) == 130 and [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]
    best[120] = min((7 if k == 120 else k) for k in range(121) if best[k] == best[120])
    assert best[3] == best[120]
    want = Counter((7 if k == 120 else k, count[k], best[k], best[k] == (7 if k == 120 else k)) for k in range(121))
    assert Counter(tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] < 200) == want
    got = {r["vec_id"]: r for r in got}
    for k in range(200, 208):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert cover_tree.near_pairs(frame.limit(0)).count() == 0


def test_near_pairs_with_ties(spark):
    """Rows whose cosine is the limit to the last bits end, and clear pairs around them are told apart."""
    rng = np.random.default_rng(8)
    a = np.zeros(16)
    a[0] = 1
    x = [np.sqrt(0.93) * a + np.sqrt(0.07) * np.eye(16)[k] for k in range(1, 16)] + [a]
    x += [np.sqrt(0.95) * a + np.sqrt(0.05) * v / np.linalg.norm(v) for v in np.pad(rng.normal(size=(20, 15)), ((0, 0), (1, 0)))]
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in cover_tree.near_pairs(frame).collect()}
    dots = np.array(x) @ np.array(x).T
    for k in range(len(x)):
        least, most = (int((dots[k] >= 0.93 + e).sum()) - 1 for e in (1e-12, -1e-12))
        assert max(0, least) <= got[k]["n_links"] <= most and (most == 0 or got[k]["component_id"] >= 0)


# ---- near copies of texts


def jaccard_truth(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(count_rtree.shingle_words(t or "", k))
    links = []
    for a, b in combinations(sets, 2):
        for s in sets[a]:
            for t in sets[b]:
                if s and t and 100 * len(s & t) >= percent * len(s | t):
                    links.append((a, b))
    return parted(links, sets), sets


def test_jaccard(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(words, rng.integers(12, 90))) for _ in range(25)]
    passage = " ".join(rng.choice(words, 20))
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.integers(0, 9)):
            own = list(b)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = str(rng.choice(words))
            texts.append(" ".join(own))
    texts += [f"{passage} {' '.join(rng.choice(words, 20))}" for _ in range(60)]
    texts += [texts[0]] * 5 + ["A b", "a B", "a", "", None, " \n ", "one two three four", "ONE two three\tfour"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(2, texts[2])]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([(*rows[k], 7) for k in order] + [(None, texts[0], 7)], "doc_id long, text string, n int")
    got = count_rtree.jaccard_components(frame).collect()
    best, sets = jaccard_truth(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]][0]), best[r["doc_id"]]), texts[r["doc_id"]]
    assert count_rtree.jaccard_components(frame.limit(0)).count() == 0


def test_shingles():
    texts = ["", " ", "a", "a B", "a b c d", "A b\tc d e", "x " * 50, "a b c d e f g h i " * 3, "é 日 b c d"]
    got = count_rtree.Shingler(4)(pa.array(["none", *texts]).slice(1))
    assert [len(h) for h in got] == [len(count_rtree.shingle_words(t, 4)) for t in texts]
    assert all((np.diff(h.astype(object)) > 0).all() for h in got)
    for (i, s), (j, t) in combinations(enumerate(texts), 2):
        assert len(np.intersect1d(got[i], got[j])) == len(count_rtree.shingle_words(s, 4) & count_rtree.shingle_words(t, 4))
    assert count_rtree.Shingler(4)(pa.array([], pa.string())) == []
    rank = np.arange(count_rtree.COARSE) % 7
    for h in got:
        key = sorted(h.tolist(), key=lambda x: (rank[x >> 48], x))
        for p in range(1, len(h) + 1):
            assert sorted(count_rtree.first_cells(h, rank, p)) == sorted(x >> 16 & 0xFFFFFFFF for x in key[:p])


def test_tree_keeps_all_links():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(30, 60)).astype(np.uint64)) for _ in range(60)]
    for k in range(140):
        own = sets[k % 60].copy()
        own[: rng.integers(0, 6)] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    n = np.array([len(s) for s in sets])
    x = count_rtree.folded([count_rtree.point(s).tobytes() for s in sets])
    a, b = count_rtree.tree_pairs(n, x, np.arange(200), np.ones(200, bool), 85)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in combinations(range(200), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want <= found and len(found) < 200 * 199 / 4


def test_shared_cells_without_a_window(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), int(v), int(v) % 5) for c, v in zip(rng.integers(0, 300, 400), rng.permutation(400), strict=True)] + [(-1, k, 9) for k in range(500, 700)]
    out = count_rtree.shared_cells(spark.createDataFrame(rows, "cell int, node long, n int"))
    assert "Window" not in out._jdf.queryExecution().toString()
    cells = {}
    for c, v, n in rows:
        cells.setdefault(c, []).append((v, n))
    want = [(c, *e, *min(own)) for c, own in cells.items() if len(own) > 1 for e in own]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_same_id_with_other_text(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(30)) for p in "xyz")
    rows = [(1, a), (2, b), (3, a), (3, b), (4, c)]
    got = count_rtree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


# ---- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, seen, sf_dir)
        assert out.columns and set(out.columns) == set(docs.columns)
        before = seen.count()
        seen = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < seen.count() <= before, name
    best, _ = jaccard_truth([(r["doc_id"], r["text"]) for r in seen.collect()])
    assert all(k == v for k, v in best.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(best)


def test_pipeline_with_repeated_ids(spark, sf_dir):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    text = lambda p: " ".join(f"{p}{k} plain words here" for k in range(40))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = {r["predicted"]: texts[r["doc_id"]] for r in quality_cnn.score(docs, labels).collect()}
    for step, good, bad in ((corpus_pipeline.quality_rules_stage, text("a"), "too short"), (corpus_pipeline.quality_classifier_stage, scored[1], scored[0])):
        rows = [(i, t, "en") for i in (10**6, None) for t in (good, bad)]
        out = step(spark, docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True), sf_dir)
        assert out.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] in (10**6, None)) == Counter([(10**6, good), (None, good)])
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (8, text("b")), (3, text("c")), (9, text("c")), (None, text("a")), (None, text("a"))]
    got = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    want = [(7, text("a")), (7, text("b")), (3, text("c")), (None, text("a")), (None, text("a"))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_pipeline_edges(spark, sf_dir):
    """Empty tables, columns with the stages' own names, and no lang column."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    clash = docs.drop("lang").selectExpr("*", "1 as _row", "2 as _no", "3 as _stratum", "4 as n_words", "5 as kept", "6 as score", "7 as component_id", "8 as n", "9 as uid")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, clash, sf_dir)
        assert out.columns == clash.columns and out.count() <= 60
        assert step(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, clash, sf_dir).count() >= 60
