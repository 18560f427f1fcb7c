"""Language-model scores from a subword lattice: all segmentations of a word count, weighted by unigram piece scores."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches, stage, table

#: Expectation-maximisation rounds over all training words; the vocabulary's own scores weight the first.
#: WHOLE is the first guess of the share of words that their own arc explains.
WHOLE = 0.9
ROUNDS = 2
#: The languages with the most training documents have a model each; all other documents share one more.
LANGUAGES = 7
#: Share of a whole-word arc that its own language's counts give; the rest comes from the counts of all languages.
OWN = 0.997
#: So many occurrences, dealt as in all languages together, join a language's expected counts of pieces.
PRIOR = 100.0
#: So many words, the most frequent ones, are looked up where the texts are; all others by a join.
FREQUENT = 40_000
#: A task's word counts are handed on when there are so many.
HELD_WORDS = 400_000
SMOOTH = 0.01
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split_words(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; bytes.split() parts at exactly U+0009 to U+000D and the blank."""
    return text.encode().translate(_LOWER).split()


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], pa.Array]:
    """split_words() of many texts: where each one's words begin and end among all words, all words as places, the distinct words twice."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at runs of U+0009 to U+000D and the blank, too
    words = lists.flatten().dictionary_encode()
    bounds, which = lists.offsets.to_numpy() - lists.offsets[0].as_py(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = which != pc.index(words.dictionary, "").as_py()  # white space at either end leaves an empty word
    names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), " ")[0].as_py().split(" ")
    return np.concatenate(([0], np.cumsum(some)))[bounds], which[some], names[: len(words.dictionary)], words.dictionary


class Lattice:
    """A vocabulary's pieces as a trie over arrays, walked for many words at once.

    A word is preceded by the mark of a blank, as pieces have it; no piece holds that mark elsewhere, so the lattice of a
    text falls apart at its words. A character without a piece of its own is an arc of one pseudo-piece for each byte.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        children: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        self.size = sp.get_piece_size()
        self.rank = np.zeros(self.size + 2)
        self.longest = 1
        for k in range(self.size):
            piece = sp.id_to_piece(k)
            if sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k) or sp.is_unused(k) or "▁" in piece[1:]:
                continue
            node = 0
            for ch in piece:
                key = (node, ord(ch))
                if key not in children:
                    children[key] = len(piece_of)
                    piece_of.append(-1)
                node = children[key]
            piece_of[node] = k
            self.rank[k] = max(0.0, -sp.get_score(k))
            self.longest = max(self.longest, len(piece))
        keys = np.array([n << 21 | c for n, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece_of = np.array(piece_of, np.int64)
        self.byte, self.end = self.size, self.size + 1  # pseudo-pieces

    def first_scores(self) -> np.ndarray:
        """Natural log probabilities from the vocabulary's own scores: a merge's score is its negative rank, read as Zipf's."""
        p = 1 / (self.rank + 100.0)
        return np.log(p / p.sum())

    def arcs(self, words: list[str]) -> tuple[int, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
        """For words of one length: the number of characters, and by start and span the rows, pieces and byte counts of arcs."""
        n = len(words[0]) + 1
        chars = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.int64)
        out = []
        for i in range(n):
            rows, nodes = np.arange(len(words)), np.zeros(len(words), np.int64)
            for span in range(1, min(self.longest, n - i) + 1):
                c = chars[rows, i + span - 1]
                key = nodes << 21 | c
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                nodes = np.where(found, self.next[at], 0)
                pieces = np.where(found, self.piece_of[nodes], -1)
                if span == 1:
                    lone = pieces < 0
                    if lone.any():
                        width = 1 + (c[lone] >= 0x80) + (c[lone] >= 0x800) + (c[lone] >= 0x10000)
                        out.append((i, 1, rows[lone], np.full(lone.sum(), self.byte), width))
                good = pieces >= 0
                if good.any():
                    out.append((i, span, rows[good], pieces[good], np.ones(good.sum(), np.int64)))
                if not found.all():
                    rows, nodes = rows[found], nodes[found]
                if not len(rows):
                    break
        return n, out

    def forward(self, words: list[str], weigh, trail: tuple[int, ...] = ()) -> tuple[np.ndarray, list, list[np.ndarray]]:
        """log of the summed probability of all segmentations up to each character, the arcs, and their weights.

        weigh(rows, pieces, width) gives the log weights of arcs, in trail models at once.
        """
        n, arcs = self.arcs(words)
        alpha = np.full((len(words), n + 1, *trail), -np.inf)
        alpha[:, 0] = 0
        costs = []
        for i, span, rows, pieces, width in arcs:
            cost = weigh(rows, pieces, width)
            costs.append(cost)
            alpha[rows, i + span] = np.logaddexp(alpha[rows, i + span], alpha[rows, i] + cost)
        return alpha, arcs, costs

    def marginals(self, words: list[str], log_ps: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word, a row for each model."""
        out, by_piece = np.zeros((len(log_ps), len(words))), np.ascontiguousarray(log_ps.T)
        for where in by_length(words):
            weigh = lambda rows, pieces, width: by_piece[pieces] * width[:, None]
            out[:, where] = self.forward([words[k] for k in where], weigh, (len(log_ps),))[0][:, -1].T
        return out

    def expected(self, words: list[str], kinds: np.ndarray, counts: np.ndarray, log_ps: np.ndarray, wholes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """By model: how often each piece is expected in all segmentations of its words, and last the occurrences so explained.

        A row is a word, the model that it teaches and its occurrences there. An occurrence is explained by the arc over
        the whole word or by pieces, as likely as each is without that occurrence itself; so words seen once are left to
        the pieces.
        """
        many, size = len(log_ps), self.size + 3
        total = np.zeros(many * size)
        for where in by_length(words):
            z = kinds[where]
            alpha, arcs, costs = self.forward([words[k] for k in where], lambda rows, pieces, width, z=z: log_ps[z[rows], pieces] * width)
            pieced = (1 - wholes[z]) * np.exp(alpha[:, -1])
            arc = wholes[z] * (counts[where] - 1) / np.maximum(1, tokens[z] - 1)
            own = counts[where] * pieced / np.maximum(pieced + arc, 1e-300)
            total[size - 1 :: size] += np.bincount(z, own, many)
            beta = np.full_like(alpha, -np.inf)
            beta[:, -1] = 0
            where_to, shares = [], []
            for (i, span, rows, pieces, width), cost in zip(reversed(arcs), reversed(costs), strict=True):
                beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, i + span] + cost)
                share = np.exp(alpha[rows, i] + cost + beta[rows, i + span] - alpha[rows, -1]) * own[rows] * width
                where_to.append(z[rows] * size + pieces)
                shares.append(share)
            total += np.bincount(np.concatenate(where_to), np.concatenate(shares), many * size)
        return total.reshape(many, size)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """Record batches put together to tables of about so many rows: the lattice walks many words of a length at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
        yield group


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(fold, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))


def with_kind(rows: DataFrame, languages: int) -> tuple[DataFrame, list[int]]:
    """rows with the number of the model that each training document teaches (-1: held out), and each model's documents.

    A few numbers come to the driver: one for each of the languages with the most training documents, and their rest.
    """
    taught = rows.where("not held_out")
    top = [r["lang"] for r in taught.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    kind = F.lit(len(top))
    for z, name in enumerate(top):
        kind = F.when(F.col("lang").eqNullSafe(name), z).otherwise(kind)
    counts = dict(taught.groupBy(kind.alias("kind")).count().collect())
    sizes = [counts[z] for z in sorted(counts)]  # the rest, if it has documents, comes last
    return rows.withColumn("kind", F.when(F.col("held_out"), -1).otherwise(kind)).drop("lang"), sizes


def word_counts(rows: DataFrame, kinds: int) -> DataFrame:
    """Rows (word, c0, c1, ..., n): occurrences in training texts by model and in all texts; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, Counter] = {kind: Counter() for kind in range(-1, kinds)}  # -1: held-out texts

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counter in counters.items():
                if counter:
                    words = pa.array(list(counter), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), kind, np.int8)), pa.array(list(counter.values()), pa.int64())], ["word", "kind", "n"])
                    counter.clear()

        for batch in batches:
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counters[kind].update(split_words(text))
            if sum(map(len, counters.values())) >= HELD_WORDS:
                yield from flush()
        yield from flush()

    of = lambda z: F.coalesce(F.sum(F.when(F.col("kind") == z, F.col("n"))), F.lit(0)).alias(f"c{z}")
    counted = rows.select(F.col("kind").cast("byte").alias("kind"), "text").mapInArrow(run, "word string, kind byte, n long")
    return counted.groupBy("word").agg(*map(of, range(kinds)), F.sum("n").alias("n"))


def learn_pieces(words: DataFrame, tokens: list[int], documents: list[int], vocabulary: str, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """By model: natural log probabilities of all pieces, and the share of whole-word arcs, from expected counts over all training words.

    Only sums by model and piece come to the driver: as many numbers as models times pieces, whatever the corpus.
    """
    unit, kinds = lattice(vocabulary), len(tokens)
    log_ps, wholes = np.array([unit.first_scores()] * kinds), np.array([WHOLE if n else 0.0 for n in tokens])
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], log_ps=log_ps, wholes=wholes) -> Iterator[pa.RecordBatch]:
            own, totals = lattice(vocabulary), 0.0
            for batch in gathered(batches):
                c = np.array([batch.column(f"c{z}").to_numpy() for z in range(kinds)])
                z, k = np.nonzero(c)
                words = batch.column("word").to_pylist()
                totals = totals + own.expected([words[j] for j in k], z, c[z, k].astype(float), log_ps, wholes, np.array(tokens))
            z, k = np.nonzero(np.atleast_2d(totals))
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(k), pa.array(np.atleast_2d(totals)[z, k])], ["kind", "piece", "n"])

        sums = words.drop("n").mapInArrow(run, "kind long, piece long, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((kinds, unit.size + 3))
        counts[sums["kind"].to_numpy(), sums["piece"].to_numpy()] = sums["n"].to_numpy()
        pieced, counts = counts[:, -1], counts[:, :-1]
        counts[:, unit.end] += pieced  # each word ends once: what follows its last piece
        prior = counts.sum(0) + SMOOTH
        counts = counts + PRIOR * prior / prior.sum()
        log_ps = np.log(counts / counts.sum(1, keepdims=True))
        log_ps[:, unit.byte] -= math.log(256)
        wholes = np.array([min(1 - 1e-6, max(1 - p / n, d / n)) if n else 0.0 for p, n, d in zip(pieced.tolist(), tokens, documents, strict=True)])
    return log_ps, wholes


def most_frequent(words: DataFrame, many: int) -> DataFrame:
    """The rows with the greatest n, many at most: those above a cutoff on a logarithmic scale of some hundred steps.

    A histogram finds the cutoff, so no task sorts or gathers more than what is returned.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    upto = accumulate(r["count"] for r in counts)
    kept = [r["step"] for r, n in zip(counts, upto, strict=True) if n <= many]
    return words.where(step >= kept[-1]) if kept else words.limit(0)


def score(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, frequent: int = FREQUENT, languages: int = LANGUAGES) -> DataFrame:
    """Per row of docs (doc_id, text, and lang if there is one): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learning takes the rows with crc32 of the id's text modulo 5 other than 1 (and null ids). The pieces of the given
    sentencepiece vocabulary weight all segmentations of a word: a forward recursion in log space sums them. Its own
    scores are merge ranks and no probabilities, so they only start the estimate; expected counts over the training
    words make the probabilities. A word of the training texts has one more arc, from its first to its last node, whose
    share of all words is estimated along with the pieces. Each frequent language of the training rows weights the
    lattice in its own way, all other rows (null lang too, or all if there is no lang) in one more. A text's probability
    is the product over its words and its end, summed over these models by their shares of the training documents; its
    own lang is never looked at. score is log10 of that, base_score the
    smoothed word unigram. Words differ in frequency by orders: the most frequent ones (a fixed number) go to the tasks
    that read the texts, all others meet their scores in a join that adaptive execution may split. Null or empty text is
    its end alone. Rows with equal doc_id are scored one by one; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, sizes = with_kind(with_fold(docs), languages)
    train_docs, sizes = sum(sizes), sizes or [0]
    kinds = range(len(sizes))
    counts = stage(word_counts(rows, len(sizes)), "words")
    seen = sum(F.col(f"c{z}") for z in kinds)
    sums = counts.agg(*(F.sum(f"c{z}").alias(f"c{z}") for z in kinds), F.count_if(seen > 0).alias("v")).first()
    tokens = [(sums[f"c{z}"] or 0) + sizes[z] for z in kinds]
    total, distinct = sum(tokens), sums["v"] + (train_docs > 0)
    log_ps, wholes = learn_pieces(counts, tokens, sizes, vocabulary, rounds)

    def arc(z: int, own, every):
        """Probability of a whole-word arc in model z, given the word's occurrences there and in all training texts."""
        return float(wholes[z]) * (OWN * own / max(1, tokens[z]) + (1 - OWN) * every / max(1, total))

    if train_docs:
        stops = [math.log10(arc(z, sizes[z], train_docs)) + math.log10(sizes[z] / train_docs) for z in kinds]
    else:
        stops = [float(log_ps[0][lattice(vocabulary).end]) / math.log(10)]
    end = np.array([math.log10(train_docs + 0.5), int(train_docs > 0), *stops])
    norm = math.log10(total + 0.5 * (distinct + 1))
    models = [f"l{z}" for z in kinds]
    values = ["base", "known", *models]
    kept = ", ".join(f"{c} double" for c in values)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary)
        for batch in gathered(batches):
            c = [batch.column(f"c{z}").to_numpy() for z in kinds]
            every = sum(c)
            lms = own.marginals(batch.column("word").to_pylist(), log_ps)
            for z in kinds:
                with np.errstate(divide="ignore"):
                    lms[z] = np.logaddexp(lms[z] + log_ps[z][own.end] + math.log1p(-wholes[z]), np.log(arc(z, c[z], every))) / math.log(10)
            columns = [pa.array(np.log10(every + 0.5)), pa.array((every > 0).astype(float)), *map(pa.array, lms)]
            yield from pa.table([batch.column("word"), *columns, batch.column("n")], ["word", *values, "n"]).to_batches()

    scored = stage(counts.mapInArrow(weigh, f"word string, {kept}, n long"), "scores")
    top = most_frequent(scored, frequent).toArrow()
    places = {w: k for k, w in enumerate(top["word"].to_pylist())}
    weights = np.array([np.append(top[c].to_numpy(), 0.0) for c in values])  # the last place is that of all other words
    shared = docs.sparkSession.sparkContext.broadcast((places, weights))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            bounds, which, names, distinct = batch_words(batch.column("text"))
            sizes, many = np.diff(bounds), batch.num_rows
            owner = np.repeat(np.arange(many), sizes)
            place = np.fromiter((known.get(w, len(known)) for w in names), np.int64, len(names))[which]
            sums = [np.bincount(owner, column[place], many) + e for column, e in zip(weights, end, strict=True)]
            rare = place == len(known)
            pairs, times = np.unique(owner[rare] * max(1, len(names)) + which[rare], return_counts=True)
            whose, what = np.divmod(pairs, max(1, len(names)))
            cuts = pa.array(np.searchsorted(whose, np.arange(many + 1)).astype(np.int32))
            counts = [pa.ListArray.from_arrays(cuts, x) for x in (distinct.take(pa.array(what)), pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sizes.astype(np.int64) + 1), *map(pa.array, sums), *counts], ["doc_id", "held_out", "n_tokens", *values, "rest", "times"])

    parts = rows.drop("kind").mapInArrow(read, f"doc_id long, held_out boolean, n_tokens long, {kept}, rest array<string>, times array<int>")
    parts = stage(parts.withColumn("uid", F.monotonically_increasing_id()), "parts")
    tail = parts.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    met = tail.join(scored.select("word", *values), "word")
    added = met.groupBy("uid").agg(*(F.sum(F.col("k") * F.col(c)).alias(f"more_{c}") for c in values))
    both = parts.drop("rest", "times").join(added, "uid", "left")
    whole = both.select("doc_id", "held_out", "n_tokens", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))).alias(c) for c in values))
    best = F.greatest(*models) if len(models) > 1 else F.col(models[0])
    spread = F.log10(sum(F.pow(F.lit(10.0), F.col(c) - best) for c in models))
    return whole.select(
        "doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (best + spread).alias("score"),
    )


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
