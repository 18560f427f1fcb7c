"""Main text of web pages: a bidirectional LSTM in numpy labels every block with the whole page as context."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches, table

# How HTML's elements behave, and words that sites use for parts of a page.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object".split())
FOREIGN = {"svg", "math"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT = [["t:article"], ["t:main"], ["t:main", "t:article"], ["t:div", "c:content"], ["t:div", "c:main", "c:content"], ["t:div", "c:post"], ["t:div", "c:article", "c:body"], ["t:section", "c:article"], ["t:div", "c:entry", "c:content"], ["t:div", "c:story"]]
BOILER_TAGS = "nav header footer aside form button menu dialog select".split()
BOILER_WORDS = (
    "ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe signup share social "
    "related recommended sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comments comment disqus replies reply "
    "login search pagination pager tags meta copyright toolbar topbar legal"
).split()

TEXT = re.compile(r"[^<]+")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")
#: Decimal references that html.unescape() must not see: its conversion of very long numbers fails.
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")

PATH_DIM, WORD_DIM, DENSE_DIM = 256, 64, 5
DIM = PATH_DIM + WORD_DIM + DENSE_DIM
HIDDEN, EPOCHS = 12, 8
#: The fit takes at most this many pages, those with the lowest hash of their id, of at most MAX_CHARS characters and
#: MAX_TOKENS path tokens in all.
SAMPLE_PAGES, MAX_CHARS, MAX_TOKENS = 120, 60_000, 300_000
#: Blocks with features in memory, about, and characters of pages that are taken apart at once (a longer page by itself).
ROWS, SLICE = 16_000, 2_000_000

class Place:
    """An open element: its tokens, those of its ancestors as bits of a hash, and whether a link is around it."""

    __slots__ = ("parent", "tokens", "mask", "linked", "depth")

    def __init__(self, parent: Place | None, tokens: list[str], linked: bool = False):
        self.parent, self.tokens = parent, tokens
        self.linked = linked or (parent is not None and parent.linked)
        self.depth = len(tokens) + (parent.depth if parent else 0)
        self.mask = parent.mask if parent else 0
        for t in tokens:
            self.mask |= 1 << zlib.crc32(t.encode()) % PATH_DIM

    def path(self) -> list[str]:
        """Tokens from the root on."""
        levels, place = [], self
        while place is not None:
            levels.append(place.tokens)
            place = place.parent
        return [t for tokens in reversed(levels) for t in tokens]


Block = tuple[Place, str, float]  # where it is, text, share of characters in links
Sample = tuple[list[str], str, float]  # the same with the path spelled out, for the few pages of the fit


class Scanner:
    """Ends of tags and comments of one page, found in time linear in the page.

    A tag ends at the first > outside quotes. If its quotes swallow the rest of the page, quotes count for nothing from
    there on; where no end is left, a < is text. So no part of the page is searched in vain twice.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.comments, self.ends = page, True, True, True

    def find(self, at: int) -> int:
        """Behind the next >, or -1."""
        k = self.page.find(">", at) if self.ends else -1
        self.ends = k >= 0
        return k + 1 if k >= 0 else -1

    def tag(self, at: int) -> int:
        while self.quotes and self.ends:
            m = QUOTE_OR_END.search(self.page, at)
            if m and m[0] == ">":
                return m.end()
            k = self.page.find(m[0], m.end()) if m else -1
            self.quotes, at = k >= 0, k + 1 if k >= 0 else at
        return self.find(at)

    def comment(self, at: int) -> int:
        k = self.page.find("-->", at + 4) if self.comments and self.page.startswith("<!--", at) else -1
        if k >= 0:
            return k + 3
        self.comments &= not self.page.startswith("<!--", at)
        return self.find(at)


class Elements:
    """The open elements, innermost last, and where those of each name are."""

    def __init__(self):
        self.open: list[tuple[str, Place]] = []
        self.at: dict[str, list[int]] = {}

    def top(self) -> Place | None:
        return self.open[-1][1] if self.open else None

    def push(self, name: str, tokens: list[str]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, Place(self.top(), tokens, name == "a")))

    def pop(self, names: set[str], stop: set[str] = frozenset()) -> None:
        """Close the innermost element of these names and all inside it, unless a stop element is in between."""
        last = lambda own: max((self.at[n][-1] for n in own if self.at.get(n)), default=-1)
        k = last(names)
        if k >= 0 and k > last(stop):
            while len(self.open) > k:
                self.at[self.open.pop()[0]].pop()


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(HUGE.sub("\ufffd", ZEROS.sub("&#", text)) if "&#" in text else text)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, with character references decoded and blanks folded.

    Time is linear in the page, however deep or broken it is.
    """
    out: list[Block] = []
    elements, scanner, root = Elements(), Scanner(page), Place(None, [])
    texts: list[str] = []
    place: Place | None = None
    linked = 0

    def flush() -> None:
        nonlocal place, linked
        text = " ".join("".join(texts).split())
        if text:
            out.append((place or root, text, min(1.0, linked / len(text))))
        texts.clear()
        place, linked = None, 0

    at, size = 0, len(page)
    while at < size:
        m, stop = (None, -1) if page[at] != "<" else (TAG.match(page, at), -1)
        if m:
            stop = scanner.tag(m.end())
        elif page[at] == "<" and page[at + 1 : at + 2] in ("!", "?"):
            stop = scanner.comment(at)
            if stop >= 0:
                at = stop
                continue
        if stop < 0:
            piece = "<" if page[at] == "<" else TEXT.match(page, at)[0]
            at += len(piece)
            piece = unescape(piece)
            if place is None and not piece.isspace():
                place = elements.top() or root
            texts.append(piece)
            if elements.open and elements.top().linked:
                linked += len(piece.strip())
            continue
        closing, name, rest = m[1], m[2].lower(), page[m.end() : stop - 1]
        at = stop
        if name in RAW and not closing:
            flush()
            if name in FOREIGN and rest.endswith("/"):
                continue  # closed by itself, which HTML knows only for foreign elements
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            elements.pop({name})
            continue
        if name not in INLINE:
            elements.pop({"p"}, {"article", "div", "td", "li", "body", "section"})
            if name in CLOSES:
                elements.pop(CLOSES[name], {"ul", "ol", "dl", "table", "select"})
        if name not in VOID and not rest.endswith("/"):
            words = [w for found in NAMED.findall(rest) for w in WORD.findall("".join(found).lower())] if rest else []
            elements.push(name, [f"t:{name}", *(f"c:{w}" for w in words)])
    flush()
    return out


def features(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block from start to stop: hashed path tokens, the direction of its hashed counts of all words, and shape."""
    own = found[start:stop]
    x = np.zeros((len(own), DIM), np.float32)
    for k, (place, text, linked) in enumerate(own):
        x[k, :PATH_DIM] = np.unpackbits(np.frombuffer(place.mask.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little")
        if place.tokens:
            x[k, zlib.crc32(f"last {place.tokens[-1]}".encode()) % PATH_DIM] = 1
        # neither cut nor capped: in a long block a cap would hold at every place, and later words would count for nothing
        counts = np.bincount([zlib.crc32(w.encode()) % WORD_DIM for w in text.lower().split()], minlength=WORD_DIM)
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.linalg.norm(counts)
        x[k, -DENSE_DIM:] = (np.log1p(len(text)) / 8, linked, (start + k) / len(found), (len(found) - start - k) / len(found), text[-1] in ".!?")
    return x


def new_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.15, (DIM, 4 * HIDDEN)).astype(np.float32)
        w[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scan(z: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, tape: list | None = None, state: list[np.ndarray] | None = None) -> np.ndarray:
    """Hidden states [pages, steps, HIDDEN] of one direction from input projections z; padding leaves the state as it is.

    A state is gone on from, and left as it is after the last step.
    """
    n, steps, _ = z.shape
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out = np.zeros((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        a = z[:, t] + h @ recurrent
        i, f, o = (sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        live = mask[:, t, None]
        c_new = f * c + i * g
        squashed = np.tanh(c_new)
        if tape is not None:
            tape.append((h, c, i, f, o, g, squashed, live))
        h, c = np.where(live, o * squashed, h), np.where(live, c_new, c)
        out[:, t] = h
    if state:
        state[:] = h, c
    return out


def scan_back(grad: np.ndarray, recurrent: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the projections and the recurrent weights, from those by the hidden states."""
    n, steps, _ = grad.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz, dr = np.zeros((n, steps, 4 * HIDDEN), np.float32), np.zeros_like(recurrent)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed, live = tape[t]
        dh = dh + grad[:, t]
        do, ds = dh * squashed, dc + dh * o * (1 - squashed**2)
        a = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), do * o * (1 - o), ds * i * (1 - g**2)], 1) * live
        dz[:, t] = a
        dr += h.T @ a
        dh, dc = np.where(live, a @ recurrent.T, dh), np.where(live, ds * f, dc)
    return dz, dr


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, DIM), np.float32), np.zeros((len(rows), steps), bool)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, True
    return x, mask


def sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and values of what isn't 0, and the number of rows: a sample page of any number of blocks is kept so."""
    at = np.flatnonzero(x).astype(np.int32)
    return at, x.ravel()[at], len(x)


def dense(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    x = np.zeros(rows * DIM, np.float32)
    x[at] = values
    return x.reshape(rows, DIM)


def hidden_of_long(found: list[Block], w: dict[str, np.ndarray], side: str) -> np.ndarray:
    """Hidden states of one direction over a page of any length, ROWS blocks at a time."""
    state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
    out = np.zeros((len(found), HIDDEN), np.float32)
    step = 1 if side == "f" else -1
    for a in range(0, len(found), ROWS)[::step]:
        z = features(found, a, a + ROWS)[::step] @ w[f"x{side}"] + w[f"c{side}"]
        out[a : a + ROWS] = scan(z[None], w[f"h{side}"], np.ones((1, len(z)), bool), None, state)[0][::step]
    return out


def label(pages: list[list[Block]], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of each block to be main text, for pages given by their blocks; about ROWS blocks have features at once."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        if longest > ROWS:
            k = order.pop()
            both = np.concatenate([hidden_of_long(pages[k], w, side) for side in "fb"], 1)
            out[k] = sigmoid(both @ w["out"] + w["bias"][0])
            continue
        take = max(1, min(len(order), 256, ROWS // longest))
        group, order = order[-take:], order[:-take]
        x, mask = padded([features(pages[k]) for k in group])
        front = scan(x @ w["xf"] + w["cf"], w["hf"], mask)
        back = scan(x[:, ::-1] @ w["xb"] + w["cb"], w["hb"], mask[:, ::-1])[:, ::-1]
        p = sigmoid(np.concatenate([front, back], 2) @ w["out"] + w["bias"][0])
        for row, k in enumerate(group):
            out[k] = p[row, : len(pages[k])]
    return out


def fit(pages: Iterable[tuple[list[Sample], list[int]]], seed: int = 3) -> dict[str, np.ndarray]:
    """Weights by back-propagation through time over whole pages, with Adam."""
    w = new_weights(seed)
    rng = np.random.default_rng(seed)
    data = [(sparse(features([(Place(None, path), *rest) for path, *rest in b])), np.array(y, np.float32)) for b, y in pages if b]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(EPOCHS if data else 0):
        # pages of like length go together, so that little is padded
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][1]) + rng.integers(0, 8))
        batches = np.array_split(order, max(1, len(data) // 16))
        batches = [part for b in batches for part in np.array_split(b, min(len(b), -(-len(b) * max(len(data[k][1]) for k in b) // 16_000)))]
        for batch in (batches[k] for k in rng.permutation(len(batches))):
            x, mask = padded([dense(*data[k][0]) for k in batch])
            y = np.zeros(mask.shape, np.float32)
            for row, k in enumerate(batch):
                y[row, : len(data[k][1])] = data[k][1]
            tapes: tuple[list, list] = ([], [])
            rx = x[:, ::-1]
            front = scan(x @ w["xf"] + w["cf"], w["hf"], mask, tapes[0])
            back = scan(rx @ w["xb"] + w["cb"], w["hb"], mask[:, ::-1], tapes[1])[:, ::-1]
            both = np.concatenate([front, back], 2)
            p = sigmoid(both @ w["out"] + w["bias"][0])
            d = (p - y) * mask / mask.sum()
            grads = {"out": (d[..., None] * both).sum((0, 1)), "bias": np.array([d.sum()], np.float32)}
            dboth = d[..., None] * w["out"]
            for side, inputs, grad, tape in (("f", x, dboth[..., :HIDDEN], tapes[0]), ("b", rx, dboth[:, ::-1, HIDDEN:], tapes[1])):
                dz, grads[f"h{side}"] = scan_back(grad, w[f"h{side}"], tape)
                grads[f"x{side}"] = np.tensordot(inputs, dz, ([0, 1], [0, 1]))
                grads[f"c{side}"] = dz.sum((0, 1))
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= (0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def weak_labels(found: list[Sample]) -> list[int]:
    """1 for blocks inside an article or main element with no part of a page's frame around them."""
    boiler = {f"t:{t}" for t in BOILER_TAGS} | {f"c:{x}" for x in BOILER_WORDS}
    return [int(bool({"t:article", "t:main"} & set(path)) and not boiler & set(path)) for path, _, _ in found]


def variants(found: list[Sample], rng: np.random.Generator, many: int = 3) -> Iterator[tuple[list[Sample], list[int]]]:
    """A page as it is, and with other containers and more frame parts around and inside its article.

    The pages themselves may use few of the elements and names that sites have, so the labeller sees the others here.
    """
    marks = weak_labels(found)
    yield found, marks
    words = [w for _, text, _ in found for w in text.split()] or ["x"]
    for _ in range(many):
        container = CONTENT[rng.integers(len(CONTENT))] if rng.random() < 0.85 else ["t:div"]
        if rng.random() < 0.3:
            container = ["t:div", *container]
        rows: list[tuple[Sample, int]] = []
        for (path, text, linked), mark in zip(found, marks, strict=True):
            if mark:
                k = next(i for i, t in enumerate(path) if t in ("t:article", "t:main"))
                path = [*path[:k], *container, *path[k + 1 :]]
                if path[-1] == "t:h1" and rng.random() < 0.2:
                    path = [*path[:-1], f"t:h{rng.integers(1, 4)}"]
                if rng.random() < 0.08:
                    path = [*path[:-1], str(rng.choice(["t:blockquote", "t:pre", "t:td", "t:li", "t:h2", "t:figcaption", "t:div"]))]
            rows.append(((path, text, linked), mark))
        if rng.random() < 0.4:
            rows = [r for r in rows if r[1] or rng.random() < 0.3]
        first = next((i for i, r in enumerate(rows) if r[1]), len(rows))
        for _ in range(rng.integers(2, 8)):
            if rng.random() < 0.4:
                own = [f"t:{rng.choice(BOILER_TAGS)}"]
            else:
                own = [f"t:{rng.choice(['div', 'section', 'ul', 'aside', 'p'])}", *(f"c:{x}" for x in rng.choice(BOILER_WORDS, rng.integers(1, 3)))]
            own += list(rng.choice(["t:p", "t:p", "t:li", "t:a", "t:div", "t:span", "t:h1", "t:h2", "t:h3"], rng.integers(0, 3)))
            inside = rng.random() < 0.5
            at = int(rng.integers(first, len(rows) + 1)) if inside else int(rng.choice([rng.integers(0, first + 1), len(rows)]))
            for _ in range(rng.integers(1, 4)):
                text = " ".join(rng.choice(words, rng.integers(1, 40)))
                rows.insert(at, (([f"t:{x}" for x in ("html", "body")] + (container if inside else []) + own, text, float(rng.random() < 0.3)), 0))
        yield [r[0] for r in rows], [r[1] for r in rows]


def training_pages(pages: DataFrame) -> list[list[Sample]]:
    """The sample's pages as blocks; of rows with one page_id the one with the lowest hash.

    Left out are very deep pages, and those without an article or main element, which don't say what their text is.
    """
    rows = pages.where(F.length("html").between(1, MAX_CHARS)).select("page_id", "html")
    chosen = rows.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    got = rows.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("first"))
    found = [blocks(r["first"]["html"]) for r in sorted(got.collect(), key=lambda r: r["page_id"])]
    spelled = [[(place.path(), text, linked) for place, text, linked in b] for b in found if sum(place.depth for place, _, _ in b) <= MAX_TOKENS]
    return [b for b in spelled if any(weak_labels(b))]


def slices(pages: list[str]) -> Iterator[list[str]]:
    """The pages in their order, about SLICE characters at a time."""
    held: list[str] = []
    for page in pages:
        if held and sum(map(len, held)) + len(page) > SLICE:
            yield held
            held = []
        held.append(page)
    if held:
        yield held


def extract(pages: DataFrame, seed: int = 3) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Every page is cut into leaf blocks; the labeller, fitted on a bounded sample of the pages with labels from their
    article elements, reads each block's path and all its words and, through both directions of the LSTM, all other blocks. The
    blocks that it takes as main text are joined in page order by two line feeds. Null or empty html, and pages without
    main text, give an empty text. Unclosed tags end with their parent; text of any length is read whole, in linear time
    and in slices of bounded memory; a < that starts no tag is text. Rows with equal page_id are kept; a null page_id is
    kept, but not learned from; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rng = np.random.default_rng(seed)
    w = fit((v for found in training_pages(pages) for v in variants(found, rng)), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for some in slices(batch.column("html").to_pylist()):
                found = [blocks(page) for page in some]
                texts += ["\n\n".join(text for (_, text, _), p in zip(b, m, strict=True) if p >= 0.5) for b, m in zip(found, label(found, w), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
