"""Fast exact token ids from the tokenizers library, by pieces that cannot influence each other."""

from __future__ import annotations

import functools
import gc
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of one generation of a worker's cache of encoded pieces, and twice those of its cache of pre-tokens; each
#: cache holds two generations.
CACHE_ENTRIES = 450_000

#: Fixed value: the split that the library's ByteLevel pre-tokenizer has built in.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places where a text may be cut before a blank or line feed.
_HARD = re.compile(r"(?<=\S)(?=[ \n])")
#: Printable ASCII and Latin-1 letters: their classes and lower-case forms are the same in every version of Unicode.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch


def byte_letters() -> dict[int, str]:
    """The byte-level form: a byte that is a visible character of Latin-1 is itself, the others count up from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Generations:
    """A bounded map from pieces to the bytes of their ids (little-endian unsigned 32-bit), encoded where missing.

    A piece that is asked for is in the young generation; when that is full it becomes the old one, and what was old and
    never asked for again goes. So rare pieces leave and frequent ones stay; only the cost depends on it.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.encode, self.entries = encode, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        absent = [k for k, v in enumerate(out) if v is None]
        if absent:
            names = [pieces[k] for k in absent]
            if old:
                young.update((x, v) for x, v in zip(names, map(old.get, names)) if v is not None)
                unknown = list(dict.fromkeys(x for x in names if x not in young))
            else:
                unknown = list(dict.fromkeys(names))
            young.update(zip(unknown, self.encode(unknown), strict=True))
            for k, x in zip(absent, names, strict=True):
                out[k] = young[x]
        return out


class PieceEncoder:
    """Ids of whole texts as the tokenizers library gives them with add_special_tokens=False.

    A text is cut only where no pre-token can reach across: before a blank or a line feed that follows a character
    which is no white space (byte-level vocabularies), or at blanks and line feeds where white space is dropped. Each
    distinct piece of a batch is looked up once; a piece that no cache holds is cut into pre-tokens, each of which goes
    through the library's model once. A text that holds an added token's string, or a tokenizer of another build, takes
    the library's whole encode.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = [p["type"] for p in pre.get("pretokenizers", [])]
        plain = spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "keep"
        elif plain and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["invert"]:
            self.mode = "drop"
        else:
            self.mode = "whole"
        self.model, self.pre, self.norm = self.tokenizer.model, self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        # The classes of these characters never change, and lower case is all that a normalizer does to them; so their
        # pre-tokens can be had without the library's alignment of characters.
        self.lowers = "Lowercase" in [n["type"] for n in (norm or {}).get("normalizers", [])]
        self.scan = regex.compile(f"{pre['pretokenizers'][0]['pattern']['Regex']}|\\n" if self.mode == "drop" else BYTE_LEVEL_PATTERN).findall
        self.letters = {**byte_letters(), 10: "\n"}  # a line feed parts plain pieces
        self.tokens = Generations(self._model, CACHE_ENTRIES // 2)
        self.first = Generations(functools.partial(self._pieces, blank=""))
        self.rest = Generations(functools.partial(self._pieces, blank=" ")) if self.mode == "keep" else self.first

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, tokens: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in tokens]

    def _odd(self, pieces: list[str], blank: str) -> list[list[str]]:
        """Pre-tokens of each piece, by the library."""
        texts = [p if p[:1] == "\n" else blank + p for p in pieces]
        return [[p for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(t) if self.norm is not None else t)] for t in texts]

    def _plain(self, pieces: list[str], blank: str) -> list[str]:
        """Pre-tokens of each piece in byte-level form, a line feed between them."""
        text = blank + ("\n" + blank).join(pieces)
        text = "\n".join(self.scan(text.lower() if self.lowers else text))
        text = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return text.split("\n\n\n")

    def _pieces(self, pieces: list[str], blank: str) -> list[bytes]:
        """Ids of pieces; those behind a text's first one had a blank, which was cut off, or begin with a line feed."""
        collects = gc.isenabled()
        gc.disable()  # many small lists, no cycles: collections would only walk through them
        try:
            plain = [p for p in pieces if _PLAIN(p)]
            odd = pieces if not plain else [p for p in pieces if not _PLAIN(p)] if len(plain) < len(pieces) else []
            found: dict[str, bytes] = {}
            if plain:
                parts = self._plain(plain, blank)
                ids = self.tokens("\n".join(parts).split("\n"))
                ends = list(accumulate(x.count("\n") + 1 for x in parts))
                found = {p: ids[a] if b - a == 1 else b"".join(ids[a:b]) for p, a, b in zip(plain, [0, *ends], ends, strict=False)}
            if odd:
                parts = self._odd(odd, blank)
                ids = iter(self.tokens([x for own in parts for x in own]))
                found |= {p: b"".join([next(ids) for _ in own]) for p, own in zip(odd, parts, strict=True)}
            return list(map(found.__getitem__, pieces))
        finally:
            if collects:
                gc.enable()

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text; texts has no nulls."""
        if self.mode == "whole":
            return [np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist()]
        alone = np.zeros(len(texts), bool)
        for s in self.special:
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out = self._cut(texts)
        if self.mode == "keep":
            for k in np.flatnonzero(self._wide & ~alone):
                out[k] = np.frombuffer(b"".join(self.first(_HARD.split(texts[k].as_py()))), "<u4")
        for k in np.flatnonzero(alone):
            out[k] = np.frombuffer(self.whole(texts[k].as_py()), "<u4")
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids by pieces between blanks; wrong for texts with a special string, and for those that _wide then marks."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.mode == "keep" else " "), " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        which = words.indices.to_numpy(zero_copy_only=False).copy()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), " ")[0].as_py().split(" ") if len(words.dictionary) else []
        values = self.rest(names)
        if self.mode == "keep":
            # white space before a blank or line feed is not cut off by itself: such a piece is empty or ends in white space
            odd = np.fromiter((not w or w[-1].isspace() for w in names), bool, len(names))[which]
            odd[offsets[1:] - 1] = False
            inner = offsets[:-1][odd[offsets[:-1]]]
            odd[inner] = [bool(names[k]) for k in which[inner]]
            self._wide = np.zeros(len(texts), bool)
            self._wide[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
            # a text's first piece has no blank before it
            heads = self.first([names[k] for k in which[offsets[:-1]]])
            which[offsets[:-1]] = np.arange(len(names), len(names) + len(heads))
            values = values + heads
        # a batch has fewer ids than a text may have bytes, which fit 32 bits
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[which]
        ends = np.cumsum(each, dtype=np.int32)
        at = np.repeat(starts[which] - (ends - each), each)
        at += np.arange(len(at), dtype=np.int32)
        flat = ids[at]
        bounds = np.concatenate(([0], ends))[offsets]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file; it outlives the task."""
    return PieceEncoder(path)
