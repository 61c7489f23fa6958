"""BPE encoding and decoding (operator 6).

Encoding: text is normalised and cut into words as the tokenizer file says; each word is encoded by
backtracking. Aho-Corasick gives the longest token at each place, and a token may follow another
only if the pair is compatible, that is if merging in rank order would keep the border between them.
A place from which no token leads on is struck out, so each place is left at most once per token
length and the work is linear in the word. The result is exactly that of merging by rank.
Decoding: one gather from a blob of all token strings through an offset table.

Nulls: a null text counts as empty. Empty texts give no tokens. Repeated rows are encoded again.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from rastrum.llm.frames import map_arrow, table, text_batches

END = "\u0000"  # stands for the end-of-word suffix inside words of byte characters


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


#: What the tokenizer file asks for, but for spaces, which only separate.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def plain_normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # capital sigma lowers by itself, whatever follows


@lru_cache(maxsize=1)
def letter_differences() -> str:
    """Code points that the tokenizer library lowers otherwise than Python or classes otherwise than the pattern
    module, each before a stand-in of the library's class. All know different versions of the character tables; every code point is compared.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    theirs, ours = {}, {}
    for kind, sign in ((r"\p{L}", "b"), (r"\p{N}", "0"), (r"\s", " ")):
        found = pre_tokenizers.Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(every)
        for c in "".join(piece for piece, _ in found):
            theirs[c] = sign
        for c in regex.findall(kind, every):
            ours[c] = sign
    lines = "\n".join(every)
    lowered = zip(NORMAL.normalize_str(lines).split("\n"), plain_normal(lines).split("\n"), lines.split("\n"))
    apart = {c for a, b, c in lowered if a != b} | {c for c in every if theirs.get(c) != ours.get(c)}
    return "".join(c + theirs.get(c, "§") for c in sorted(apart) if c)


class WordBpe:
    """Encoder and decoder of a tokenizers file: word BPE over byte characters with a word-end suffix."""

    def __init__(self, path: str, differences: str | None = None, most_cached: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        differences = letter_differences() if differences is None else differences
        self.stand_ins = dict(zip(map(ord, differences[::2]), differences[1::2]))
        self.plain = frozenset(differences[::2]).isdisjoint
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.to_characters = dict(enumerate(byte_characters()))

        def marked(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) and len(token) > len(suffix) else token

        size = max([*vocab.values(), *self.special.values()]) + 1
        self.length = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        names = [""] * size
        ids = {}
        for token, i in (vocab | self.special).items():
            names[i] = token
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            word = marked(token)
            ids[word] = i
            self.length[i] = len(word)
            self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        for a, b in model["merges"]:
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.joined[x, y] = z
            self.left[z], self.right[z] = x, y
        self.shorter = [-1] * size
        for word, i in ids.items():
            self.shorter[i] = next((ids[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in ids), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        blob = [f"{n} ".encode() for n in names]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.most_cached = most_cached

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens a and b.

        Walks back through the merges that made both: the border falls if, at some stage, the
        tokens next to it would merge at a better rank than the one that ended that stage.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit, fits = a, b, 1 << 40, True
        while True:
            z = self.joined.get((x, y))
            if z is not None and z < limit:
                fits = False
                break
            back_left = x > y
            if back_left and self.left[x] == x:
                back_left = False
            elif not back_left and self.left[y] == y:
                back_left = True
            if back_left:
                if self.left[x] == x:
                    break
                limit, x = x, self.right[x]
            else:
                if self.left[y] == y:
                    break
                limit, y = y + 1, self.left[y]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word, given as byte characters closed by END."""
        n = len(word)
        longest, width = [-1] * n, [0] * n
        for end, (i, size) in self.automaton.iter(word):
            start = end - size + 1
            if size > width[start]:
                longest[start], width[start] = i, size
        alive = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if alive[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                alive[at] = False
                token = out.pop()
                at -= self.length[token]
        return out

    def encode_piece(self, piece: str) -> bytes:
        known = self.cache.get(piece)
        if known is None:
            word = piece.encode().decode("latin-1").translate(self.to_characters) + END
            known = np.array(self.encode_word(word), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.cache) >= self.most_cached:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.split_special.split(text) if "<|" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part and not part.isascii() and not self.plain(part):
                part = NORMAL.normalize_str(part)
                at = 0
                for piece in self.pieces(part.translate(self.stand_ins)):  # of the same lengths, space between left out
                    while part[at].isspace():
                        at += 1
                    out.append(self.encode_piece(part[at : at + len(piece)]))
                    at += len(piece)
            elif part:
                out.extend(map(self.encode_piece, self.pieces(part.lower() if part.isascii() else plain_normal(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Token strings joined by spaces, as a tokenizer without a decoder gives them."""
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        starts = self.offsets[i]
        sizes = self.offsets[i + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[places[:-1]].tobytes()


@lru_cache(maxsize=2)
def word_bpe(path: str, differences: str) -> WordBpe:
    return WordBpe(path, differences)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every text; no shuffle."""
    differences = letter_differences()

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        bpe = word_bpe(path, differences)
        for columns, texts in text_batches(batches):
            ids = [bpe.encode(t) for t in texts]
            yield {"doc_id": columns["doc_id"], "ids": ids, "decoded": [bpe.decode(i).decode() for i in ids]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encode_documents, made where the ids are, so that they never leave the worker."""
    differences = letter_differences()

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        bpe = word_bpe(path, differences)
        for columns, texts in text_batches(batches):
            ids = [bpe.encode(t) for t in texts]
            yield {
                "doc_id": columns["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids],
            }

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
