"""BPE encoding and decoding by a traversal of a trie of distinct words.

The tokenizer file gives the normalizer, the splitting into words, the
vocabulary and the merges (of a word's end marked by a suffix, or of none).  Encoding itself works on a trie of the distinct
words: for every prefix there is exactly one *last token* in its encoding, and
it follows from the last tokens of shorter prefixes (the token t that ends here
and may stand after the last token of what lies before t).  A depth-first walk
hands these states down, so a prefix shared by many words is encoded once; a
word's tokens are read off backwards from its end.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_texts, table, texts

# Texts whose distinct words share a trie.
TEXTS = 1024

# Characters at which the tokenizer's normalizer splits (Unicode White_Space).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space of str.split() alone.
ODD = re.compile("[\x1c-\x1f]")
# The splitting rule of the file, and what it is for chunks of printable ASCII and
# Latin letters, which need no normalizing but lower case.
CLIP_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
PLAIN_RULE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
SHORT = (2, 1)  # lengths of tokens to look for at the very start of a word

# What a worker remembers: chunks up to so many characters, and so many bytes of
# them and their ids.  Text without blanks is one chunk, long and seldom repeated.
LONG = 100
HELD = 64 << 20


class TrieBpe:
    """Encoder and decoder of one tokenizer file; ``most`` chunks of ``held`` bytes bound what it remembers."""

    def __init__(self, path: str, most: int = 400_000, held: int = HELD):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)  # for its normalizer and word splitting
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.blank = re.compile(f"[{BLANK}]+")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = bool(steps) and steps[0].get("pattern", {}).get("Regex") == CLIP_RULE
        bodies = [t.removesuffix(self.end) for t in self.ids]
        # lengths that tokens with a given ending have, longest first
        sizes: dict[str, set[int]] = {}
        for body in bodies:
            sizes.setdefault(body[-3:], set()).add(len(body))
        self.sizes = {end: tuple(sorted(s.union(SHORT), reverse=True)) for end, s in sizes.items() if len(end) == 3}
        split = self.library.pre_tokenizer.pre_tokenize_str
        # letters beyond ASCII as the symbols of their bytes
        self.symbol_of = {k: split(chr(k))[0][0] for k in range(0xDF, 0x180) if self.plain and chr(k).isalpha()}
        self.most, self.most_held, self.held = most, held, 0
        self.known: dict[str, bytes] = {}  # chunk between blanks -> its ids, 4 bytes each
        self.fits: dict[tuple[str, str], bool] = {}  # may the second token stand after the first
        self.parts = {a + b: (a, b) for a, b in reversed(pairs)}
        self.wholes: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The merges applied to symbols, lowest rank first, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: str) -> bool:
        """Whether the merges make this very token of its own symbols."""
        known = self.wholes.get(token)
        if known is None:
            known = self.wholes[token] = self.merged(self.symbols(token)) == [token]
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at a token's left (0) or right (1) edge while it is built, and the rank that takes each in."""
        pieces = self.edges[side].get(token)
        if pieces is None:
            pieces, piece = [(token, len(self.ranks))], token
            while piece in self.parts:
                pair = self.parts[piece]
                piece = pair[side]
                pieces.append((piece, self.ranks[pair]))
            self.edges[side][token] = pieces
        return pieces

    def follows(self, before: str, token: str) -> bool:
        """Whether token may stand after the token before ("": at the start) in an encoding.

        It may unless a merge of a piece at the end of one with a piece at the
        start of the other comes before the merges that take these pieces in;
        of equal merges the left one comes first.
        """
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            known = self.whole(token) and not any(
                rank < left_until and rank <= right_until
                for left, left_until in (self.edge(before, 1) if before else ())
                for right, right_until in self.edge(token, 0)
                if (rank := self.ranks.get((left, right))) is not None
            )
            self.fits[before, token] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, a string of byte-level symbols.

        The trie is kept as its words in order: that is its depth-first order,
        and a word leaves the path of the one before it where they differ.
        """
        out: dict[str, list[int]] = {}
        ids, sizes, fits, follows = self.ids, self.sizes, self.fits, self.follows
        states = [""]  # last token of the encoding of each prefix on the path from the root
        before = ""
        for word in sorted(words):
            shared, length = 0, len(word)
            most = min(len(states), length) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, length + 1):
                tail = self.end if end == length else ""
                for size in sizes.get(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                    if size <= end and (token := word[end - size : end] + tail) in ids:
                        fit = fits.get((states[end - size], token))
                        if fit or fit is None and follows(states[end - size], token):
                            states.append(token)
                            break
                else:
                    raise ValueError(f"no token ends the symbols {word[:end]!r}")
            token = states.pop()  # with the mark of a word's end: no prefix of another word
            found, at = [ids[token]], length - len(token.removesuffix(self.end))
            while at > 0:
                token = states[at]
                found.append(ids[token])
                at -= len(token)
            out[word] = found[::-1]
            before = word
        return out

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk as the tokenizer splits it, in byte-level symbols."""
        if self.plain and PLAIN.fullmatch(chunk):
            words = PLAIN_RULE.findall(chunk.lower())
            return words if chunk.isascii() else [word.translate(self.symbol_of) for word in words]
        clean = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks not seen before; their distinct words share one trie."""
        split = {chunk: self.split(chunk) for chunk in chunks}
        words = self.encode_words({w for words in split.values() for w in words})
        words = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in words.items()}
        for chunk, parts in split.items():
            ids = self.known[chunk] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])
            self.held += len(chunk) + len(ids)

    def trim(self, chunks: Iterable[str]) -> None:
        """Forget long ones of these chunks, and all chunks once they are too many."""
        for chunk in chunks:
            if len(chunk) > LONG and chunk in self.known:
                self.held -= len(chunk) + len(self.known.pop(chunk))
        if len(self.known) > self.most or self.held > self.most_held:
            self.known.clear()
            self.held = 0

    def chunks(self, text: str) -> list[str]:
        if ODD.search(text):
            return [c for c in self.blank.split(text) if c]
        return text.split()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out = []
        for start in range(0, len(batch), TEXTS):
            parted = [self.cut.split(t) if self.special and any(s in t for s in self.special) else [t] for t in batch[start : start + TEXTS]]
            pieces = [[self.chunks(p) if k % 2 == 0 else p for k, p in enumerate(parts)] for parts in parted]
            seen: set[str] = set()
            for parts in pieces:
                seen.update(*(p for p in parts if isinstance(p, list)))
            self.learn(seen - self.known.keys())
            for parts in pieces:
                ids = []
                for p in parts:
                    ids += map(self.known.__getitem__, p) if isinstance(p, list) else [np.array([self.special[p]], "<u4").tobytes()]
                out.append(b"".join(ids))
            self.trim(seen)
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks: what a tokenizer file without a decoder stands for."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as an array of ints, decoded text) of every row.

    A NULL text counts as empty; an empty one has no ids and decodes to "".
    Repeated rows and rows without an id are encoded like any other.  Other
    columns are ignored.  The tokenizer file must be readable on every host.
    """

    def make():
        bpe = encoder(tokenizer)

        def judge(batch):
            ids = bpe.encode(batch)
            return [np.frombuffer(x, "<u4").astype("int32") for x in ids], [bpe.decode(x) for x in ids]

        return judge

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    return map_texts(texts(docs, id_col, text_col), make, fields, TEXTS)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; cases as in encode_texts."""

    def make():
        bpe = encoder(tokenizer)

        def judge(batch):
            ids = bpe.encode(batch)
            return (
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            )

        return judge

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_texts(texts(docs, id_col, text_col), make, fields, TEXTS)


def encode_rows(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """(doc_id, *carry, ids, n_tokens, ids_sha256) of every row; ids as little-endian unsigned 32-bit integers.

    Cases as in encode_texts.
    """
    rows = docs.select(F.struct(*(column(c) for c in (id_col, *carry))).alias("id"), column(text_col).alias("text"))
    rows = texts(rows, "id", "text")

    def make():
        bpe = encoder(tokenizer)

        def judge(batch):
            ids = bpe.encode(batch)
            return ids, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids]

        return judge

    fields = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
    ]
    return map_texts(rows, make, fields, TEXTS).select("id.*", "ids", "n_tokens", "ids_sha256")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
