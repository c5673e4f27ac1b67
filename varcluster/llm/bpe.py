"""BPE encoding by dynamic programming over prefixes, and decoding.

Text is cut into pieces as the tokenizer file says (a pattern, after special tokens are set apart), and each distinct
piece is encoded once a task. For every prefix of a piece exactly one token can be the last of its encoding: an
automaton of all tokens gives those that end there, and of these the last token is the one that starts the prefix or
that is compatible with the last token of the prefix before it. Two tokens are compatible if the merges, run on the
two together, leave them as they are. Back-pointers from the whole piece then give the exact ids, without running the
merges on it. Whole documents stay in their partition: nothing shuffles.

Nulls and edge cases: a null or empty text has no ids and decodes to the empty text; a null doc_id passes through;
repeated rows give repeated rows; very long texts are cut piece by piece; the caches of pieces and pairs are cleared at
a fixed number of bytes and at the end of a task, so memory is bounded; an empty table gives an empty result; further columns pass through the operators.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, released, table

#: Bytes of pieces of text with their ids, and of pairs of tokens, that a task remembers before it starts anew, and what
#: one of each takes in Python.
PIECES_BYTES, PAIRS_BYTES = 128 << 20, 48 << 20
PIECE_COST, PAIR_COST = 260, 240
#: The pattern of byte-level BPE; a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the pattern is run by the standard library, with its classes written out.
LATIN = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts without code points from LATIN on: \\p classes become lists, white space its Unicode list."""
    space = r"\t-\r\x20\x85\xa0"
    inside = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda _: f"[^{space}{_class('L')}{_class('N')}]", pattern)
    inside = re.sub(r"\[?\\p\{(L|N)\}\]?", lambda m: f"[{_class(m[1])}]", inside)
    return re.compile(inside.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell bytes as printable letters: themselves, or else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in spelled)
    return spelled | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBpe:
    """The encoder and decoder of a tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        self.vocab = spec["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.letters = byte_letters()
        bytes_of_letter = {c: b for b, c in self.letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(bytes_of_letter[c] for c in t) for t, i in self.vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.spelling = {i: t for t, i in self.vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if t not in self.special:
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.table = {b: c for b, c in self.letters.items()}
        self.any_text, self.latin_text = regex.compile(BYTE_LEVEL), latin_pattern(BYTE_LEVEL)
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.held = 0

    def merged(self, letters: str) -> list[str]:
        """The merges, run one by one: least rank first, leftmost first."""
        parts = list(letters)
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) * PAIR_COST >= PAIRS_BYTES:
                self.pairs.clear()
            x, y = self.spelling[a], self.spelling[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        letters = piece.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        token: list[int | None] = [None] * (len(letters) + 1)
        back = [0] * (len(letters) + 1)
        for end, (size, i) in self.automaton.iter(letters):
            end += 1
            if token[end] is None:
                start = end - size
                if start == 0 or (token[start] is not None and self.compatible(token[start], i)):
                    token[end], back[end] = i, start
        out, at = [], len(letters)
        while at:
            out.append(token[at])
            at = back[at]
        return tuple(out[::-1])

    def _encode_plain(self, text: str) -> list[int]:
        known = self.pieces
        parts = (self.any_text if self.beyond.search(text) else self.latin_text).findall(text)
        new = set(parts).difference(known)
        if new:
            cost = 9 * sum(map(len, new)) + PIECE_COST * len(new)
            if self.held + cost > PIECES_BYTES:
                known.clear()
                self.held, new = 0, set(parts)
            self.held += cost
            for p in new:
                known[p] = self.encode_piece(p)
        out = list(chain.from_iterable([known[p] for p in parts]))
        for p in new:
            if len(p) > 64:
                del known[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.apart is None or not self.apart.search(text):
            return self._encode_plain(text)
        out = []
        for i, part in enumerate(self.apart.split(text)):
            out += [self.special[part]] if i % 2 else self._encode_plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    """One encoder a task and file."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def forget() -> None:
    _loaded.clear()


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs with ids, an array of int. tokenizer_path: a file that every executor has."""
    name = free_name(docs, "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer_path)
        for batch in batches:
            yield batch.assign(**{name: [bpe.encode(t) for t in batch[text_col]]})

    return docs.mapInPandas(released(run, forget), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def bpe_decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded_text; null ids decode to the empty text."""
    name = free_name(rows, "decoded_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer_path)
        for batch in batches:
            yield batch.assign(**{name: ["" if ids is None else bpe.decode(ids) for ids in batch[ids_col]]})

    return rows.mapInPandas(released(run, forget), T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass, where only digests are wanted: ids and texts need not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        decimal = bpe.decimal
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run, forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_encode_decode(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("byte_bpe_50k.json"))
