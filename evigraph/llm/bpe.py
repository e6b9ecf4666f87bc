"""BPE encoding and decoding with a public word-end vocabulary.

Method: each pre-token is a doubly linked list of symbols; a priority queue holds (merge rank, position) of adjacent
pairs. The lowest rank, leftmost first, is popped; an entry whose pair has changed since is stale and skipped. Decoding
joins the vocabulary's strings.

Rows: a null text counts as empty and gives no ids and an empty decoding; a null id stays null; repeated rows give repeated
results; of pairs of one rank the leftmost merges first; texts are taken whole, whatever their length; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from evigraph.llm.common import arrow_stage

#: Words whose ids a worker keeps; beyond that the store is emptied, so that memory stays bounded.
KEPT_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _finders(pieces: str):
    """The vocabulary's pattern for texts within Latin-1, with its classes spelled out for speed, and for all texts.

    Letters and numbers are those of the Unicode version of the tokenizers library, whose results are to be equalled; the
    regex module knows some later ones, which are left out here. Only the library's character classes are asked.
    """
    latin = {kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    spaces = "".join(re.escape(chr(c)) for c in range(256) if regex.match(r"\p{White_Space}", chr(c)))
    first = re.compile(pieces.replace(r"\p{L}", latin["L"]).replace(r"\p{N}", latin["N"]).replace(r"\s", spaces))
    later = "".join(chr(c) for c in range(256, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    spans: list[list[int]] = []
    later = "".join(regex.findall(r"[\p{L}\p{N}]", later))
    known = {piece for piece, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(later)}
    for c in (ord(c) for c in later if c not in known):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    new = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    text = pieces.replace(r"\s", r"\p{White_Space}").replace(r"[\p{L}]", f"[\\p{{L}}--[{new}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{new}]]") if new else pieces
    text = text.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]||[{new}]]") if new else text
    return first.findall, regex.compile(text, regex.V1).findall


@lru_cache(maxsize=1)
def _later_capitals() -> dict[int, str]:
    """Letters that Python's tables do not know, and the library lower-cases: code point -> small letter."""
    later = "".join(chr(c) for c in range(256, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    small = normalizers.Lowercase().normalize_str(later)
    if len(small) != len(later):
        raise ValueError("a letter's lower case is longer than one letter")
    return {ord(a): b for a, b in zip(later, small, strict=True) if a != b}


class WordBpe(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; unseen ones are merged on demand."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.spaced = [s.encode() + b" " for s in self.strings]
        chars = byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + end] for c in chars]
        #: left id -> right id -> rank, from 1 on; rank -> id of the merged symbol
        none: dict[int, int] = {}
        self.rights = [none] * len(self.strings)
        self.merged = [-1]
        for rank, (a, b) in enumerate(map(tuple, model["merges"]), 1):
            left = vocab[a]
            if self.rights[left] is none:
                self.rights[left] = {}
            self.rights[left][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.strings))]
        pieces = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find_latin, self.find_any = _finders(pieces)
        self.later = _later_capitals()
        self.find_later = re.compile("[" + "".join(map(chr, self.later)) + "]" if self.later else r"(?!)").search
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = self.ids(word)
        return ids

    def ids(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.merge(word.encode("utf-8", "surrogatepass"))])

    def merge(self, word: bytes) -> list[int]:
        last = len(word) - 1
        inner = self.inner
        symbol = [inner[b] for b in word]
        symbol[last] = self.final[word[last]]
        if not last:
            return symbol
        rights, merged = self.rights, self.merged
        queue = [rank << 32 | i for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (rank := rights[a].get(b))]
        if not queue:
            return symbol
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j > last or symbol[i] < 0:
                continue
            rank = entry >> 32
            if rights[symbol[i]].get(symbol[j]) != rank:
                continue  # stale: one of the two symbols has been merged since
            new = symbol[i] = merged[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if rank := rights[new].get(symbol[k]):
                    push(queue, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rights[symbol[h]].get(new)):
                push(queue, rank << 32 | h)
        return [s for s in symbol if s >= 0]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens: NFC, lower case character by character, then the pattern."""
        if text.isascii():
            return self.find_latin(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # str.lower() would turn a final one into another letter
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text.translate(self.later) if self.find_later(text) else text)
        return self.find_latin(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return b"".join(map(self.__getitem__, self.words(text)))
        out = []
        for k, part in enumerate(self.parts(text)):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else b"".join(map(self.__getitem__, self.words(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.spaced.__getitem__, np.frombuffer(ids, "<u4").tolist()))[:-1].decode()


class LibraryBpe(WordBpe):
    """The same pre-tokens and store; the tokenizers library's own model merges unseen ones. For operators that only need ids.

    A full store becomes the older half and a new one begins, so that words in use are not merged again: KEPT_WORDS in all.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = dict(enumerate(byte_characters()))
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS // 2:
            self.older = dict(self)
            self.clear()
        ids = self[word] = self.older.get(word) or self.ids(word)
        return ids

    def merge(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


@lru_cache(maxsize=2)
def load_library(path: str) -> LibraryBpe:
    """One per worker process."""
    return LibraryBpe(path)


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string), in one pass over the text."""

    def rows(batches):
        bpe = load(vocabulary)
        for b in batches:
            for key, text in zip(b["k"], b["t"], strict=True):
                ids = bpe.encode(text)
                yield key, ids, bpe.decode(ids)

    source = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return arrow_stage(source, f"`{id_col}` long, ids binary, decoded string", rows)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, default_vocabulary()).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
