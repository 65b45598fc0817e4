"""Byte-level BPE as a streaming transducer with bounded lookahead.

The encoding of a byte string by merge rules has one last token for each of its prefixes, and that token follows from the
prefixes before it: it is the one token that ends there and may stand after the last token of the prefix it leaves. So the
transducer keeps, for the positions of a window, the last token of the prefix that ends there. Tokens form a tree of paths
back from those positions; what all paths of the window share can't change any more, whatever follows, and is emitted. What
lies further back than the merge list's sufficient lookahead can't change either, so the window stays bounded.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.session import spread

#: Folder of the tokenizer files and name of the vocabulary; both are parameters of every function that uses them.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# The pre-tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one step over a text, and of a run from which it goes to the transducer piece by piece.
BLOCK = 1 << 16
RUN = 1 << 12
#: Pre-tokens kept with their ids, per Python worker.
CACHE = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: visible Latin-1 letters stand for themselves, the other bytes
    follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    return table | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Vocabulary:
    """Tokens, merge rules and what the transducer needs to know about them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rule = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(rules)}
        #: rank of the rule that makes a token and its two parts; single bytes have neither
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(rules):
            self.rank.setdefault(vocab[a + b], r)
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        as_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.bytes_of = {i: b for i, b in as_bytes.items() if len(b) == 1 or i in self.rank}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.longest = max(map(len, self.id_of))
        self._pairs: dict[tuple[int, int], bool] = {}

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a border from which on nothing that follows can move it: the sufficient lookahead of the merge list.

        Two texts that differ from some byte on are merged alike to its left until a rule joins the leftmost token that differs
        with the one before it, or doesn't. reach[t] is how many bytes the difference can still travel to the left from a
        leftmost differing token t: a rule (p, t) carries it over p, after which p or p + t is the leftmost; a rule (t, q) makes
        t + q the leftmost; each needs a later rule than the one before, as of equal rules the left one goes first. So one pass
        over the rules from the last to the first gives the greatest reach, and that from a single byte is the answer.
        """
        reach = dict.fromkeys(self.bytes_of, 0)
        rules = sorted(((rank, p, q) for (p, q), rank in self.rule.items()), reverse=True)
        for _, p, q in rules:
            whole = self.id_of.get(self.bytes_of[p] + self.bytes_of[q])
            grown = reach[whole] if whole is not None else 0
            carried = len(self.bytes_of[p]) + max(reach[p], grown)
            reach[p] = max(reach[p], grown)
            reach[q] = max(reach[q], carried)
        return max(r for t, r in reach.items() if len(self.bytes_of[t]) == 1)

    def may_follow(self, a: int, b: int) -> bool:
        """True if the encoding of bytes(a) + bytes(b) is [a, b]."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= 4 * CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self._border_lasts(a, b)
        return known

    def _border_lasts(self, x: int, y: int) -> bool:
        """Goes back in time from the tokens at both sides of a border, undoing the later rule first.

        While x and y stood side by side, a rule for (x, y) would have been applied if it came before the rule that merged x
        away to its left, and not after the one that merged y away to its right (of equal rules the left one goes first).
        """
        never = len(self.rule)
        x_gone = y_gone = never
        while True:
            across = self.rule.get((x, y), never)
            if across < never and across < x_gone and across <= y_gone:
                return False
            made_x, made_y = self.rank.get(x, -1), self.rank.get(y, -1)
            if made_x > made_y:
                x_gone, x = made_x, self.parts[x][1]
            elif made_y >= 0:
                y_gone, y = made_y, self.parts[y][0]
            else:
                return True


class Transducer:
    """Encodes one pre-token that is fed in pieces; holds a window of positions, not the bytes before it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.window = b""
        self.last: list[int] = []  # last token of the prefix that ends after each byte of the window
        self.before: int | None = None  # token emitted just before the window

    def _advance(self, data: bytes) -> None:
        id_of, may_follow, longest, last = self.v.id_of, self.v.may_follow, self.v.longest, self.last
        self.window = text = self.window + data
        for end in range(len(last) + 1, len(text) + 1):
            for begin in range(max(0, end - longest), end):
                token = id_of.get(text[begin:end])
                if token is None:
                    continue
                left = last[begin - 1] if begin else self.before
                if left is None or may_follow(left, token):
                    last.append(token)
                    break

    def _path(self, end: int) -> list[tuple[int, int]]:
        """(begin, token) of the tokens of the prefix of this length, from its end back to the window's begin."""
        path = []
        while end > 0:
            token = self.last[end - 1]
            end -= len(self.v.bytes_of[token])
            path.append((end, token))
        return path

    def feed(self, data: bytes) -> list[int]:
        """Ids that are stable once data has been seen."""
        out: list[int] = []
        step = 4 * self.v.longest
        for at in range(0, len(data), step):
            self._advance(data[at : at + step])
            out += self._emit()
        return out

    def _emit(self) -> list[int]:
        """Tokens up to the last border that can't move: the last one all paths share, or that with the lookahead behind it. The
        second keeps the window within the lookahead and a few tokens, whatever the text is."""
        n = len(self.window)
        # the next token may begin after any of the last bytes, or where the window does if it is short
        shared: set[int] = set(range(1, n + 1)) if n >= self.v.longest else set()
        for end in range(max(1, n - self.v.longest + 1), n + 1):
            shared &= {end, *(begin for begin, _ in self._path(end))}
        if n > self.v.lookahead:
            shared |= {begin for begin, _ in self._path(n) if 0 < begin <= n - self.v.lookahead}
        if not shared:
            return []
        border = max(shared)
        tokens = [token for _, token in self._path(border)][::-1]
        self.before, self.window, self.last = tokens[-1], self.window[border:], self.last[border:]
        return tokens

    def finish(self) -> list[int]:
        """The ids of what is left; the next piece begins a new pre-token."""
        tokens = [token for _, token in self._path(len(self.window))][::-1]
        self._clear()
        return tokens


_PRE = regex.compile(PATTERN)
_RUNS = {"letter": regex.compile(r" ?\p{L}+"), "number": regex.compile(r" ?\p{N}+"), "other": regex.compile(r" ?[^\s\p{L}\p{N}]+"), "space": regex.compile(r"\s+")}
_MORE = {"letter": regex.compile(r"\p{L}*"), "number": regex.compile(r"\p{N}*"), "other": regex.compile(r"[^\s\p{L}\p{N}]*"), "space": regex.compile(r"\s*")}


class Encoder:
    """Text in pieces to ids. Memory is bounded: a pre-token that grows beyond RUN goes to the transducer as it comes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.transducer = Transducer(vocabulary)
        self.known: dict[str, list[int]] = {}
        self.held, self.run = "", None

    def _piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            data = text.encode("utf-8", "replace")
            ids = self.transducer.feed(data) if len(data) > RUN else self.transducer._advance(data) or []
            ids = ids + self.transducer.finish()
            if len(text) <= 32:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def _in_run(self, final: bool) -> list[int]:
        """Feeds the part of the held text that belongs to the open run; closes it where it ends."""
        end = _MORE[self.run].match(self.held).end()
        over = final or end < len(self.held)
        if self.run == "space" and not (final and end == len(self.held)):
            end = max(0, end - 1)  # the last space goes with what follows
        out = self.transducer.feed(self.held[:end].encode("utf-8", "replace"))
        self.held = self.held[end:]
        if over:
            self.run = None
            out += self.transducer.finish()
        return out

    def feed(self, text: str, final: bool = False) -> list[int]:
        self.held += text
        out: list[int] = []
        if self.run:
            out += self._in_run(final)
            if self.run:
                return out
        # a match is final if at least three characters follow it: the longest contraction has three
        sure, start = (len(self.held) if final else len(self.held) - 3), 0
        for m in _PRE.finditer(self.held):
            if m.end() > sure:
                break
            out += self._piece(m.group())
            start = m.end()
        self.held = self.held[start:]
        if not final and len(self.held) > RUN:
            for name, pattern in _RUNS.items():
                if (m := pattern.match(self.held)) and m.end() == len(self.held):
                    self.run = name
                    keep = 1 if name == "space" else 0
                    end = len(self.held) - keep
                    out += self.transducer.feed(self.held[:end].encode("utf-8", "replace"))
                    self.held = self.held[end:]
                    break
        return out

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; [] for the empty text and for None."""
        if not text:
            return []
        out: list[int] = []
        for at in range(0, len(text), BLOCK):
            out += self.feed(text[at : at + BLOCK], at + BLOCK >= len(text))
        return out


class Decoder:
    """Ids in pieces to text; bytes of a character that isn't complete wait in the decoder's state."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, final: bool = False) -> str:
        return self.state.decode(b"".join(self.v.bytes_of[i] for i in ids), final)


@lru_cache(4)
def load(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, one per Python worker; of the file that was sent where the folder isn't there."""
    path = os.path.join(folder, name + ".json")
    return Encoder(Vocabulary(path if os.path.exists(path) else SparkFiles.get(name + ".json")))


_sent: set[tuple[str, str]] = set()


def _send(folder: str, name: str) -> None:
    """Sends the vocabulary file from the driver to all executors, once per application."""
    context = SparkSession.active().sparkContext
    path = os.path.join(folder, name + ".json")
    if (context.applicationId, path) not in _sent:
        context.addFile(path)
        _sent.add((context.applicationId, path))


def token_ids(text: Column, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Column:
    """array<int> of the ids; the empty array for null and empty text. No special token is ever made: their strings in a
    text are ordinary text. Text is processed whole, whatever its length."""

    _send(folder, name)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(folder, name)
        for texts in batches:
            yield pd.Series([np.array(encoder.encode(t), np.int32) for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Column:
    """bigint number of ids; 0 for null and empty text."""

    _send(folder, name)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(folder, name)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) for t in texts], dtype="int64")

    return count(text)


def decoded(ids: Column, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Column:
    """Text of an array of ids; null for null."""

    _send(folder, name)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load(folder, name).v
        for arrays in batches:
            yield pd.Series([None if a is None else Decoder(vocabulary).feed(a, True) for a in arrays], dtype=object)

    return decode(ids)


def encoded_corpus(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids), one row per row of documents."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), folder, name).alias("ids"))


def round_trip(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): every text decoded from its ids; the empty text for null."""
    return encoded_corpus(documents, folder, name).select("doc_id", decoded(F.col("ids"), folder, name).alias("text"))
