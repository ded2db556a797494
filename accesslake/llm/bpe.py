"""BPE encoding and decoding by a trie of distinct words.

The encoding of a word is known from its last token and the encoding of what is left of it, so one token per prefix is enough.
Distinct words form a trie; a depth-first walk hands down the last token of every prefix, and prefixes that many words share
are computed once. A token may end a prefix if it can stand after the last token of what is left; that is worked out from the
merges, once for each pair of tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import give_back

#: Words remembered within a task, as well as steps of the trie's walk and pairs of tokens; emptied when full and at its end,
#: results do not depend on it.
CACHED_WORDS = 400_000
#: Longer words are not worth remembering.
LONG_WORD = 200
#: Texts are encoded in chunks of about so many characters, so that the memory of a batch does not grow with its texts.
CHUNK_CHARS = 1_000_000
#: Characters that every Unicode version normalises, lower-cases and classes alike; texts of these alone are split here.
_PLAIN = re.compile("[\\t\\n\\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u0130\u0132-\u017f\u2013\u2014\u2018-\u201e\u2026]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes words by the vocabulary, merges and word-end mark of a tokenizer file.

    A word is a string with one character for each byte; a final byte with the word-end mark has a character of its own.
    """

    def __init__(self, config: str):
        spec = json.loads(config)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.shift = 0x100 if end else 0

        def spelled(token: str) -> str:
            closed = bool(end) and token.endswith(end) and token != end
            codes = [byte_of[c] for c in (token[: -len(end)] if closed else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + self.shift * closed)

        spelling = {t: spelled(t) for t, i in model["vocab"].items() if i not in self.special.values()}
        self.ids = {spelling[t]: i for t, i in model["vocab"].items() if t in spelling}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.join: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (spelling[x] for x in (merge if isinstance(merge, list) else merge.split(" ", 1)))
            self.join[self.ids[left] << 20 | self.ids[right]] = rank
            made.setdefault(self.ids[left + right], (rank, self.ids[left], self.ids[right]))
        # the rank that makes a token, and the two that it is made of
        self.made = made
        self.pairs: dict[int, bool] = {}
        # what a path can still become: its longest end that begins a token, by number; and the tokens that end there, longest first
        self.starts = {"": 0}
        for token in self.ids:
            for n in range(1, len(token) + 1):
                self.starts.setdefault(token[:n], len(self.starts))
        self.start_names = list(self.starts)
        self.steps: dict[int, int] = {}
        self.ends: dict[int, tuple[tuple[int, int, int], ...]] = {0: ()}

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when one stands after the other.

        They do not if, at some rank, the tokens that then meet at the border merge before either is merged into its own token.
        Of equal merges the leftmost comes first, so the left token's own merge wins a tie and the right one's loses it.
        """
        join, made = self.join, self.made
        until_left = len(made) + 1
        while True:
            inner, until_inner = right, len(made) + 1
            while True:
                if (rank := join.get(left << 20 | inner)) is not None and rank < until_left and rank <= until_inner:
                    return False
                if inner not in made:
                    break
                until_inner, inner, _ = made[inner]
            if left not in made:
                return True
            until_left, _, left = made[left]

    def _step(self, state: int, code: int) -> int:
        """The state after one more symbol, kept with the tokens that end there: minus their sizes, as left halves of pairs, ids."""
        path = self.start_names[state] + chr(code)
        while path not in self.starts:
            path = path[1:]
        after = self.steps[state << 9 | code] = self.starts[path]
        if after not in self.ends:
            tokens = [self.ids[path[k:]] for k in range(len(path)) if path[k:] in self.ids]
            self.ends[after] = tuple([(-self.size[t], t << 20, t) for t in tokens])
        return after

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of distinct words (non-empty text without white space) as little-endian unsigned 32-bit integers.

        Sorted words are a trie in depth-first order: each shares with the one before it the path from the root down to where
        they part, and the last tokens of the prefixes on that path are kept. The last symbol of a word is always a leaf.
        """
        steps, step, ends, pairs, size_of, shift = self.steps, self._step, self.ends, self.pairs, self.size, self.shift
        # before the first symbol stands a token that is none; any token may follow it
        nothing = 0xFFFFF
        out: dict[str, bytes] = {}
        last, states = [nothing], [0]
        before = b""
        for word in sorted(words):
            path = word.encode()
            most = len(path) - 1
            depth, common = 0, min(most, len(states) - 1)
            while depth < common and path[depth] == before[depth]:
                depth += 1
            del last[depth + 1:], states[depth + 1:]
            state = states[depth]
            for code in (*path[depth:most], path[most] + shift):
                if (after := steps.get(state << 9 | code)) is None:
                    after = step(state, code)
                state = after
                for back, right, token in ends[state]:
                    left = last[back]
                    if (good := pairs.get(right | left)) is None:
                        good = pairs[right | left] = left == nothing or self.follows(left, token)
                    if good:
                        break
                else:
                    raise KeyError(f"{chr(code)!r} is not in the vocabulary")
                last.append(token)
                states.append(state)
            before = path
            ids, n = [], most + 1
            while n:
                token = last[n]
                ids.append(token)
                n -= size_of[token]
            ids.reverse()
            out[word] = struct.pack(f"<{len(ids)}I", *ids)
            last.pop()
            states.pop()
        return out

    def forget(self) -> None:
        """Empties what has grown large."""
        for grown in (self.pairs, self.steps):
            if len(grown) > CACHED_WORDS:
                grown.clear()


class TextCodec:
    """Splits whole texts into words as the tokenizer file asks, and turns words into ids and ids into text."""

    def __init__(self, config: str):
        spec = json.loads(config)
        self.config = config
        self.bpe = WordBpe(config)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the same classes, lower-cased, in the standard module's words: letters, digits, signs
        plain = sorted(set("".join(c for c in map(chr, range(0x3000)) if _PLAIN.fullmatch(c)).lower()))
        letters, digits = (re.escape("".join(filter(kind, plain))) for kind in (str.isalpha, str.isdigit))
        signs = re.escape("".join(c for c in plain if not (c.isalnum() or c.isspace())))
        self.plain_words = re.compile(
            split.replace(r"[^\s\p{L}\p{N}]", f"[{signs}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")).findall
        self.unbyte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.name_of = np.array([self.bpe.names.get(i) for i in range(max(self.bpe.names) + 1)], dtype=object)
        self.words: dict[str, bytes] = {}
        self.forget()

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The library's own steps before its model; many tasks never meet a text that needs them."""
        return Tokenizer.from_str(self.config)

    def forget(self) -> None:
        self.words = {t: i.to_bytes(4, "little") for t, i in self.bpe.special.items()}

    def split(self, text: str) -> list[str]:
        """The words of a text; the strings of special tokens are words of their own."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self.split_plain(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.split_plain(p))]

    def split_plain(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable() or _PLAIN.fullmatch(text):
            words = self.plain_words
            return [w for piece in text.lower().split() for w in ((piece,) if piece.isalpha() else words(piece))]
        # other characters: the library's own normal form and split
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.unbyte[c] for c in p).decode() for p, _ in parts]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and the text that they decode to."""
        split = [self.split(t) for t in texts]
        known = self.words
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > CACHED_WORDS:
            self.forget()
            known = self.words
            new = {w for words in split for w in words if w not in known}
        self.bpe.forget()
        known.update(self.bpe.encode_words(new))
        coded = [b"".join([known[w] for w in words]) for words in split]
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        return [(ids, " ".join(self.name_of[np.frombuffer(ids, "<u4")].tolist())) for ids in coded]

    def decode(self, ids: Iterable[int]) -> str:
        """What the ids stand for: their strings with spaces between, special ones included; unknown ids are left out."""
        names = self.bpe.names
        try:
            return " ".join([names[i] for i in ids])
        except KeyError:
            return " ".join([names[i] for i in ids if i in names])


_CODECS: dict[str, TextCodec] = {}


def codec(config: str) -> TextCodec:
    """One codec for each tokenizer file and worker."""
    key = hashlib.sha256(config.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = TextCodec(config)
    return _CODECS[key]


def _clash_free(df: DataFrame, *names: str) -> None:
    if clash := set(names) & set(df.columns):
        raise ValueError(f"the input already has columns {sorted(clash)}")


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
               digests: bool = False) -> DataFrame:
    """``docs`` with the token ids of every whole text; null texts count as empty and give no ids.

    ``ids`` is an array of int; ``decoded``, if named, holds the text that the ids decode to. With ``digests`` the ids are not
    carried: ``n_tokens``, ``ids_sha256`` (of little-endian unsigned 32-bit integers) and ``decoded_sha256`` are added instead.
    Every row comes out once, repeated rows too; other columns stay, and a clash of names is an error. Empty tables give empty
    tables. Rows are mapped in place without a shuffle; the vocabulary file is read on the driver and broadcast (a fixed file).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    fields = list(docs.schema.fields)
    if digests:
        new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
               T.StructField("decoded_sha256", T.StringType())]
    else:
        new = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
        new += [T.StructField(decoded, T.StringType())] if decoded else []
    _clash_free(docs, *(f.name for f in new))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(config.value)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text]]
            for start, stop in _chunks(texts):
                done = batch.iloc[start:stop].copy(deep=False)
                coded = c.encode_all(texts[start:stop])
                if digests:
                    done["n_tokens"] = [len(x) // 4 for x, _ in coded]
                    done["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x, _ in coded]
                    done["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for _, t in coded]
                else:
                    done[ids] = [np.frombuffer(x, "<u4").astype(np.int32) for x, _ in coded]
                    if decoded:
                        done[decoded] = [t for _, t in coded]
                yield done
        _CODECS.clear()  # workers live on; other jobs need their memory
        give_back()

    return docs.mapInPandas(run, T.StructType(fields + new))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_CHARS characters each, one text at least."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        if chars and chars + len(text) > CHUNK_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def bpe_decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids; null ids give null, no ids an empty text. Unknown ids are left out."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    _clash_free(docs, decoded)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(config.value)
        for batch in batches:
            yield batch.assign(**{decoded: [None if x is None else c.decode([int(i) for i in x]) for x in batch[ids]]})

    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField(decoded, T.StringType())]))
