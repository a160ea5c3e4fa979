"""Token ids of whole texts, by the tokenizers library, for a vocabulary whose pre-tokens end at white space.

A text's ids are its words' ids in order, and a word that ends in ASCII punctuation after a letter or digit is
two pre-tokens at least. A batch therefore encodes each distinct piece once and gathers ids with numpy; a
worker keeps the pieces it has met, up to a bound. Pieces of lower-case Latin letters are one pre-token each
and go straight to the vocabulary's merges; all others take the library's whole way, many joined into one call.
A vocabulary file that normalises or splits in another way (``goes_by_words``) takes whole texts to the library.
``encode_texts`` equals ``Tokenizer.encode`` on the texts; tests compare them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from candlewick.llm.words import chunks, lower_pieces

END_ID = 1
_SEPARATOR = "\x01"
_JOINED = 256
_KNOWN_MOST = 300_000
_CHUNK = 1 << 22
#: Letters that neither NFC nor lower-casing changes.
_SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# The steps of a vocabulary file under which words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARK = re.compile(r"<\|[a-z]+\|>")


def goes_by_words(steps: dict) -> bool:
    """Whether a vocabulary file (its JSON) lower-cases, ends pre-tokens at white space and has no other rule across words."""
    split, *level = (steps["pre_tokenizer"] or {}).get("pretokenizers", [None])
    kind = {"type": "Split", "pattern": {"Regex": _WORD}, "behavior": "Removed", "invert": True}
    bytes_only = len(level) == 1 and level[0]["type"] == "ByteLevel" and not level[0]["add_prefix_space"] and not level[0]["use_regex"]
    marks = all(_MARK.fullmatch(t["content"]) and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in steps["added_tokens"])
    plain = not any(steps[k] for k in ("post_processor", "truncation", "padding")) and not steps["model"].get("dropout")
    return steps["normalizer"] == _NORMALIZER and split == kind and bytes_only and marks and plain


class WordEncoder:
    """Encodes texts; ``known`` maps a word to its place among the ids met so far and is bounded by ``_KNOWN_MOST``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = goes_by_words(json.load(file))
        if not self.by_words:
            return
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([])
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.level = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.separator = self._ids([_SEPARATOR])[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.n = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        simple = [w for w in words if _SIMPLE.fullmatch(w)]
        rest = [w for w in words if not _SIMPLE.fullmatch(w)]
        plain = [w for w in rest if _SEPARATOR not in w]
        odd = [w for w in rest if _SEPARATOR in w]
        lots = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        got = [np.array(x, np.int32) for x in self._ids([f" {_SEPARATOR} ".join(lot) for lot in lots])]
        merged = [e.ids for e in self.merger.encode_batch_fast([w.translate(self.level) for w in simple], add_special_tokens=False)]
        parts = [np.fromiter((i for ids in merged for i in ids), np.int32)]
        n = [(simple, np.fromiter(map(len, merged), np.int64, len(merged)))]
        separator = self.separator[0]
        for lot, ids in zip(lots, got, strict=True):
            cuts = np.flatnonzero(ids == separator)
            if len(cuts) != len(lot) - 1:
                odd += lot
                continue
            edges = np.concatenate([[-1], cuts, [len(ids)]])
            n.append((lot, np.diff(edges) - 1))
            parts.append(ids[ids != separator])
        for w, ids in zip(odd, self._ids(odd), strict=True):
            n.append(([w], np.array([len(ids)])))
            parts.append(np.array(ids, np.int32))
        ids, lengths = np.concatenate(parts), np.concatenate([x for _, x in n]).astype(np.int64)
        k = len(self.known)
        self.first, self.n = _room(self.first, k + len(lengths)), _room(self.n, k + len(lengths))
        self.ids = _room(self.ids, self.used + len(ids))
        self.n[k : k + len(lengths)] = lengths
        self.first[k : k + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        for lot, _ in n:
            for w in lot:
                self.known[w] = k
                k += 1

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and ``len + 1`` offsets; a null counts as empty."""
        parts, ends = [], [np.zeros(1, np.int64)]
        for _, _, data, docs in chunks(texts, _CHUNK):
            if not self.by_words:
                whole = self._ids([data[a:b].tobytes().decode() for a, b in zip(docs[:-1], docs[1:], strict=True)])
                parts.append(np.fromiter((i for ids in whole for i in ids), np.int32))
                ends.append(np.cumsum(list(map(len, whole))) + ends[-1][-1])
                continue
            pieces, first = lower_pieces(data, docs)
            ids, offsets = self._encode_pieces(pieces)
            parts.append(ids)
            ends.append(offsets[first[1:]] + ends[-1][-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate(ends)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = pieces.dictionary_encode()
        place, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        if len(self.known) > _KNOWN_MOST:
            self._forget()
        at = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        self._learn(words := [distinct[i] for i in new])
        at[new] = [self.known[w] for w in words]
        n = self.n[at][place]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        return self.ids[np.repeat(self.first[at][place] - ends[:-1], n) + np.arange(ends[-1])], ends


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if len(a) >= n:
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
