"""Subword ids in bulk: byte-level BPE, and BPE with word ends.

Byte-level BPE has a memory of the stretches between single spaces.

The vocabulary's split pattern never joins what a single space between two visible characters separates (the space goes with
what follows), so a text can be cut there and each stretch's ids remembered. A stretch that is not known yet is encoded by
the rank encoder where its ids provably equal the tokenizer file's (the file's merges are in id order), else by the file's
own tokenizer. Texts with other white space next to a space, or with the special token's string, go to the file's tokenizer whole.

A vocabulary with word ends drops white space and never joins what it separates, so texts are cut at all of it. The stretches of
a batch that are not known go to the file's tokenizer together, with a mark between them.
"""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stretches remembered in a worker, at most.
STRETCHES = 250_000
#: The same where the file's tokenizer is all there is for a stretch that is not known.
WORDS = 600_000
_ODD_SPACE = re.compile(r"\s \s*|^\s| \s|\s$")


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(text): the bytes of the text's ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said.get("added_tokens", ())]
        self.ranks = self._ranks(said)
        self.known: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _ranks(self, said: dict):
        """The rank encoder, if the file is plain byte-level BPE whose merges are in the order of their ids."""
        import public_tokenizers
        import tiktoken

        model, names = said["model"], _byte_names()
        pre = said.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or said.get("normalizer"):
            return None
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [vocabulary.get("".join(m)) for m in pairs] != list(range(256, 256 + len(pairs))) or len(vocabulary) != 256 + len(pairs):
            return None
        ranks = {bytes(names[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.ranks.encode_ordinary(text)).tobytes()

    def _stretch(self, word: str) -> bytes:
        """The ids of a space and word."""
        found = self.known.get(word)
        if found is None:
            if self.ranks is not None and word.isalpha():
                found = array.array("I", self.ranks.encode_single_piece((" " + word).encode())).tobytes()
            elif self.ranks is not None and word[-1:] in (",", ".") and word[:-1].isalpha():
                found = self._stretch(word[:-1]) + self._stretch_end(word[-1])
            else:
                found = self._encode(" " + word)
            if len(self.known) < STRETCHES:
                self.known[word] = found
        return found

    def _stretch_end(self, mark: str) -> bytes:
        if mark not in self.ends:
            self.ends[mark] = self._encode(mark)
        return self.ends[mark]

    def ids_many(self, texts: list[str | None]) -> list[bytes]:
        return [self.ids(t or "") for t in texts]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self._encode(text)
        first, *rest = text.split(" ")
        get, stretch = self.known.get, self._stretch
        return self._encode(first) + b"".join([get(w) or stretch(w) for w in rest])


class WordEncoder:
    """ids_many(texts), for a vocabulary whose words end in a suffix and whose file drops white space."""

    #: Stands between stretches; its byte is in no other character, so its id tells where one ends.
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.mark = self.whole.encode(self.MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Take up the ids of stretches that are not known. Those that can be told apart by the mark are encoded as one text."""
        plain = [w for w in new if self.MARK not in w] if len(self.mark) == 1 else []
        if plain:
            ids = np.array(self.whole.encode_batch_fast([f" {self.MARK} ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark[0])
            data, start = ids.tobytes(), 0
            for w, end in zip(plain, [*at.tolist(), len(ids)], strict=True):
                self.known[w] = data[4 * start : 4 * end]
                start = end + 1
        for w in new:
            if w not in self.known:
                self.known[w] = self._encode(w)

    def ids_many(self, texts: list[str | None]) -> list[bytes]:
        cut = [None if any(s in t for s in self.special) else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in (t or "" for t in texts)]
        known = self.known
        new = [w for w in set().union(*(c for c in cut if c)) if w not in known]
        self._learn(new)
        out = [self._encode(t) if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        for w in new[max(0, WORDS - len(known) + len(new)) :]:  # beyond the memory's bound
            del known[w]
        return out

    def ids(self, text: str) -> bytes:
        return self.ids_many([text])[0]


def encoder_of(path: str) -> Encoder | WordEncoder:
    with open(path, encoding="utf-8") as f:
        return WordEncoder(path) if json.load(f)["model"].get("end_of_word_suffix") else Encoder(path)
