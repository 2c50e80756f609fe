"""Token ids of whole texts, equal to the tokenizers library's, at a speed a scan can bear.

The library's own pipeline takes about a microsecond a byte. Here its vocabulary and merges, read from the same file, drive a
faster merge engine; the library itself encodes every text with characters outside the common Latin blocks or with the
content of an added token, such as <|endoftext|> (that token's id, as in the library's own default), and the first text of
every batch again as a check: on any difference the whole batch goes to the library. Where the tokenizer drops white space,
a worker keeps the ids of the words it has met, and only new words are merged.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np

WORD_END = "</w>"
#: Characters of words whose ids a worker keeps; the store is emptied when full, so its memory is bounded.
KEPT = 1 << 21
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")
#: What the fast path isn't used for: anything but Latin letters and common punctuation, and the mark it uses itself.
_RARE = re.compile("[^\u0000\u0002-ɏ‐-‧‰-›]|[\u0085 ]")


def _word_split() -> re.Pattern:
    """The pattern of letters, single digits and others for the characters of the fast path, in lower case."""
    chars = {c for x in map(chr, range(0x2040)) if not _RARE.search(x) for c in x.lower()}
    letters = "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == "L")
    digits = "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == "N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ \t\n\v\f\r{letters}{digits}]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand = _byte_of()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.added = sorted(special)
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        self.by_word = model.get("end_of_word_suffix") == WORD_END
        if not self.by_word:
            ranks = {bytes(stand[c] for c in k): v for k, v in vocab.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=_BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.ids = None
        else:
            # a mark ends each word; joining it to the last byte comes before every merge
            def of(token: str) -> bytes:
                end = token.endswith(WORD_END)
                return bytes(stand[c] for c in token.removesuffix(WORD_END)) + b"\x01" * end

            merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            order = [bytes([b, 1]) for b in range(256) if b != 1] + [of(a + b) for a, b in merged]
            by_bytes = {of(k): v for k, v in vocab.items()}
            order = list(dict.fromkeys(x for x in order if x in by_bytes))
            ranks = {x: i for i, x in enumerate(order)}
            self.ids = np.zeros(len(order) + 256, dtype="<u4")
            self.last = np.zeros(len(order) + 256, dtype=bool)
            for x, i in ranks.items():
                self.ids[i] = by_bytes[x]
                self.last[i] = x.endswith(b"\x01")
            self.known: dict[str, bytes] = {}
            self.held = 0
            for b in range(256):
                if bytes([b]) not in ranks:
                    ranks[bytes([b])] = i = len(order) + b
                    self.ids[i] = by_bytes.get(bytes([b]), 0)
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
            self.split = _word_split()

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of the words not yet known."""
        new = [x for x in set(words) if x not in self.known]
        self.held += sum(map(len, new))
        if self.held > KEPT:
            self.known.clear()
            new = list(set(words))
            self.held = sum(map(len, new))
        got = np.asarray(self.fast.encode_to_numpy("\x01".join(new) + "\x01", disallowed_special=()))
        raw, cut = self.ids[got].tobytes(), [0, *(4 * np.flatnonzero(self.last[got]) + 4).tolist()]
        self.known.update(zip(new, [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))

    def _words(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.known.__getitem__, words))

    def raw(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if any(x in text for x in self.added) or (_RARE.search(text) if not text.isascii() else "\x01" in text):
            return self.by_library([text])[0].tobytes()
        if not self.by_word:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=())).astype("<u4").tobytes()
        if text.isascii():
            return self._words(_ASCII_SPLIT.findall(text.lower()))
        return self._words(self.split.findall(unicodedata.normalize("NFC", text).lower()))

    def raws(self, texts: list[str | None]) -> list[bytes]:
        out = [self.raw(x) for x in texts]
        if texts and out[0] != self.by_library([texts[0] or ""])[0].tobytes():
            return [x.tobytes() for x in self.by_library([x or "" for x in texts])]
        return out

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.raws(texts)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
