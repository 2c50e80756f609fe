"""Dense style features of whole texts for linear quality models, computed on the UTF-8 buffer."""

from __future__ import annotations

import numpy as np

from .common import Rolling, chunks, lower_ascii, mix, spans, utf8

_CLASSES = 12


def _class_table() -> np.ndarray:
    t = np.full(256, 10, np.int64)  # other punctuation and control characters
    t[97:123] = 0
    t[65:91] = 1
    t[48:58] = 2
    t[[32, 9, 11, 12, 13]] = 3
    t[10] = 4
    t[[44, 46]] = 5
    t[[33, 63]] = 6
    t[[ord(c) for c in "#*$%&<>"]] = 7
    t[124] = 8
    t[[39, 34, 45, 40, 41, 58, 59]] = 9
    t[128:] = 11
    return t


_CLASS = _class_table()
N_FEATURES = _CLASSES * _CLASSES + 10


def features(texts) -> np.ndarray:
    """(documents, N_FEATURES): square roots of the shares of byte-class pairs, then shares of repeats. Empty texts: zeros."""
    buf, off = utf8(texts)
    out = np.zeros((len(off) - 1, N_FEATURES), dtype=np.float32)
    for i, j in chunks(off):
        b, local = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(b):
            out[i:j] = _features(b, local)
    return out


def _features(b: np.ndarray, local: np.ndarray) -> np.ndarray:
    n = len(local) - 1
    size = np.diff(local)
    doc = np.repeat(np.arange(n), size)
    c = _CLASS[b]
    pair = c[:-1] * _CLASSES + c[1:]
    same = doc[:-1] == doc[1:]
    got = np.bincount(doc[:-1][same] * _CLASSES**2 + pair[same], minlength=n * _CLASSES**2).reshape(n, -1)
    pairs = np.sqrt(got / np.maximum(size - 1, 1)[:, None])

    st, en, words = spans(b, local)
    h = Rolling(lower_ascii(b)).of(st, en)
    wdoc = np.repeat(np.arange(n), words)
    w = np.maximum(words, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    order = np.lexsort((h, wdoc))
    seen = np.zeros(len(h), bool)
    seen[1:] = (h[order][1:] == h[order][:-1]) & (wdoc[order][1:] == wdoc[order][:-1])
    share = lambda x, d, by: np.bincount(d[x], minlength=n) / by
    repeated = share(seen, wdoc[order], w)
    # three-word windows found before in the text
    tri = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    ok = wdoc[:-2] == wdoc[2:] if len(h) > 2 else np.zeros(0, bool)
    tri, tdoc = tri[ok], wdoc[: len(tri)][ok]
    order = np.lexsort((tri, tdoc))
    tseen = np.zeros(len(tri), bool)
    tseen[1:] = (tri[order][1:] == tri[order][:-1]) & (tdoc[order][1:] == tdoc[order][:-1])
    chars = np.bincount(doc[(b & 0xC0) != 0x80], minlength=n)
    upper = np.bincount(doc[c == 1], minlength=n)
    newline = np.bincount(doc[c == 4], minlength=n)
    more = np.stack(
        [
            share(again, wdoc, w),
            repeated,
            repeated / np.log2(w + 2),
            share(tseen, tdoc[order], np.maximum(np.bincount(tdoc, minlength=n), 1)),
            np.log1p(words) / 10,
            chars / w / 10,
            np.sqrt(upper / np.maximum(chars, 1)),
            np.sqrt(newline / w),
            np.sqrt(np.bincount(doc[c == 7], minlength=n) / w),
            np.sqrt(np.bincount(doc[c == 8], minlength=n) / w),
        ],
        axis=1,
    )
    return np.concatenate([pairs, more], axis=1).astype(np.float32)
