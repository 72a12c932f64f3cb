"""Word shingles of texts, hashed over whole Arrow batches.

Words are what lies between runs of Unicode white space of the lower-cased
text.  Shingles are hashed by prefix sums over the UTF-8 bytes, so the cost is
a few array operations a byte and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.functions.hashing import RangeHash, U, mix

WORDS = 5
_CHUNK = 1 << 19
_SEGMENT = 1 << 20
_BYTES = mix(np.arange(1, 257, dtype=U))
#: The shingle of a text without words, where short texts are shingles.
_NOTHING = U(0x2545F4914F6CDD1D)


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank, trimmed; null as the empty text."""
    return " ".join(text.lower().split()) if text else ""


def _hash_words(norms: list[bytes], k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(norms) + b" ", np.uint8)
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # a normalised text has single blanks only, and one was put behind each
    doc = np.repeat(np.arange(len(norms)), np.fromiter((b.count(b" ") + 1 for b in norms), np.int64, len(norms)))
    real = ends > starts
    starts, ends, doc = starts[real], ends[real], doc[real]
    m = max(len(starts) - k + 1, 0)
    same = doc[:m] == doc[k - 1 : k - 1 + m]
    first, last, owner = starts[:m][same], ends[k - 1 : k - 1 + m][same], doc[:m][same]
    hash_ = RangeHash(_BYTES[buf])
    if not short:
        return owner, hash_(first, last)
    n = np.bincount(doc, minlength=len(norms))
    few, at = np.flatnonzero((n < k) & (n > 0)), np.concatenate([[0], np.cumsum(n)])
    none = np.flatnonzero(n == 0)
    h = np.concatenate([hash_(first, last), hash_(starts[at[few]], ends[at[few + 1] - 1]), np.full(len(none), _NOTHING)])
    owner = np.concatenate([owner, few, none])
    o = np.argsort(owner, kind="stable")
    return owner[o], h[o]


def hashed(texts: list[str | None], k: int = WORDS, short: bool = False, clean: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, text number from lo, hash) of all shingles, some texts at a time; a longer text is hashed in segments.

    short: a text of fewer than k words is one shingle as a whole, the empty
    text too.  clean: texts are normalised already.
    """
    lo, size, group = 0, 0, []
    for i, t in enumerate(texts):
        b = ((t or "") if clean else normal(t)).encode()
        if len(b) > 16 * _CHUNK:
            if group:
                yield lo, i, *_hash_words(group, k, short)
            words = b.split(b" ")
            parts = [_hash_words([b" ".join(words[j : j + _SEGMENT + k - 1])], k)[1] for j in range(0, len(words), _SEGMENT)]
            h = np.concatenate(parts)
            yield i, i + 1, np.zeros(len(h), np.int64), h
            lo, size, group = i + 1, 0, []
            continue
        group.append(b)
        size += len(b)
        if size > _CHUNK:
            yield lo, i + 1, *_hash_words(group, k, short)
            lo, size, group = i + 1, 0, []
    if group:
        yield lo, len(texts), *_hash_words(group, k, short)


def ordered(doc: np.ndarray, h: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, hash) by doc, rank of the hash's bucket and hash; by doc and hash if rank is None."""
    q = rank[(h & U(len(rank) - 1)).astype(np.int64)].astype(U) if rank is not None else np.zeros(len(h), U)
    if len(doc) and doc[-1] >= 1 << 20:
        o = np.lexsort((h, q, doc))
        doc, h = doc[o], h[o]
    else:
        key = (doc.astype(U) << U(44)) | (q << U(36)) | (h >> U(28))
        o = np.argsort(key)
        doc2, h2, key = doc[o], h[o], key[o]
        if ((key[1:] == key[:-1]) & (h2[1:] != h2[:-1])).any():  # the 36 bits tie: sort by all of them
            o = np.lexsort((h, q, doc))
            doc2, h2 = doc[o], h[o]
        doc, h = doc2, h2
    if len(h):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
        doc, h = doc[new], h[new]
    return doc, h
