"""Byte-level BPE by speculation: longest matches proposed, adjacent pairs verified in arrays, the rest merged exactly."""

from __future__ import annotations

import heapq
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine; see the parameter ``vocabulary``.
VOCABULARY = os.environ.get("CORPUSLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: The public pattern that cuts a text into words before any merge; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 400_000
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary; ids(words) encodes words without special tokens."""

    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        plain = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        made = {a + b for a, b in merges}
        # a special token is in the vocabulary but no byte and made by no merge
        self.token = {raw: vocab[t] for t, raw in plain.items() if len(raw) == 1 or t in made}
        self.longest = max(map(len, self.token))
        size = max(vocab.values()) + 1
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        twice = []
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (r, z))
            if rank[z] >= 0:
                twice.append(z)
            else:
                left[z], right[z], rank[z] = x, y, r
        pairs = sorted((x << 32 | y, r) for (x, y), (r, _) in self.merge.items())
        self.keys, self.ranks = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.rank = rank
        self.ends, self.starts = self._spine(right), self._spine(left)
        self.sound = np.zeros(size, bool)
        self.sound[list(self.token.values())] = True
        made_ids = np.flatnonzero(rank >= 0)
        self.sound[made_ids] &= ~self.crossed(left[made_ids], right[made_ids], rank[made_ids])
        self.sound[twice] = False
        for z in made_ids[np.argsort(rank[made_ids])]:  # sound only if its parts are
            self.sound[z] &= self.sound[left[z]] and self.sound[right[z]]
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    @staticmethod
    def _spine(child: np.ndarray) -> np.ndarray:
        cols = [np.arange(len(child))]
        while (nxt := np.where(cols[-1] >= 0, child[cols[-1]], -1)).max() >= 0:
            cols.append(nxt)
        return np.stack(cols)

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether some merge of a rank under ``before`` joins the end of a with the start of b.

        While a and b form, what stands at a's end is a token of its right
        spine and at b's start one of b's left spine.  Two such tokens merge
        across the border if their merge comes before either is taken up by its
        own parent; with equal ranks the leftmost pair goes first, so a's own
        merge precedes the crossing one and that precedes b's.
        """
        bad = np.zeros(len(a), bool)
        for i in range(len(self.ends)):
            r = self.ends[i][a]
            limit_a = self.rank[self.ends[i - 1][a]] if i else np.full(len(a), _NEVER)
            for j in range(len(self.starts)):
                s = self.starts[j][b]
                rows = np.flatnonzero((r >= 0) & (s >= 0) & ~bad)
                if not len(rows):
                    break
                key = r[rows] << 32 | s[rows]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                m = np.where(self.keys[at] == key, self.ranks[at], _NEVER)
                limit_b = self.rank[self.starts[j - 1][b[rows]]] if j else np.full(len(rows), _NEVER - 1)
                until = before[rows] if isinstance(before, np.ndarray) else before
                bad[rows] = (m < limit_a[rows]) & (m <= limit_b) & (m < until)
        return bad

    def propose(self, word: bytes) -> list[int]:
        out, at, n, token = [], 0, len(word), self.token
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = token.get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def exact(self, word: bytes) -> list[int]:
        """The merges one by one, by rank and then from the left."""
        ids = [self.token[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(m[0], i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (m := self.merge.get((x, y)))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.merge[x, y][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode new words into self.words."""
        raw = [w.encode("utf-8", "replace") for w in words]
        guess = [[t] if (t := self.token.get(w)) is not None else self.propose(w) for w in raw]
        lens = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(words)), lens)
        fails = np.zeros(len(words), bool)
        fails[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, inverse = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        if len(pairs):
            bad = self.crossed(pairs >> 32, pairs & 0xFFFFFFFF)
            fails[owner[inner[bad[inverse]]]] = True
        for i in np.flatnonzero(fails):
            guess[i] = self.exact(raw[i])
        self.words.update(zip(words, map(tuple, guess)))

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encode new pieces, each with a blank before it, into self.pieces."""
        words = [self.split(" " + p) for p in pieces]
        new = list({w for ws in words for w in ws} - self.words.keys())
        if new:
            self.learn(new)
        get = self.words.__getitem__
        for p, ws in zip(pieces, words):
            self.pieces[p] = tuple(chain.from_iterable(map(get, ws)))

    def plain(self, text: str) -> tuple[int, ...]:
        words = self.split(text)
        new = [w for w in set(words) if w not in self.words]
        if new:
            self.learn(new)
        return tuple(chain.from_iterable(map(self.words.__getitem__, words)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); a null or empty text has no ids.

        Between single blanks the pattern cuts before the blank, so a piece
        that neither starts nor ends with white space has its own ids, which
        are kept; runs of other pieces are encoded with the next such piece.
        """
        if len(self.words) + len(self.pieces) > _CACHE:
            self.words.clear()
            self.pieces.clear()
        cut = [("x " + t).split(" ")[1:] if t else [] for t in texts]
        new = set().union(*cut) - self.pieces.keys()
        new = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        for i in range(0, len(new), 50_000):
            self.learn_pieces(new[i : i + 50_000])
        parts, lens = [], []
        for t, pieces in zip(texts, cut):
            found = list(map(self.pieces.get, pieces))
            if pieces:
                found[0] = None  # no blank stands before it
            if None in found:
                run: list[str] = []
                for i, f in enumerate(found):
                    if f is None:
                        run.append(pieces[i])
                        found[i] = ()
                        if i or pieces[0] not in self.pieces:
                            continue
                    elif run:
                        run.append(pieces[i])
                    if run:
                        found[i] = self.plain(("" if i + 1 == len(run) else " ") + " ".join(run))
                        run = []
                if run:
                    found.append(self.plain(("" if len(run) == len(pieces) else " ") + " ".join(run)))
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            parts.append(ids)
            lens.append(len(ids))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)


@lru_cache(4)
def bpe(path: str) -> Bpe:
    """The vocabulary, read once a worker; a missing default file is looked up in the installed package of vocabularies."""
    if not os.path.exists(path) and path == VOCABULARY:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Bpe(path)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; null and empty texts have an empty list.

    A string that looks like a special token is ordinary text.  Rows keep
    their number: repeated keys and null keys come out as they went in.
    """

    def run(batches):
        model = bpe(vocabulary)
        for b in batches:
            ids, offsets = model.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def sized(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids of the text."""
    out = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches):
        model = bpe(vocabulary)
        for b in batches:
            _, offsets = model.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets).astype(np.int64))], names=[*keep, "n_tokens"])

    return out.mapInArrow(run, schema)
