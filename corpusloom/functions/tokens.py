"""Tokens and their counts over Arrow batches: a document's terms are counted where it lies, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_rows(texts: pa.Array, accents: bool = True, stop: Sequence[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """(tokens, row of each): lower-case runs of two or more letters, digits or underscores; a null text has none.

    accents: combining marks go after compatibility decomposition.  Tokens in
    ``stop`` are left out.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    t = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if accents:
        t = pc.replace_substring_regex(pc.utf8_normalize(t, "NFKD"), r"\p{M}+", "")
    lists = pc.split_pattern(pc.replace_substring_regex(t, r"[^\p{L}\p{N}_]+", " "), " ")
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    keep = pc.greater_equal(pc.utf8_length(flat), 2)
    if stop:
        keep = pc.and_(keep, pc.invert(pc.is_in(flat, pa.array(stop, flat.type))))
    return flat.filter(keep), row[keep.to_numpy(zero_copy_only=False)]


def pair_rows(flat: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pairs, row of each): neighbouring tokens of a row, joined by a blank."""
    at = np.flatnonzero(row[1:] == row[:-1])
    left, right = flat.take(pa.array(at)), flat.take(pa.array(at + 1))
    return pc.binary_join_element_wise(left, right, pa.scalar(" ", flat.type)), row[at]


def counted(flat: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count, terms): how often each row has each of the different terms."""
    d = flat.dictionary_encode()
    key, n = np.unique(row.astype(np.int64) << 32 | d.indices.to_numpy().astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n, d.dictionary


def term_counts(df: DataFrame, key: str, text: str, pairs: bool = False, accents: bool = True, stop: Sequence[str] = ()) -> DataFrame:
    """(key, term, tf, length) of every term of every row; length is the number of the row's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row = token_rows(b.column(1), accents, stop)
            length = np.bincount(row, minlength=b.num_rows)
            if pairs:
                two, at = pair_rows(flat, row)
                flat, row = pa.concat_arrays([flat, two]), np.concatenate([row, at])
            r, code, n, terms = counted(flat, row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(r)), terms.take(pa.array(code)).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(length[r].astype(np.int64))], names=[key, "term", "tf", "length"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, term string, tf bigint, length bigint")


def term_lists(df: DataFrame, key: str, text: str, accents: bool = True, stop: Sequence[str] = ()) -> DataFrame:
    """(key, terms, tf, length): one row a document, with its different terms and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row = token_rows(b.column(1), accents, stop)
            r, code, n, terms = counted(flat, row)
            offsets = pa.array(np.searchsorted(r, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (terms.take(pa.array(code)).cast(pa.string()), pa.array(n.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int64))], names=[key, "terms", "tf", "length"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, terms array<string>, tf array<bigint>, length bigint")
