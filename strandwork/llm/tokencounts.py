"""Token counts of the sections of a document, from one encoding of the whole text.

A document is encoded once; the running lengths of its tokens give their character
spans, which an interval join (binary search over the sections' bounds) attributes to
sections.  Sections are the lines or, with ``sections``, the fields whose ends an array column
gives in code points; a line break belongs to the line that it ends.  A token that crosses a boundary
counts for the section that holds its first character (``rule`` "first"), or its last
one ("last"), or by its characters in each ("share").  A token of a part of a character has
that character for its span.

Defined cases: null and empty texts have no token and one empty section, or the given
ones; ends are taken in order, ends beyond the text are its end, and what follows the last
one is a section more; a null array is one section; rows that
repeat are counted each by itself; null doc_ids stay null; an empty table gives no
rows; further columns, clashing names included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Tokenizer, tokenizer
from .common import plain, ship

RULES = ("first", "last", "share")


def line_ends(text: str) -> np.ndarray:
    """Code-point offsets at which the lines end, breaks included; the last line ends with the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(np.flatnonzero(code == 10) + 1, len(text))


def field_ends(text: str, ends: np.ndarray) -> np.ndarray:
    """Given offsets in order and within the text, and the text's end where they stop before it."""
    ends = np.sort(np.clip(ends, 0, len(text)))
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def token_spans(t: Tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points [start, end) of each token of a text."""
    ids = t.encode(text)
    stop = np.cumsum(t.lengths[ids].astype(np.int64))
    start = stop - t.lengths[ids]
    if text.isascii():
        return start, stop
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    opened = np.cumsum((raw & 0xC0) != 0x80)  # characters up to each byte
    return opened[start] - 1, opened[stop - 1]


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, for "share" parts of tokens, of each section; whether each token crosses a boundary)."""
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = first != last
    if rule != "share":
        return np.bincount(first if rule == "first" else last, minlength=len(ends)), crossing
    out = np.bincount(first[~crossing], minlength=len(ends)).astype(float)
    for k in np.flatnonzero(crossing):
        for s in range(first[k], last[k] + 1):
            low = max(start[k], ends[s - 1] if s else 0)
            out[s] += (min(stop[k], ends[s]) - low) / (stop[k] - start[k])
    return out, crossing


def section_tokens(t: Tokenizer, text: str | None, rule: str = "first", ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross a section's end); sections are the lines where ``ends`` is None."""
    text = text or ""
    return attribute(line_ends(text) if ends is None else field_ends(text, ends), *token_spans(t, text), rule)


def count(docs: DataFrame, path: str, pattern: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_sections, n_crossing, largest_section, section_tokens.

    ``sections`` names a column with an array of the code points at which the fields of the text end.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            ends = [None] * b.num_rows if sections is None else [np.array(x or [], np.int64) for x in b.column(2).to_pylist()]
            got = [section_tokens(t, x.as_py(), rule, e) for x, e in zip(b.column(1), ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(g[1]) for g in got], pa.int64()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([int(g[1].sum()) for g in got], pa.int64()), pa.array([float(g[0].max()) for g in got], pa.float64()), pa.array([g[0].astype(np.float64) for g in got], pa.list_(pa.float64()))],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "largest_section", "section_tokens"],
            )
        t.forget()

    ship(docs.sparkSession)
    return plain(docs, "doc_id", "text", *([] if sections is None else [sections])).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, largest_section double, section_tokens array<double>")
