"""Quality rules, line first: lines are cleaned by rules of their own, then whole texts judged by what is left.

A line fails if it is navigation (mostly separators, or a short run of links or
menu words), boilerplate (a phrase of ``BOILERPLATE`` in a line of at most ``FRAME_WORDS`` words), shouting (mostly capitals),
symbol noise, or prose whose sentences don't end; a repeat of an earlier line
fails too.  A document is rejected when failed lines hold more than ``MAX_LOST``
percent of its word characters, or by the base rules (too few words, too many words
in repeated 8-word windows).  ``assess`` gives the verdicts, ``clean`` the texts that are left.

Defined cases: null and empty texts have no words and fail by length; lines
without words neither fail nor count; rows that repeat are judged each by itself; an empty
table gives no rows; further columns, clashing names included, are ignored by
``assess`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mix, numbered, plain, ship, word_hashes

WINDOW, MIN_WORDS, MAX_REPEAT, MAX_LOST = 8, 20, 30, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A line without terminal punctuation fails unless it has a sentence's end for so many words.
WORDS_A_SENTENCE = 40
# Phrases of lines that are part of a page's frame, lower case, in the languages of the web's largest parts.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "click here", "share this", "skip to content", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "newsletter abonnieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "haga clic aquí", "ir al contenido",
)
#: Longer lines are text that mentions such a phrase.
FRAME_WORDS = 15
#: Ends of prose lines.
TERMINAL = regex.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")
SEPARATORS = regex.compile(r"(?:^|\s)(?:[|»›/·•>]|::)(?=\s|$)")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text holds twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    acc = np.zeros(n, np.uint64)
    for k in range(window):
        acc += hashes[k : k + n] * _MIX[k]
    acc = mix(acc)
    order = np.argsort(acc, kind="stable")
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, if any."""
    size = sum(map(len, words))
    if 4 * sum(line.count(c) for c in SYMBOLS) > len(words) and 20 * sum(line.count(c) for c in SYMBOLS) > size:
        return "navigation" if 3 * len(SEPARATORS.findall(line)) >= len(words) else "symbols"
    low = line.lower()
    if len(words) <= FRAME_WORDS and any(p in low for p in BOILERPLATE):
        return "boilerplate"
    letters = sum(map(str.isalpha, line)) if line.upper() == line or sum(map(str.isupper, line)) * 2 > len(line) else 0
    if letters > 10 and 2 * sum(map(str.isupper, line)) > letters:
        return "shouting"
    if not TERMINAL.search(line.rstrip(SPACES)):
        if len(words) < 4:
            return "navigation"
        # Prose that breaks off is no reason: only lines whose sentences never end fail.
        ended = sum(w[-1:] in b".!?:;" for w in words)
        return None if WORDS_A_SENTENCE * ended >= len(words) else "punctuation"
    return None


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_percent)."""
    text = text or ""
    h = word_hashes(text.encode("utf-8", "replace"))
    n = len(h)
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    duplicates = failed = lost = 0
    for line in text.split("\n"):
        ws = line.encode("utf-8", "replace").split()
        if not ws:
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or line_fails(line, ws):
            failed += 1
            lost += len(line) - sum(map(line.count, SPACES))
    repeats = repeat_words(h)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    kept = not base and 100 * lost <= MAX_LOST * chars
    return n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, base, kept, failed, 100.0 * lost / chars if chars else 0.0


FIELDS = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_failed_lines", "bigint"), ("lost_percent", "double"))
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [judge(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[k] for g in got], _ARROW[kind]) for k, (_, kind) in enumerate(FIELDS)]], ["doc_id", *[f for f, _ in FIELDS]])


def assess(docs: DataFrame) -> DataFrame:
    """One row (doc_id and ``FIELDS``) for each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(_judge, "doc_id bigint, " + ", ".join(f"{f} {kind}" for f, kind in FIELDS))


def clean_lines(text: str | None) -> str:
    """A text without the lines that fail."""
    seen: set[str] = set()
    out = []
    for line in (text or "").split("\n"):
        ws = line.encode("utf-8", "replace").split()
        if ws and (line in seen or line_fails(line, ws)):
            continue
        seen.add(line)
        out.append(line)
    return "\n".join(out)


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines that fail, n_chars (if there) counted anew; one pass, no shuffle."""
    ship(docs.sparkSession)
    frame, names = numbered(docs)
    at, count = int(names["text"][1:]), int(names.get("n_chars", "_-1")[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([judge(t.as_py())[6] for t in b.column(at)], pa.bool_()))
            texts = [clean_lines(t.as_py()) for t in b.column(at)]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b if count < 0 else b.set_column(count, b.schema.field(count), pa.array(map(len, texts), b.schema.field(count).type))

    return frame.mapInArrow(run, frame.schema).toDF(*docs.columns)
