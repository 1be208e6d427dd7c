"""Token counts by offset-mapped attribution: a document is encoded once, and its tokens' character spans are joined to
the spans of its sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard.llm.bpe import encoder

RULES = ("first", "last", "largest", "share")


def attribute(begin: np.ndarray, stop: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (spans begin to stop) that each section (spans starts to ends, in order, not overlapping) gets.

    A token inside one section counts there. One that crosses a boundary goes to the first or last section that it
    touches, to the one with most of its characters (ties: the earlier), or is shared by characters. Tokens, or shares
    of them, outside all sections count nowhere; a token without characters goes with the section that holds its place."""
    out = np.zeros(len(starts))
    if not len(begin) or not len(starts):
        return out
    stop = np.maximum(stop, begin + 1)
    low = np.searchsorted(ends, begin, side="right")  # the first section that ends after the token's first character
    high = np.searchsorted(starts, stop, side="left")  # the first section that starts at or after the token's end
    one = (high - low == 1)
    if rule == "share":
        one &= (starts[np.minimum(low, len(starts) - 1)] <= begin) & (ends[np.minimum(low, len(ends) - 1)] >= stop)
    np.add.at(out, low[one], 1.0)
    for t in np.flatnonzero(~one & (high > low)):  # tokens at a boundary
        s = np.arange(low[t], high[t])
        part = np.minimum(ends[s], stop[t]) - np.maximum(starts[s], begin[t])
        s, part = s[part > 0], part[part > 0]
        if not len(s):
            continue
        if rule == "share":
            out[s] += part / (stop[t] - begin[t])
        else:
            out[s[0] if rule == "first" else s[-1] if rule == "last" else s[part.argmax()]] += 1
    return out


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a text's lines, each with the line break that ends it; an empty text has one empty section."""
    breaks = np.array([i + 1 for i in _find(text, "\n")], np.int64)
    starts = np.concatenate([[0], breaks]).astype(np.int64)
    ends = np.concatenate([breaks, [len(text)]]).astype(np.int64)
    keep = (ends > starts) | (np.arange(len(starts)) == 0) & (len(text) == 0)
    return starts[keep], ends[keep]


def _find(text: str, what: str) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def section_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", sections: str | None = None,
                   rule: str = "largest") -> DataFrame:
    """(doc_id, section, start, end, n_tokens): the tokens of each section of each whole text, which is encoded once.

    sections: an array column of structs (start, end) of character places, in order and not overlapping; by default the
    lines. `rule` allocates a token that crosses a boundary (see attribute). n_tokens is a double, whole unless the rule
    shares. A null or empty text has one empty section (0 to 0) without tokens, or the sections given, without tokens;
    null sections give no row. Spans past the text's end are cut there. Repeated rows give their rows again; an empty
    table gives none. A projection: no shuffle, whatever share of rows a key holds."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        *([F.col(sections).alias("sections")] if sections else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spans=True).encode
        for batch in batches:
            held, rows = [], 0
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                if sections:
                    spans = batch.column(2)[i].as_py() or []
                    starts = np.minimum([s["start"] for s in spans], len(t)).astype(np.int64)
                    ends = np.minimum([s["end"] for s in spans], len(t)).astype(np.int64)
                else:
                    starts, ends = line_sections(t)
                _, begin, stop = encode(t)
                got = attribute(begin, stop, starts, ends, rule)
                held.append((i, starts, ends, got))
                rows += len(starts)
                if rows > 50_000:
                    yield _rows(batch, held)
                    held, rows = [], 0
            if held:
                yield _rows(batch, held)

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens double")


def _rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    sizes = [len(s) for _, s, _, _ in held]
    which = np.repeat([i for i, *_ in held], sizes)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(which, pa.int64())), pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int64)),
         *[pa.array(np.concatenate([h[k] for h in held])) for k in (1, 2, 3)]], ["doc_id", "section", "start", "end", "n_tokens"])
