"""Benchmark decontamination: an FM-index per shard of the training texts, searched backward for the benchmark's windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .fm_index import FMIndex

#: Words of 0-9, a-z and all beyond ASCII, A-Z in lower case; in UTF-8 every byte from 0x80 is part of a word.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words that a shard's index holds at least, and characters of benchmark texts that one pass over the documents searches for at most.
SHARD_WORDS, BLOCK_CHARS = 1 << 18, 16_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class Windows:
    """The distinct windows of some items, held as places in one sequence of word numbers (from 1; 0 is no word): window i has the `lengths[i]` numbers
    from `starts[i]`, and stands for the items numbered `item_of[first[i]:first[i + 1]]`, whose names are `names`."""

    def __init__(self, items: list[tuple], width: int):
        self.words: dict[bytes, int] = {}
        named: dict[str, int] = {}
        numbers, starts, lengths, owner, at = [], [], [], [], 0
        for item, text in items:
            w = np.fromiter((self.words.setdefault(x, len(self.words) + 1) for x in words_of(text)), np.int32)
            if len(w):
                n = max(1, len(w) - width + 1)
                starts.append(np.arange(at, at + n, dtype=np.int64))
                lengths.append(np.full(n, min(width, len(w)), np.int16))
                owner.append(np.full(n, named.setdefault(str(item), len(named)), np.int32))
                numbers.append(w)
                at += len(w)
        self.names = list(named)
        # words beyond the last are 0, so that a short item's window can be read at full width
        self.numbers = np.concatenate([*numbers, np.zeros(width, np.int32)])
        starts, lengths, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, owner))
        rows = np.zeros((len(starts), width), np.int32)
        for j in range(width):
            rows[:, j] = np.where(j < lengths, self.numbers[starts + j], 0)
        same = np.unique(rows.view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True) if len(rows) else (None, starts, starts)
        self.starts, self.lengths = starts[same[1]], lengths[same[1]].astype(np.int64)
        pairs = np.unique(same[2].astype(np.int64) * max(1, len(self.names)) + owner)
        self.item_of = (pairs % max(1, len(self.names))).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.starts) + 1))
        self.shortest = int(self.lengths.min()) if len(self.starts) else width


def _spans_of_words(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """A text without its words in these spans of word numbers and what lies between them; the spans in code points."""
    at = [m.span() for m in _WORD.finditer(text)]
    cuts = [(at[a][0], at[b - 1][1]) for a, b in spans]
    out, end = [], 0
    for a, b in cuts:
        out.append(text[end:a])
        end = b
    return "".join([*out, text[end:]]), cuts


def search_shard(docs: list[list[bytes]], windows: Windows) -> list[tuple[np.ndarray | None, set[str]]]:
    """For each document of a shard its hit words (None: none) and the items found in it.

    Only runs of benchmark words at least as long as the shortest window can hold an occurrence, so the index is
    built over those, 0 between them.
    """
    get, parts, at_doc, at_word = windows.words.get, [], [], []
    for d, words in enumerate(docs):
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= windows.shortest:
                parts.append(np.append(ids[a:b], 0))
                at_doc.append(np.full(b - a + 1, d))
                at_word.append(np.arange(a, b + 1))
    out: list[tuple[np.ndarray | None, set[str]]] = [(None, set()) for _ in docs]
    if not parts:
        return out
    seq, at_doc, at_word = np.concatenate(parts), np.concatenate(at_doc), np.concatenate(at_word)
    index = FMIndex(seq, len(windows.words))
    low, high = index.search(windows.numbers, windows.starts, windows.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[which]
    place = index.locate(rows)
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.lengths[which], -1)
    hit = np.cumsum(cover)[:-1] > 0
    for d in np.unique(at_doc[hit]).tolist():
        mask = np.zeros(len(docs[d]), bool)
        a, b = np.searchsorted(at_doc, [d, d + 1])
        mask[at_word[a:b][hit[a:b]]] = True
        out[d] = (mask, set())
    pairs = np.unique(at_doc[place] * len(windows.lengths) + which)
    for d, w in zip((pairs // len(windows.lengths)).tolist(), (pairs % len(windows.lengths)).tolist()):
        out[d][1].update(windows.names[i] for i in windows.item_of[windows.first[w] : windows.first[w + 1]])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, the columns named in carry, n_words, n_hit, n_items, items (sorted as strings), contaminated,
    spans (of code points, merged), clean_text (the text without them).

    A window is `width` consecutive words of an item, or a shorter item whole; words inside any occurrence are hit.
    Null and empty texts have no words; items without words or with a null item_id or text have no windows. Repeated rows are each judged; a
    repeated item_id is one item with all its windows. The benchmark is a stated query set: up to BLOCK_CHARS of it are sent to the tasks at
    once, more goes in as many passes, each over what the one before has left to merge.
    """
    small_batches(docs.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + chars // BLOCK_CHARS
    df = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *carry)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry)]
    schema = ", ".join([*kept, "text binary, hits array<struct<a:int,b:int>>, items array<string>"])
    df = df.withColumns({"hits": F.lit(None).cast("array<struct<a:int,b:int>>"), "items": F.lit(None).cast("array<string>")})
    finish = ", ".join([*kept, "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, spans array<struct<start:int,end:int>>, clean_text string"])
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        windows = Windows([(r.item_id, bytes(r.text)) for r in own], width)
        sent = docs.sparkSession.sparkContext.broadcast(windows)
        last = b == blocks - 1
        df = df.mapInPandas(_pass(sent, ("doc_id", *carry), last), finish if last else schema)
        df = df if last else cut(df)
    return df


def _pass(sent, keep: tuple[str, ...], last: bool):
    """Adds what one block of windows hits to hits and items; the last pass gives the results."""

    def flush(held: list[pd.DataFrame], words: list[list[bytes]]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        hits, items = [], []
        for (mask, names), w, old, was in zip(search_shard(words, sent.value), words, pdf.hits, pdf["items"]):
            if old is not None and len(old):
                mask = np.zeros(len(w), bool) if mask is None else mask
                for x in old:
                    mask[x["a"] : x["b"]] = True
                names |= set(was)
            hits.append([] if mask is None else _spans_of_words(mask))
            items.append(sorted(names))
        out = pdf[[*keep]].copy()
        if not last:
            return out.assign(text=pdf.text, hits=[[{"a": a, "b": b} for a, b in h] for h in hits], items=items)
        texts = [t.decode(errors="replace") if t is not None else None for t in pdf.text]
        done = [_without(t, h) if h else (t, []) for t, h in zip(texts, hits)]
        out["n_words"] = [len(w) for w in words]
        out["n_hit"] = [sum(b - a for a, b in h) for h in hits]
        out["n_items"] = [len(i) for i in items]
        out["items"] = items
        out["contaminated"] = out.n_hit > 0
        out["spans"] = [[{"start": a, "end": b} for a, b in c] for _, c in done]
        out["clean_text"] = [t for t, _ in done]
        return out

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words, n = [], [], 0
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                held.append(pdf[i : i + 500])
                words += (w := [words_of(t) for t in held[-1].text])
                n += sum(map(len, w))
                if n >= SHARD_WORDS:
                    yield flush(held, words)
                    held, words, n = [], [], 0
        if held:
            yield flush(held, words)

    return search
