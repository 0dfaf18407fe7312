"""Secret scans: fixed rules, and automata inferred from what the rules label, which score every candidate by its format."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import cut, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the automata are asked about: runs of credential characters from letter or digit to letter or digit, as long as the shortest example of any kind.
RUN = r"[A-Za-z0-9][A-Za-z0-9+/_.-]{%d,}[A-Za-z0-9]"
SHORTEST = 12
#: Most examples of a kind, and most runs that no rule labels, that automata are inferred from: the distinct ones whose hashes are lowest, of at
#: most LONGEST characters. A kind with fewer than FEWEST examples has no automaton.
EXAMPLES, OTHERS, LONGEST, FEWEST = 300, 2000, 256, 10


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed rules, by start, then kind as listed. The minimum lengths stand in the patterns of access
    and hex, whose shorter matches hold no longer ones."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def free_runs(text: str, base: list[tuple[int, int, str, str]], pattern: re.Pattern) -> Iterator[re.Match]:
    """Runs that touch no base span; both come by start and are walked side by side."""
    edges: list[list[int]] = []
    for a, b, *_ in base:
        if edges and a <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], b)
        else:
            edges.append([a, b])
    i = 0
    for m in pattern.finditer(text):
        while i < len(edges) and edges[i][1] <= m.start():
            i += 1
        if i == len(edges) or m.end() <= edges[i][0]:
            yield m


class Formats:
    """An automaton of each kind that has examples, one of the runs that no rule labels, and the score from which a run is of a kind's format.

    A run's score for a kind is the log of how much likelier the kind's automaton makes it than the other runs' does, a character. The
    threshold is half of what all but 2 in 100 examples reach, and what 2 in 100 of the unlabelled runs at most pass: some of those may be secrets themselves.
    """

    def __init__(self, examples: dict[str, list[str]], others: list[str], share: float = 0.02):
        self.automata: dict[str, Automaton] = {}
        self.least: dict[str, float] = {}
        known = {k: sorted(v) for k, v in examples.items() if len(v) >= FEWEST}
        self.others = Automaton(sorted(others))
        self.pattern = re.compile(RUN % (min((len(s) for v in known.values() for s in v), default=SHORTEST) - 2))
        for kind, strings in known.items():
            self.automata[kind] = Automaton(strings)
            reached = sorted(self.score(kind, s) for s in strings)[int(share * len(strings))]
            self.least[kind] = max([0.5 * reached, 0.0, *sorted(self.score(kind, s) for s in others)[: math.ceil((1 - share) * len(others))][-1:]])

    def score(self, kind: str, s: str) -> float:
        return (self.automata[kind].score(s) - self.others.score(s)) / (len(s) + 1)

    def best(self, s: str) -> tuple[str | None, float | None]:
        """The kind of the highest score of those whose thresholds the run passes, and that score; None for none."""
        fits = [(v, kind) for kind in self.automata if (v := self.score(kind, s)) > self.least[kind]]
        return max(fits)[::-1] if fits else (None, None)

    def found(self, text: str, base: list[tuple[int, int, str, str]]) -> list[tuple]:
        """(start, end, kind, format, score) of base spans and, with kind 'format', of runs that touch none and are of some kind's format, by start, then kind as listed."""
        out = [(a, b, kind, *self.best(s)) for a, b, kind, s in base]
        if self.automata:
            for m in free_runs(text, base, self.pattern):
                kind, score = self.best(m[0])
                if kind:
                    out.append((*m.span(), "format", kind, score))
        return sorted(out, key=lambda x: (x[0], (*KINDS, "format").index(x[2])))


def lowest(values: dict[str, set[str]]) -> list[tuple[str, int, str]]:
    """(kind, hash, value) of as many values of each kind as automata learn from, those of the lowest hashes."""
    out = []
    for kind, some in values.items():
        at = sorted((xxhash.xxh3_64_intdigest(v) >> 1, v) for v in some if len(v) <= LONGEST)
        out += [(kind, h, v) for h, v in at[: OTHERS if kind == "other" else EXAMPLES]]
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, found, an array of (kind, start, end, format, score) in code points, end exclusive, by start.

    kind is assign, access or hex for the fixed rules, format for what the inferred automata add. format names the kind whose automaton the
    span fits best and score says by how much (see Formats); both are null for a base span that fits none. Automata are inferred from EXAMPLES distinct
    credentials of each kind at most, of all those the rules label in the whole table, and OTHERS runs at most that no rule labels; a kind of fewer than
    FEWEST examples has none. Null and empty texts have nothing; repeated rows are each scanned; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pattern = re.compile(RUN % (SHORTEST - 2))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lowest of each task's batches; the lowest of all are among them."""
        held: list[tuple[str, int, str]] = []
        for pdf in batches:
            seen: dict[str, set[str]] = {k: set() for k in (*KINDS, "other")}
            for kind, _, v in held:
                seen[kind].add(v)
            for t in pdf.text:
                base = base_spans(t)
                for _, _, k, v in base:
                    seen[k].add(v)
                seen["other"].update(m[0] for m in free_runs(t, base, pattern))
            held = lowest(seen)
        yield pd.DataFrame(held, columns=["kind", "h", "value"])

    known = cut(texts.select("text").mapInPandas(labelled, "kind string, h long, value string").distinct())
    rows = {k: known.where(F.col("kind") == k).orderBy("h", "value").limit(OTHERS if k == "other" else EXAMPLES).select("value").collect() for k in (*KINDS, "other")}
    formats = Formats({k: [r.value for r in rows[k]] for k in KINDS}, [r.value for r in rows["other"]])
    sent = spark.sparkContext.broadcast(formats)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("start", "end", "kind", "format", "score")
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "found": [[dict(zip(names, x)) for x in sent.value.found(t, base_spans(t))] for t in pdf.text]})

    return texts.mapInPandas(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int,format:string,score:double>>")
