"""Language-model scores: the marginal probability of a text over all its segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches, space_words

#: Words whose scores every task holds; those of all others come by a join.
FREQUENT = 100_000
#: Characters of a word whose arcs are held at a time.
BLOCK = 1 << 14
#: A word's pieces start with this mark.
MARK = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Natural-log probabilities of the pieces (by id), of bytes (ids too) and of the end; the recursions over a word's lattice."""

    def __init__(self, pieces: dict[str, int], byte_ids: list[int], logp: np.ndarray, end: float):
        self.pieces, self.byte_ids, self.logp, self.end = pieces, byte_ids, logp.tolist(), end
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.longest = max(map(len, pieces), default=1)
        self._found = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_found": None}

    def arcs(self, s: str, lo: int, hi: int) -> list[tuple[int, int, float, int | tuple]]:
        """(start, end, log probability, piece) of all pieces in the marked word s that end after lo, by hi at most; by end. Every character has an
        arc of its own: one that is no piece itself can only be spelled in bytes, and its arc has all of them."""
        if self._found is None:  # once a process
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for p, i in self.pieces.items():
                self._found.add_word(p, (len(p) - 1, self.logp[i], i))
            if self.pieces:
                self._found.make_automaton()
        a = max(0, lo + 1 - self.longest)
        if not self.pieces:
            out = []
        elif a == lo:
            out = [(a + e - n, a + e + 1, p, i) for e, (n, p, i) in self._found.iter(s[a:hi])]
        else:
            out = [(a + e - n, a + e + 1, p, i) for e, (n, p, i) in self._found.iter(s[a:hi]) if a + e >= lo]
        if strange := set(s[lo:hi]) - self.single:
            for i in range(lo, hi):
                if s[i] in strange:
                    b = tuple(self.byte_ids[x] for x in s[i].encode())
                    out.append((i, i + 1, sum(self.logp[x] for x in b), b))
            out.sort(key=lambda x: x[1])
        return out

    def _forward(self, s: str, arcs: list | None = None) -> array:
        """For each place in s the log of the sum over the segmentations up to it; of arcs only a block's are held. `arcs` are those of an s of one block, where they are known."""
        at = array("d", bytes(8 * (len(s) + 1)))
        for lo in range(0, len(s), BLOCK):
            now, into = lo, []
            for start, end, p, _ in self.arcs(s, lo, min(lo + BLOCK, len(s))) if arcs is None else arcs:
                if end != now:
                    if into:
                        at[now] = _log_sum(into)
                    now, into = end, []
                into.append(at[start] + p)
            at[now] = _log_sum(into)
        return at

    def word(self, word: str) -> float:
        """Log of the sum, over all segmentations of the marked word into pieces, of the product of their probabilities."""
        return self._forward(MARK + word)[-1]

    def expect(self, word: str, c: float, sums: list[float]) -> None:
        """Adds to sums, by id, c times how often each piece is expected in a segmentation of the word. Of a word of several blocks
        they are read again from the last; what comes after a place is held until the arcs that end there are done."""
        s = MARK + word
        exp, arcs = math.exp, self.arcs(s, 0, len(s)) if len(s) <= BLOCK else None
        before = self._forward(s, arcs)
        whole, after = before[-1], defaultdict(list, {len(s): [0.0]})
        for lo in reversed(range(0, len(s), BLOCK)):
            now, rest = -1, 0.0
            for start, end, p, i in reversed(self.arcs(s, lo, min(lo + BLOCK, len(s))) if arcs is None else arcs):
                if end != now:
                    now, rest = end, _log_sum(after.pop(end))
                after[start].append(rest + p)
                share = c * exp(before[start] + p + rest - whole)
                if isinstance(i, tuple):
                    for b in i:
                        sums[b] += share
                else:
                    sums[i] += share


def _log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    m = max(x)
    return m + math.log(sum([math.exp(v - m) for v in x]))


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, c (in training texts), c_all; counted a task first, all words of all texts. As many partitions as the session shuffles to: what
    follows costs by the word, not by the byte."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            return pd.DataFrame({"word": [w.decode(errors="replace") for w in every], "c": [train[w] for w in every], "c_all": list(every.values())})

        every, train = Counter(), Counter()
        for pdf in batches:
            for t, held in zip(pdf.text, pdf.held_out):
                w = space_words(t)
                every.update(w)
                if not held:
                    train.update(w)
                if len(every) > 1_000_000:
                    yield rows()
                    every, train = Counter(), Counter()
        if every:
            yield rows()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInPandas(count, "word string, c long, c_all long").repartition(parts, "word").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def vocabulary(path: str) -> tuple[dict[str, int], list[int], np.ndarray]:
    """Pieces by id, ids of bytes, and the probability of each id by the vocabulary's own scores. The file holds merge ranks and no log
    probabilities: a score -r ranks a piece, and its probability is taken as 1 / (r + 10), normalised, as frequency falls with rank. The last id is the end of a text."""
    sp = processor(path)
    size = sp.vocab_size()
    real = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i))]
    own = np.zeros(size + 1)
    own[real] = [1 / (max(0.0, -sp.get_score(i)) + 10) for i in real]
    own[size] = 1 / 10
    byte_ids = [-1] * 256
    for i in real:
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    return {sp.id_to_piece(i): i for i in real if not sp.is_byte(i)}, byte_ids, own / own.sum()


def fit(words: DataFrame, n_ends: int, path: str) -> Lattice:
    """Piece probabilities: expected counts over all segmentations of all training words, weighted by the vocabulary's own
    scores (forward and backward recursion, one step of expectation maximisation), on a prior of those scores worth one count a piece."""
    pieces, byte_ids, own = vocabulary(path)
    start = Lattice(pieces, byte_ids, np.log(np.maximum(own, 1e-300)), 0.0)
    sent = words.sparkSession.sparkContext.broadcast(start)
    size = len(own) - 1

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [0.0] * size
        for pdf in batches:
            for w, c in zip(pdf.word, pdf.c):
                sent.value.expect(w, c, sums)
        sums = np.array(sums)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"piece": at, "c": sums[at]})

    counts = np.zeros(size + 1)
    # as many rows as the vocabulary has pieces; summed in whole units of 2**-40, so that the order of tasks says nothing
    unit = float(1 << 40)
    for piece, c in words.where("c > 0").select("word", "c").mapInPandas(expected, "piece int, c double").groupBy("piece").agg(F.sum(F.round(F.col("c") * unit).cast("decimal(38,0)"))).collect():
        counts[piece] = float(c) / unit
    counts[size] = n_ends
    logp = np.log(np.maximum(counts + size * own, 1e-300)) - math.log(counts.sum() + size)
    return Lattice(pieces, byte_ids, logp, float(logp[size]))


def _frequent(words: DataFrame) -> DataFrame:
    """The words of the highest counts, FREQUENT at most: whole classes of counts, so that only a histogram and the words themselves are sent."""
    at = words.withColumn("level", F.floor(8 * F.log("c_all")).cast("int"))
    sizes = dict(at.groupBy("level").count().collect())  # a few hundred levels, however many words
    least, n = max(sizes, default=0) + 1, 0
    for level in sorted(sizes, reverse=True):
        n += sizes[level]
        if n > FREQUENT:
            break
        least = level
    return at.where(F.col("level") >= least)


def lm_scores(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words [^\\x20\\x09-\\x0D]+, A-Z in lower case, and one end. held_out rows (crc32 of the id as text mod 5 is 1; a null
    id is not) teach nothing. score: log10 of the text's probability, marginal over all segmentations of its words into pieces
    of the vocabulary, whose probabilities come from its own scores and the training texts; then the end. Words are
    independent given the pieces' marks, so the forward recursion runs once for each distinct word of the corpus; a row adds
    up its words. base_score: the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))). Null and empty texts are one end. Repeated rows count
    and are scored each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held.alias("held_out"))
    with scratch(spark) as s:
        counts = s.keep(_word_counts(texts), "counts")
        n_ends = texts.where("not held_out").count()
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
        n, v = n + n_ends, v + (n_ends > 0)
        log_all = math.log10(n + 0.5 * (v + 1))
        lattice = fit(counts, n_ends, tokenizer)
        sent = spark.sparkContext.broadcast(lattice)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(lm=[sent.value.word(w) for w in pdf.word])

        words = s.keep(counts.mapInPandas(score, "word string, c long, c_all long, lm double"), "words")
        top = _frequent(words).select("word", "c", "lm").collect()
        number = {r.word.encode(): i for i, r in enumerate(top)}
        c = np.array([r.c for r in top] + [0], np.float64)
        base = np.log10(c + 0.5) - log_all
        base[-1] = 0
        lm = np.array([r.lm for r in top] + [0.0]) / math.log(10)
        frequent = spark.sparkContext.broadcast((number, base, lm, (c > 0).astype(np.int64)))

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, base, lm, known = frequent.value
            other = len(number)
            for pdf in batches:
                rows = []
                for t in pdf.text:
                    w = space_words(t)
                    i = np.fromiter((number.get(x, other) for x in w), np.int64, len(w))
                    rest = Counter(w[j] for j in np.flatnonzero(i == other))
                    rows.append((len(w), known[i].sum(), base[i].sum(), lm[i].sum(), [{"word": x.decode(errors="replace"), "n": m} for x, m in rest.items()]))
                out = pdf[["doc_id", "held_out"]].copy()
                out["n"], out["known"], out["base"], out["lm"], out["rest"] = zip(*rows) if rows else ([],) * 5
                yield out

        part = texts.mapInPandas(add_up, "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", held_out boolean, n long, known long, base double, lm double, rest array<struct<word:string,n:long>>")
        part = s.keep(part.withColumn("row", F.monotonically_increasing_id()), "part")
        rest = part.select("row", F.inline("rest")).join(words.select("word", "c", F.col("lm").alias("wlm")), "word").groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rknown"),
            F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - log_all)).alias("rbase"),
            F.sum(F.col("n") * F.col("wlm")).alias("rlm"),
        )
        zero = lambda name: F.coalesce(F.col(name), F.lit(0))
        return cut(part.drop("rest").join(rest, "row", "left").select(
            "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + zero("rknown") + int(n_ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + zero("rbase") + (math.log10(n_ends + 0.5) - log_all)).alias("base_score"),
            (F.col("lm") + zero("rlm") / math.log(10) + lattice.end / math.log(10)).alias("score"),
        ))
