"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters of other
scripts, digits and symbols that stand for letters, everything else to spaces),
and searched with an Aho-Corasick automaton for lexicon entries that begin at a
word's start. Hits inside an exception phrase do not count. The weights of the
hits, as a sum and against the text's length, give the score.

The lexicon is learned from labelled rows: an entry is a word, or a word's
beginning, whose toxic and clean document counts differ beyond chance over all
candidates (log-likelihood ratio), weighted by its log odds. Exceptions are
phrases around hits that mostly clean documents have.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from boxwise.llm.common import text_or_empty, written

# Letters that look like Latin ones, and digits read as letters.
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
               "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n",
               "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a",
               "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l"}

SAMPLE_ROWS = 20_000   # labelled rows that the lexicon is fitted on, at most
MAX_ENTRIES = 20_000   # entries of the lexicon, at most; the strongest stay
SHORTEST, LONGEST = 3, 8  # lengths of word beginnings


class Folder:
    """Folds a text to words of letters parted by single spaces, with a space at
    either end."""

    def __init__(self):
        import re
        import unicodedata
        self.table = {ord(a): b for a, b in (LOOK_ALIKES | DIGITS).items()}
        self.normal = unicodedata.normalize
        self.symbol = re.compile(r"[@$!|](?=[^\W\d_])").sub
        self.other = re.compile(r"[\W\d_]+").sub

    def __call__(self, text: str) -> str:
        if not text.isascii():
            text = self.normal("NFKC", text)
        text = text.lower().translate(self.table)
        text = self.symbol(lambda m: SYMBOLS[m[0]], text)
        return self.other(" ", f" {text} ")


@dataclass
class Lexicon:
    """``entries``: ' word' (a beginning) or ' word ' (the whole word) to weight;
    ``exceptions``: phrases with a space at either end; ``model``: weights of
    (1, log of the sum, log of the sum per 100 words)."""
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    model: tuple[float, float, float] = (-2.0, 1.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.fold, self.model = Folder(), lexicon.model
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each word that an entry matches -> the greatest weight there."""
        found: dict[int, float] = {}
        if not self.ready:
            return found
        spared = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight <= 0:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return found

    def measure(self, text: str | None) -> tuple[float, float]:
        folded = self.fold(text or "")
        total = sum(self.hits(folded).values())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100.0 * total / words)

    def score(self, text: str | None) -> float:
        x, y = self.measure(text)
        a, b, c = self.model
        z = a + b * x + c * y
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


# --- fitting -----------------------------------------------------------------

def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is a multiple of 5 (a null id: true)."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _count_beginnings(frames: Iterator) -> Iterator:
    import pandas as pd
    fold, toxic, clean = Folder(), Counter(), Counter()

    def out():
        keys = list({*toxic, *clean})
        return pd.DataFrame({"entry": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})

    for frame in frames:
        for text, label in zip(frame["text"], frame["toxic"]):
            own = set()
            for w in set(fold(text).split()):
                own.add(f" {w} ")
                for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    own.add(f" {w[:n]}")
            (toxic if label else clean).update(own)
            if len(toxic) + len(clean) > 200_000:
                yield out()
                toxic.clear()
                clean.clear()
    if toxic or clean:
        yield out()


def _count_phrases(entries: dict[str, float]):
    """The matched word alone, and with the word before and after it."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        matcher = Matcher(Lexicon(entries))
        rows = []
        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"]):
                folded, own = matcher.fold(text), set()
                for start in matcher.hits(folded):
                    end = folded.index(" ", start + 1)
                    own.add(folded[start:end + 1])
                    if start > 0:
                        own.add(folded[folded.rindex(" ", 0, start):end + 1])
                    if end + 1 < len(folded):
                        own.add(folded[start:folded.index(" ", end + 1) + 1])
                rows += [(p, int(label), 1 - int(label)) for p in own]
        yield pd.DataFrame(rows, columns=["entry", "toxic", "clean"])
    return run


def _measures(lexicon: Lexicon):
    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        matcher = Matcher(lexicon)
        for frame in frames:
            both = [matcher.measure(t) for t in frame["text"]]
            yield pd.DataFrame({"x": [b[0] for b in both], "y": [b[1] for b in both], "toxic": frame["toxic"].to_numpy()})
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of at most about ``sample_rows`` labelled documents that are
    not held out, picked by a hash of the id. An id labelled twice is toxic if
    either label says so; null ids and labels are left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    known = known.select(F.col("doc_id").alias("__id__"), "toxic")
    # about sample_rows narrow rows at most, whatever the size of the tables
    return docs.select(F.col(id_col).alias("__doc__"), text_or_empty(text_col).alias("text")).join(
        F.broadcast(known), F.col("__doc__") == F.col("__id__")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Lexicon:
    """The lexicon. Without labelled rows of both kinds it has no entries."""
    rows = written(training_rows(docs, labels, sample_rows, id_col, text_col), "toxic-training")
    n = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, c = int(n.t or 0), int(n.n) - int(n.t or 0)
    if not t or not c:
        return Lexicon(model=(math.log((t + 0.5) / (c + 0.5)), 0.0, 0.0))
    counts = written(rows.mapInPandas(_count_beginnings, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 2"), "toxic-counts")
    odds = F.log(((F.col("t") + 0.5) / (t + 1)) / ((F.col("c") + 0.5) / (c + 1)))
    both = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") * (t + c) / (both * t))
                 + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") * (t + c) / (both * c))).otherwise(0))
    beyond = 2 * math.log(max(2, counts.count()))
    strong = counts.select("entry", "t", odds.alias("w"), ratio.alias("g")).where(
        (F.col("w") > math.log(8)) & (F.col("g") > beyond)).orderBy(F.desc("g"), "entry").limit(MAX_ENTRIES).collect()
    weights = {r.entry: float(r.w) for r in strong}
    # a beginning that goes on the same way in nearly all toxic documents is that longer one
    times = {r.entry: int(r.t) for r in strong}
    for entry in sorted(times, key=len):
        if entry[:-1] in times and not entry.endswith(" ") and times[entry] >= 0.9 * times[entry[:-1]]:
            weights.pop(entry[:-1], None)
    entries = {}
    for entry in sorted(weights, key=lambda e: (len(e.rstrip()), len(e))):  # a longer one must add something
        word = entry.rstrip()
        shorter = [entries[word[:k]] for k in range(SHORTEST + 1, len(word) + 1) if word[:k] in entries and word[:k] != entry]
        if not shorter or weights[entry] > max(shorter) + 0.5:
            entries[entry] = weights[entry]
    phrases = rows.mapInPandas(_count_phrases(entries), "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(
        (F.col("c") >= 3) & (F.col("t") * c < F.col("c") * t)).orderBy(F.desc("c"), "entry").limit(MAX_ENTRIES).collect()
    lexicon = Lexicon(entries, [r.entry for r in phrases])
    seen = rows.mapInPandas(_measures(lexicon), "x double, y double, toxic int").toPandas()  # of the sample
    x = np.column_stack([np.ones(len(seen)), seen["x"], seen["y"]])
    lexicon.model = tuple(float(v) for v in logistic(x, seen["toxic"].to_numpy(float)))
    return lexicon


def _shared(docs: DataFrame, lexicon: Lexicon):
    """The lexicon's plain content as a broadcast; its size is bounded by MAX_ENTRIES."""
    return docs.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, lexicon.model))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``. Null and
    empty texts get the score of a text without hits; an empty table gives none."""
    shared = _shared(docs, lexicon)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        matcher = Matcher(Lexicon(*shared.value))
        for batch in batches:
            scores = [matcher.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all columns."""
    shared = _shared(docs, lexicon)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        matcher = Matcher(Lexicon(*shared.value))
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
