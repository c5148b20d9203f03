"""Operator 5: toxicity by a weighted finite-state pattern grammar.

Words are read as symbols (insult, threat, target, negation, reported speech, other).  Five weighted transducers over these
symbols are composed into one arc table (``GRAMMAR``): the insult and the threat transducer each turn one such symbol of a clause
into a mark, the target transducer asks for a target before or behind the mark (a threat needs one), and those of
negation and reported speech lower a mark in their scope.  A clause's score is the weight of the best accepted path,
times the weight of the marked word.  So a bare insult, an insult at a target, a threat, a negated and a reported insult weigh
differently, and a clause without insult or threat weighs nothing.  A text's score is ``1 - prod(1 - clause score)``.

The insult lexicon is learned in Spark from labelled training texts: whole words and word stems whose
document frequency in toxic texts stands out.  It is read from at most ``SAMPLE`` distinct labelled texts and
holds every entry that passes the bounds below, which the size of that sample keeps few; without labels only the seeds
are left.  Typographic apostrophes count as plain ones, and a word with an apostrophe that is no symbol itself is read as
its parts, so ``l'idiot`` and ``idiot's`` hold an insult.

Defined results: null and empty texts score 0; repeated rows score alike; a text without a label, or a label without a
``doc_id``, is not learned from, and a row without a ``doc_id`` has a null ``held_out``; very long texts are read as a
whole, clause by clause; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import textscan as ts
from pagelake.llm.common import add_columns, fold, read, uniform
from pagelake.session import materialize

SAMPLE = 20_000
SUPPORT = 3            # toxic training texts that an entry occurs in, at least
PRECISION = 0.7        # share of toxic texts among those that hold a word
STEM_PRECISION = 0.88  # and among those that hold a stem
CONFIDENCE = 4.6       # an entry that is chance in one of 100 trainings (natural logarithm)
STEMS = (4, 5, 6)      # prefix lengths that may act as patterns
THRESHOLD = 0.3
HELD_OUT = 2

# Seed symbols by class.
SEEDS = {
    "insult": "idiot idiots moron morons stupid imbecile dumbass scumbag dummkopf arschloch idiota imbécil imbécile "
              "connard estúpido gilipollas crétin trottel",
    "threat": "kill murder strangle stab töten umbringen ermorden tuer étrangler poignarder matar asesinar apuñalar",
    "target": "you your youre he she they him her them du dich dir ihr euch sie tu te toi vous vos usted ustedes tú te "
              "ellos ellas ils elles",
    "negation": "not no never isn't aren't don't didn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás",
    "report": "said says told called claimed wrote quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice "
              "escribió llamó",
}
# Weights that the transducers pass on.
NEGATED, REPORTED, TARGETED, NEGATION_SCOPE = 0.55, 0.6, 1.2, 3

CLAUSE = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
APOSTROPHES = str.maketrans("\u2019\u02bc\uff07", "'''")
GAP = re.compile(r"[\W\d_]+")     # what no word holds, but for the apostrophe


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
MARKS = ("marked insult", "marked threat")


class Transducer:
    """Weighted arcs ``(state, symbol) -> [(next state, symbol passed on, weight)]``; state 0 is the first.  A symbol without
    arcs ends a path."""

    def __init__(self, arcs: dict, finals: set):
        self.arcs, self.finals = arcs, finals

    @classmethod
    def of(cls, states: int, finals: set, *special: tuple):
        """Every state passes symbols on unchanged and stays, but for ``special`` (state, symbol, arcs)."""
        arcs = {(state, symbol): [(state, symbol, 1.0)] for state in range(states) for symbol in SYMBOLS + MARKS}
        arcs.update({(state, symbol): to for state, symbol, to in special})
        return cls(arcs, finals)

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one passes on.  Only states that can be reached are kept."""
        number, arcs, queue = {(0, 0): 0}, {}, [(0, 0)]
        for a, b in queue:
            for symbol in SYMBOLS + MARKS:
                out = []
                for to_a, passed, weight_a in self.arcs.get((a, symbol), ()):
                    for to_b, last, weight_b in other.arcs.get((b, passed), ()):
                        if (to_a, to_b) not in number:
                            number[to_a, to_b] = len(number)
                            queue.append((to_a, to_b))
                        out.append((number[to_a, to_b], last, weight_a * weight_b))
                arcs[number[a, b], symbol] = out
        return Transducer(arcs, {n for (a, b), n in number.items() if a in self.finals and b in other.finals})

    def best(self, symbols: list[tuple[str, float]]) -> float:
        """The weight of the best accepted path, 0 without one; a symbol's own weight counts where it is marked."""
        held = {0: 1.0}
        for symbol, own in symbols:
            ahead: dict[int, float] = {}
            for state, weight in held.items():
                for to, passed, factor in self.arcs[state, symbol]:
                    got = weight * factor * (own if passed in MARKS else 1.0)
                    if got > ahead.get(to, 0.0):
                        ahead[to] = got
            held = ahead
        return max((weight for state, weight in held.items() if state in self.finals), default=0.0)


# Marks one insult, or leaves the mark to the next transducer.
INSULT = Transducer.of(2, {0, 1}, (0, "insult", [(0, "insult", 1.0), (1, "marked insult", 1.0)]))
# Marks one threat, unless an insult is marked; one mark there must be.
THREAT = Transducer.of(3, {1, 2}, (0, "threat", [(0, "threat", 1.0), (1, "marked threat", 1.0)]),
                       (0, "marked insult", [(2, "marked insult", 1.0)]), (1, "marked insult", []))
# States: no target yet, target seen, mark without a target, mark that waits for one, done.
TARGET = Transducer.of(5, {2, 4}, (0, "target", [(1, "target", 1.0)]),
                       (0, "marked insult", [(2, "marked insult", 1.0), (3, "marked insult", TARGETED)]),
                       (0, "marked threat", [(3, "marked threat", TARGETED)]),
                       *[(1, mark, [(4, mark, TARGETED)]) for mark in MARKS], (3, "target", [(4, "target", 1.0)]))
# States: words left of the scope, and the last one behind the mark.
NEGATION = Transducer.of(
    NEGATION_SCOPE + 2, set(range(NEGATION_SCOPE + 2)),
    *[(left, symbol, [(max(0, left - 1), symbol, 1.0)]) for left in range(NEGATION_SCOPE + 1) for symbol in SYMBOLS],
    *[(left, "negation", [(NEGATION_SCOPE, "negation", 1.0)]) for left in range(NEGATION_SCOPE + 1)],
    *[(left, mark, [(NEGATION_SCOPE + 1, mark, NEGATED if left else 1.0)]) for left in range(NEGATION_SCOPE + 1) for mark in MARKS])
# States: before and behind a verb of speech, and behind the mark.
REPORT = Transducer.of(3, {0, 1, 2}, (0, "report", [(1, "report", 1.0)]),
                       *[(said, mark, [(2, mark, REPORTED if said else 1.0)]) for said in (0, 1) for mark in MARKS])
GRAMMAR = INSULT.then(THREAT).then(TARGET).then(NEGATION).then(REPORT)


def clause_score(symbols: list[tuple[str, float]]) -> float:
    """The best accepted path of one clause."""
    return min(0.99, GRAMMAR.best(symbols))


class Lexicon:
    """Learned entries (``word`` or ``stem*`` → weight) and the seed symbols, with hashes for the scan."""

    def __init__(self, entries: dict[str, float]):
        self.words = {w: p for w, p in entries.items() if not w.endswith("*")}
        self.stems = {w[:-1]: p for w, p in entries.items() if w.endswith("*")}
        self.seeds = {w: kind for kind, text in SEEDS.items() for w in text.split()}
        loud = {w for w, kind in self.seeds.items() if kind in ("insult", "threat")}
        # A stem by itself is a hit too: the grammar reads on after an apostrophe.
        self.word_hashes = np.sort(ts.hash_words(sorted({*self.words, *loud, *self.stems})))
        self.stem_sizes = sorted({len(s.encode()) for s in self.stems})
        self.stem_hashes = np.sort(ts.hash_words(sorted(self.stems)))

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for size in STEMS:
            weight = max(weight, self.stems.get(word[:size], 0.0) if len(word) > size else 0.0)
        if weight:
            return "insult", weight
        kind = self.seeds.get(word, "other")
        return kind, 0.8 if kind == "insult" else 0.5 if kind == "threat" else 0.0

    def symbols(self, word: str) -> list[tuple[str, float]]:
        """The word's symbol, or those of its parts around the apostrophe, if it has none as a whole."""
        whole = self.symbol(word)
        return [self.symbol(part) for part in word.split("'")] if whole[0] == "other" and "'" in word else [whole]

    def score(self, text: str) -> tuple[float, int]:
        """(score, matched clauses) of a whole text."""
        clean, matched = 1.0, 0
        for clause in CLAUSE.split(text.lower().translate(APOSTROPHES)):
            symbols = [symbol for w in WORD.findall(clause) for symbol in self.symbols(w)]
            if any(kind in ("insult", "threat") for kind, _ in symbols):
                got = clause_score(symbols)
                matched += got > 0
                clean *= 1 - got
        return 1 - clean, matched

    def suspects(self, column):
        """Every row with an insult or threat symbol (and few others), found by hash over whole texts.  Texts beyond ASCII
        are put in lower case and split at non-letters as the grammar does it, so that the bytes left are letters."""
        plain = pa.array([t if t is None or t.isascii() else GAP.sub(" ", t.lower()) for t in column.to_pylist()],
                         pa.large_string())
        out = []
        for row, off, raw in ts.slices(plain):
            words = ts.Words(off, ts.fold_case(raw), ts.LETTERS)
            hit = words.doc[ts.member(words.hashes(), self.word_hashes) >= 0]
            rows = [hit]
            for size in self.stem_sizes:
                at, h = words.prefix_hashes(size)
                rows.append(words.doc[at[ts.member(h, self.stem_hashes) >= 0]])
            out.append(np.unique(np.concatenate(rows)) + row)
        return np.concatenate(out) if out else np.zeros(0, int)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Lexicon from ``labelled`` (text, toxic): document frequencies by label, counted in Spark over distinct
    texts.  Only the entries that pass the bounds reach the driver."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("toxic").isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(uniform(F.xxhash64("text"), seed=5) < sample / n)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), F.lit(0)))
    entries = F.array_distinct(F.flatten(F.transform("words", lambda w: F.filter(
        F.array(w, *[F.when(F.length(w) > s, F.concat(F.substring(w, 1, s), F.lit("*"))) for s in STEMS]),
        lambda x: x.isNotNull()))))
    # Texts alike in all words but a few are copies; the label and the rarest words stand for them.
    distinct = rows.groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    distinct = distinct.select("toxic", words.alias("words")).select("toxic", entries.alias("entries"))
    total = distinct.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(total["bad"] or 0), int(total["n"]) - int(total["bad"] or 0)
    if not bad or not good:
        return Lexicon({})
    counted = distinct.select("toxic", F.explode("entries").alias("entry")).groupBy("entry").agg(
        F.sum("toxic").alias("b"), F.count("*").alias("n"))
    # An entry counts if its surplus of toxic texts can't be chance among all candidates (Chernoff's bound).
    candidates = materialize(counted.where(F.col("b") >= SUPPORT), "toxic-entries")
    tried, prior = candidates.count(), bad / (bad + good)
    rate, clean = F.col("b") / F.col("n"), 1 - F.col("b") / F.col("n")
    surplus = F.col("n") * (rate * F.log(rate / prior) + F.when(clean > 0, clean * F.log(clean / (1 - prior))).otherwise(0.0))
    weight = F.col("b") / (F.col("n") + 0.5)
    least = F.when(F.endswith("entry", F.lit("*")), STEM_PRECISION).otherwise(PRECISION)
    kept = candidates.select("entry", weight.alias("weight"), surplus.alias("surplus")).where(
        (F.col("weight") >= least) & (F.col("surplus") >= math.log(tried + 1) + CONFIDENCE))
    return Lexicon({r["entry"]: min(0.98, r["weight"]) for r in kept.collect()})


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``n_clauses`` (matched clauses); underscored if the names are taken."""
    shipped = df.sparkSession.sparkContext.broadcast(lexicon)

    def compute(columns):
        for column in columns:
            scores, clauses = np.zeros(len(column)), np.zeros(len(column), np.int64)
            for row in shipped.value.suspects(column):
                scores[row], clauses[row] = shipped.value.score(column[int(row)].as_py())
            yield [pa.array(scores, pa.float64()), pa.array(clauses, pa.int64())]

    return add_columns(df, text, compute, {"score": "double", "n_clauses": "bigint"})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = learn(docs.join(labels.where(fold("doc_id", 4) != HELD_OUT), "doc_id").select("text", "toxic"))
    return score(docs, lexicon).select(
        "doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
