"""Toxicity scores from a weighted finite-state grammar over clauses.

A lexical transducer maps tokens to symbols (insult, threat, target, negation,
reported speech, other). Three small transducers rewrite the symbols of a clause:
negation softens an insult that follows it, reported speech softens what is quoted, and
a target sharpens the insult near it or completes a threat. A last one weighs symbols.
They are composed once into a single machine, and each clause around a lexical match is
run through it; a document's evidence is the sum over its clauses, so isolated words
count only as the clause lets them.

The insult lexicon (words and word beginnings) and the two numbers that turn evidence
into a probability are learned from at most MAX_TRAIN labelled rows whose
crc32(doc_id as text) mod 4 is not 2, those with the smallest hash. Near copies in that
sample count as one when an entry's support is counted. A word beginning stays only if the
documents that no surer entry explains are toxic too. Labels that any one insult would part
leave the probability of a single insult open; a prior of PRIOR of the sample, toxic with
probability PRIOR_TOXIC, settles it. Labels, lang, source and doc_id never enter a score.
A clause reaches from one mark of CLAUSE_END to the next, however far that is.

Defined results: null and empty texts have no clauses and get the score of no evidence;
equal texts get equal scores, so ties and repeated rows are scored alike and one by one; very
long texts are read whole; an empty table gives no rows; without usable labels the lexicon is
the built-in grammar alone; a row without doc_id is scored like others, its doc_id null and
held_out false; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
THRESHOLD = 0.3
#: A learned entry must occur in so many toxic sample documents that are no near copies
#: of each other, and so large a share of the documents that hold it must be toxic.
LEAST_DOCS, LEAST_SHARE = 6, 0.8
PREFIXES = range(4, 11)

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = ".!?;\n"
NEXT_END = re.compile(f"[{re.escape(CLAUSE_END)}]")
#: Weight of the prior for one insult that nothing softens, as a share of the sample, and its probability.
PRIOR, PRIOR_TOXIC = 0.02, 0.6

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRo"
#: Function words of the grammar.
GRAMMAR = {
    THREAT: ("kill you", "hurt you", "destroy you", "hunt you", "beat you", "find you"),
    TARGET: ("you", "your", "you're", "he", "she", "they", "this", "these", "those"),
    NEGATION: ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "pas", "jamais", "nunca"),
    REPORT: ("said", "says", "wrote", "claimed", "called", "quoted", "reported", "according"),
}
#: Tokens over which negation and targets carry.
NEAR = 3
WEIGHTS = {"I": 1.0, "J": 1.3, "n": 0.4, "r": 0.5, "T": 1.5, "U": 0.5, OTHER: 0.0, TARGET: 0.0, NEGATION: 0.0, REPORT: 0.0}


class Transducer:
    """Deterministic and weighted: (state, symbol) -> (state, symbol, weight). State 0 begins."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs
        self.symbols = sorted({s for _, s in arcs})

    def compose(self, other: Transducer) -> Transducer:
        """Feed what this writes to ``other``; only reachable pairs of states remain."""
        names, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            a, b = here = todo.pop()
            for symbol in self.symbols:
                a2, middle, w1 = self.arcs[a, symbol]
                b2, out, w2 = other.arcs[b, middle]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                arcs[names[here], symbol] = (names[a2, b2], out, w1 + w2)
        return Transducer(arcs)

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for s in symbols:
            state, written, weight = self.arcs[state, s]
            out.append((written, weight))
        return out


def _carrying(alphabet: str, trigger: str, rewrite: dict[str, str], reach: int | None) -> Transducer:
    """After ``trigger``, for ``reach`` tokens (or to the clause's end), symbols are rewritten."""
    last = reach or 1
    arcs = {}
    for state in range(last + 1):
        for s in alphabet:
            on = last if s == trigger or reach is None and state else max(0, state - 1)
            arcs[state, s] = (on, rewrite.get(s, s) if state else s, 0.0)
    return Transducer(arcs)


def grammar() -> Transducer:
    """negation o reported speech o target o weights."""
    plain = "ITGNRo"
    negated = _carrying(plain, NEGATION, {"I": "n", "T": "U"}, NEAR)
    reported = _carrying(plain + "nU", REPORT, {"I": "r", "T": "U"}, None)
    targeted = _carrying(plain + "nUr", TARGET, {"I": "J"}, NEAR)
    weigh = Transducer({(0, s): (0, s, w) for s, w in WEIGHTS.items()})
    return reduce(Transducer.compose, (negated, reported, targeted, weigh))


class Scorer:
    """Finds lexical matches, cuts the clauses around them and runs the machine."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.machine = grammar()
        self.of = {w: symbol for symbol in (TARGET, NEGATION, REPORT) for w in GRAMMAR[symbol]}
        self.lexicon = lexicon
        self.finder = ahocorasick.Automaton()
        for entry in lexicon:
            self.finder.add_word(entry.rstrip("$"), None)
        for phrase in GRAMMAR[THREAT]:
            self.finder.add_word(phrase, None)
        found: dict[str, list] = defaultdict(list)
        for entry in lexicon:
            found[entry.rstrip("$")].append(entry)
        for phrase in GRAMMAR[THREAT]:
            found[phrase].append(None)
        for key, entries in found.items():
            self.finder.add_word(key, (len(key), entries))
        self.finder.make_automaton()

    def matches(self, text: str) -> list[tuple[int, str | None]]:
        """(start, entry) in a lower-cased text; entries begin at a word's start, ``$`` ends with it."""
        out, n = [], len(text)
        for end, (size, entries) in self.finder.iter(text):
            start, after = end - size + 1, end + 1
            if start and text[start - 1].isalpha():
                continue
            whole = after == n or not text[after].isalpha()
            out += [(start, e) for e in entries if whole or e and e[-1] != "$"]
        return out

    def evidence(self, text: str) -> float:
        text = text.lower()
        hits: dict[int, float] = {}
        threats = set()
        for start, entry in self.matches(text):
            if entry is None:
                threats.add(start)
            else:
                hits[start] = max(hits.get(start, 0.0), self.lexicon[entry])
        total, done = 0.0, -1
        for start in sorted({*hits, *threats}):
            if start < done:
                continue
            lo = max(done, 0)
            lo = max([lo, *(text.rfind(c, lo, start) + 1 for c in CLAUSE_END)])
            end = NEXT_END.search(text, start)
            hi = end.start() if end else len(text)
            tokens = [(m.start(), m[0]) for m in WORD.finditer(text, lo, hi)]
            symbols = [INSULT if at in hits else THREAT if at in threats else self.of.get(word, OTHER) for at, word in tokens]
            for (at, _), (_, weight) in zip(tokens, self.machine.run(symbols), strict=True):
                total += weight * hits.get(at, 1.0)
            done = max(hi, start + 1)
        return total


def probability(evidence: float, model: tuple[float, float]) -> float:
    """Logistic in log2(1 + evidence)."""
    return 1 / (1 + math.exp(-(model[0] + model[1] * math.log2(1 + evidence))))


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most MAX_TRAIN labelled documents that are not held out."""
    named = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    named = named.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounded = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(bounded), "doc_id").select("text", "toxic")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def sketch(text: str) -> list[int]:
    """Four minima over the hashed word pairs: near copies share most, other texts hardly any."""
    words = [w.encode() for w in WORD.findall(text.lower())]
    codes = [zlib.crc32(b, zlib.crc32(a)) for a, b in zip(words, words[1:], strict=False)] or [zlib.crc32(b" ".join(words))]
    return [min((c * m & 0xFFFFFFFF) ^ c >> 16 for c in codes) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def clusters(sketches: list[list[int]]) -> list[int]:
    """Number of the cluster of each sketch; sketches that share two minima belong together.

    One shared minimum is no copy: a passage in both texts gives it, and such links chain.
    """
    root = list(range(len(sketches)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[tuple, int] = {}
    for i, minima in enumerate(sketches):
        for key in combinations(enumerate(minima), 2):
            root[top(i)] = top(first.setdefault(key, i))
    return [top(i) for i in range(len(sketches))]


def unexplained(strong: dict[str, tuple[int, int]], held: list[tuple[int, list[str]]]) -> list[str]:
    """Entries, surest first, whose documents beyond those of surer entries are toxic in LEAST_SHARE or are none.

    "lose" is kept by its own merit only, not by the documents that hold "loser".
    """
    rows = defaultdict(list)
    for i, (_, found) in enumerate(held):
        for e in found:
            rows[e].append(i)
    kept, seen = [], set()
    for e in sorted(strong, key=lambda e: (-strong[e][0] / strong[e][1], -strong[e][0], e)):
        fresh = [held[i][0] for i in rows[e] if i not in seen]
        if sum(fresh) >= LEAST_SHARE * len(fresh):
            kept.append(e)
            seen.update(rows[e])
    return kept


def entries_of(words: set[str]) -> set[str]:
    return {w + "$" for w in words if len(w) >= 3} | {w[:k] for w in words for k in PREFIXES if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple[float, float]]:
    """The lexicon and the logistic model. All that reaches the driver comes from the bounded sample."""
    common.arrow_rows(docs.sparkSession)
    rows = common.settle(sample(docs, labels), "toxic-sample")

    def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(e for t in batch.column(0).to_pylist() for e in entries_of(words_of(t or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    toxic = rows.filter("toxic = 1").select("text")
    frequent = toxic.mapInArrow(count_entries, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    candidates = {r["entry"]: 1.0 for r in frequent.collect()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(candidates)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [sorted({e for _, e in scorer.matches(t.lower()) if e}) for t in texts]
            marks = [sketch(t) if y == 1 else [] for t, y in zip(texts, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))], ["toxic", "found", "marks"]
            )
        del scorer
        common.release_memory()

    lexicon: dict[str, float] = {}
    if candidates:
        found = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(find, "toxic int, found array<string>, marks array<long>")
        found = common.settle(found, "toxic-found")
        counts = found.select("toxic", F.explode("found").alias("entry")).groupBy("entry").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
        strong = {r["entry"]: (r["n1"], r["n"]) for r in counts.filter((F.col("n1") >= LEAST_DOCS) & (F.col("n1") >= LEAST_SHARE * F.col("n"))).collect()}
        keep = F.array(*[F.lit(e) for e in sorted(strong)]).cast("array<string>")
        held = found.select("toxic", "marks", F.array_intersect("found", keep).alias("found")).filter(F.size("found") > 0).collect()
        toxic_rows, apart = [r for r in held if r["toxic"]], defaultdict(set)
        for cluster, row in zip(clusters([r["marks"] for r in toxic_rows]), toxic_rows, strict=True):
            for entry in row["found"]:
                apart[entry].add(cluster)
        supported = {e: strong[e][0] / (strong[e][1] + 1.0) for e, own in apart.items() if len(own) >= LEAST_DOCS}
        lexicon = {e: supported[e] for e in unexplained({e: strong[e] for e in supported}, [(r["toxic"], r["found"]) for r in held])}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            level = [round(math.log2(1 + scorer.evidence(t or "")), 2) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, pa.float64())], ["toxic", "level"])

    levels = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(weigh, "toxic int, level double")
    levels = levels.groupBy("level").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
    binned = sorted((r["level"], r["n1"], r["n"]) for r in levels.collect())
    prior = PRIOR * sum(n for _, _, n in binned)
    return lexicon, logistic([*binned, (1.0, PRIOR_TOXIC * prior, prior)])


def logistic(levels: list[tuple[float, float, float]], steps: int = 60) -> tuple[float, float]:
    """Newton's method on binned counts with a small ridge."""
    a, b = -2.0, 1.0
    for _ in range(steps):
        g0 = g1 = 0.0
        h00, h01, h11 = 1e-3, 0.0, 1e-3
        for x, n1, n in levels:
            p = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            g0 += n1 - n * p
            g1 += (n1 - n * p) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1 = g0 - 1e-3 * a, g1 - 1e-3 * b
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + max(-2, min(2, da)), b + max(-2, min(2, db))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def scored(df: DataFrame, lexicon: dict[str, float], model: tuple[float, float], names: tuple[str, str] = ("_evidence", "_score")) -> DataFrame:
    """df with evidence and score under two new names, in one pass without a shuffle."""
    common.arrow_rows(df.sparkSession)
    added_names, names = names, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            evidence = [scorer.evidence(t or "") for t in batch.column(names.index("text")).to_pylist()]
            added = [pa.array(evidence, pa.float64()), pa.array([probability(e, model) for e in evidence], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *added_names])
        common.release_memory()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kind}, `{added_names[0]}` double, `{added_names[1]}` double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each document."""
    lexicon, model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, lexicon, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_evidence").alias("evidence")
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns unchanged."""
    lexicon, model = learn(docs, labels)
    names = common.free("_evidence", docs), common.free("_score", docs)
    return scored(docs, lexicon, model, names).filter(F.col(f"`{names[1]}`") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
