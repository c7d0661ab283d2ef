"""Toxicity by weak supervision.

1. Voters. A bounded sample of labelled rows (at most about SAMPLE_ROWS of each label, chosen by a hash of the id) yields
   lexicon voters: a word, or the first letters of words, seen at least so many times (LEVELS). A voter is taken when it
   occurs in more sets of toxic near copies than chance allows, by a bound on the binomial tail held to a false-discovery
   rate of FDR (Benjamini-Hochberg over all terms tested). Pattern voters look at form: disguised entries (digits, signs
   and repeated letters undone), entries in bulk, shouting, exclamation, and, as votes for clean, texts without a match and long
   texts with hardly any.
2. Generative label model. Voters' chances under either class, and the posterior class of each text, are estimated by
   expectation maximisation from the votes, starting from their majority. The known label is one more voter, which may be
   wrong: its accuracy is estimated as well, so mislabelled rows do not teach. Voters that agree beyond what the class
   explains are correlated; each counts as one over the sum of its squared residual correlations.
3. A linear (logistic) classifier on the voters is trained on the posteriors, not on the labels. It scores every text.

Learning is on the driver, on the sample alone; scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no matches and get the score of such a text; with rows of only one label (or
none) to learn from, every score is that label's share; repeated rows are each scored; ids of any type, nulls too, are
kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import whole_text_batches

SAMPLE_ROWS = 4000
#: Letters of word beginnings; 0 stands for whole words.
STEMS = (0, 4, 5, 6, 7)
SHORTEST = 4
#: How often a term must be seen to be a voter's match.
LEVELS = (1, 2, 3, 5)
FDR = 0.01
#: A voter whose toxic sets agree with a better one's to this share (Jaccard) is left out.
SAME = 0.9
#: Buckets of hashed terms, for a first count that bounds what is counted by name.
BUCKETS = 1 << 22
#: Named apart from the lexicon; the last two vote clean.
PATTERNS = ("disguised", "bulk", "shouting", "exclaiming", "no match", "long and clean")
WORD = re.compile(r"[^\W\d_]+")
#: Disguises, undone: digits and signs for letters, and letters repeated.
LEET = str.maketrans("013457@$!+", "oieastasit")
SIGNS = frozenset("013457@$!+")
AGAIN, THRICE = re.compile(r"(.)\1+"), re.compile(r"([^\W\d_])\1\1")
EDGES = ".,;:!?()\"'"

Term = tuple[int, str]


def terms(word: str) -> list[Term]:
    """(0, word) and (k, first k letters)."""
    return [(0, word), *((k, word[:k]) for k in STEMS[1:] if len(word) > k)]


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


class _Terms(dict):
    """Word -> its terms among ``wanted``, remembered for up to MEMORY words."""

    MEMORY = 1 << 16

    def __init__(self, wanted):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> list[Term]:
        if len(self) >= self.MEMORY:
            self.clear()
        found = self[word] = [t for t in terms(word) if t in self.wanted]
        return found

    def counts(self, words: Counter) -> dict[Term, int]:
        out: dict[Term, int] = {}
        for w, n in words.items():
            for t in self[w]:
                out[t] = out.get(t, 0) + n
        return out


class _Often:
    """Terms whose bucket of hashes counts ``least`` or more: all that occur so often, and a few more."""

    def __init__(self, counts: np.ndarray, least: int):
        self.counts, self.least = counts, least

    @staticmethod
    def bucket(term: Term) -> int:
        return zlib.crc32(f"{term[0]}{term[1]}".encode()) % BUCKETS

    def __contains__(self, term: Term) -> bool:
        return bool(self.counts[self.bucket(term)] >= self.least)


def _copies_key(text: str) -> int:
    """Nearly equal texts mostly share it, others hardly ever: the least hash of three words in a row."""
    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def _sets(texts: list[str]) -> list[list[str]]:
    """Texts by their set of near copies."""
    out: dict[int, list[str]] = {}
    for t in texts:
        out.setdefault(_copies_key(t), []).append(t)
    return list(out.values())


def _matches(of: _Terms, texts: list[str]) -> set[tuple[Term, int]]:
    """(term, level) found in one of the texts."""
    return {(term, k) for t in texts for term, n in of.counts(words_of(t)).items() for k in LEVELS if n >= k}


def find_lexicon(toxic: list[str], clean: list[str]) -> list[tuple[Term, int]]:
    """The voters (term, level), most telling first. Sets of copies are counted one after the other."""
    toxic_sets, clean_sets = _sets(toxic), _sets(clean)
    share = len(toxic_sets) / (len(toxic_sets) + len(clean_sets))
    buckets = np.zeros(BUCKETS, dtype=np.int32)
    for texts in toxic_sets:
        words = set().union(*(words_of(t) for t in texts))
        buckets[list({_Often.bucket(term) for w in words for term in terms(w)})] += 1
    tests = max(1, int((buckets > 0).sum())) * len(LEVELS)
    # Fewer sets than this are within chance even if all tests are found.
    least = max(2, int(np.ceil(np.log(1 / FDR) / np.log(1 / share))))
    of, count = _Terms(_Often(buckets, least)), Counter()
    for texts in toxic_sets:
        count.update(_matches(of, texts))
    count = {v: n for v, n in count.items() if n >= least}
    of, against = _Terms({term for term, _ in count}), Counter()
    for texts in clean_sets:
        against.update(v for v in _matches(of, texts) if v in count)
    scored = []
    for v, n in count.items():
        m = against[v]
        rate = n / (n + m)
        if rate > share:
            # Chernoff's bound on the chance of n or more toxic sets among n + m.
            bound = n * np.log(rate / share) + (m * np.log((1 - rate) / (1 - share)) if m else 0.0)
            scored.append((-bound, v[1], -(v[0][0] or 99), v))
    scored.sort()
    last = max((i for i, x in enumerate(scored, 1) if x[0] <= np.log(FDR * i / tests)), default=0)
    where: dict[tuple[Term, int], set[int]] = {x[3]: set() for x in scored[:last]}
    of = _Terms({term for term, _ in where})
    for number, texts in enumerate(toxic_sets):
        for v in _matches(of, texts):
            if v in where:
                where[v].add(number)
    out: list[tuple[Term, int]] = []
    for v, own in where.items():
        if not any(len(own & where[o]) >= SAME * len(own | where[o]) for o in out):
            out.append(v)
    return out


@dataclass
class ToxicityModel:
    voters: list[tuple[Term, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(PATTERNS)))
    constant: float | None = None

    def __post_init__(self) -> None:
        self.index: dict[Term, list[tuple[int, int]]] = {}
        for i, (term, level) in enumerate(self.voters):
            self.index.setdefault(term, []).append((level, i))
        #: What a word that matches begins with.
        self.heads = {t[:SHORTEST] for (_, t), _ in self.voters}
        self.whole = {AGAIN.sub(r"\1", t) for (k, t), _ in self.voters if not k}

    def disguised(self, text: str) -> bool:
        """Whether a token is an entry once undone, and none as it stands."""
        thrice = THRICE.search(text) is not None
        for token in set(text.split()) if self.whole else ():
            if not SIGNS.isdisjoint(token) or (thrice and THRICE.search(token)):
                t = token.strip(EDGES).lower()
                if AGAIN.sub(r"\1", t.translate(LEET)) in self.whole and (0, t) not in self.index:
                    return True
        return False

    def votes(self, text: str) -> np.ndarray:
        """One 1 (toxic), 0 (abstain) or -1 (clean) of each lexicon voter and of each of PATTERNS."""
        words = words_of(text)
        seen: dict[Term, int] = {}
        hits = 0
        for w, n in words.items():
            if w[:SHORTEST] in self.heads:
                own = [t for t in terms(w) if t in self.index]
                for t in own:
                    seen[t] = seen.get(t, 0) + n
                hits += n if own else 0
        out = np.zeros(len(self.voters) + len(PATTERNS), dtype=np.int8)
        for t, n in seen.items():
            for level, i in self.index[t]:
                if n >= level:
                    out[i] = 1
        size, lexical = words.total(), bool(out.any())
        masked, tokens = self.disguised(text), text.split()
        shouting = 2 * sum(map(str.isupper, tokens)) > len(tokens)
        out[len(self.voters) :] = (masked, hits > 0.02 * size and hits > 1, shouting, text.count("!") > 0.2 * max(size, 1), -(not lexical and not masked), -(size >= 200 and hits <= 0.002 * size))
        return out

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.votes(text) @ self.weights[1:], -30, 30))))


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """votes (rows, voters) in {-1 clean, 0 abstain, 1 toxic} -> (posteriors, what each voter counts: 0 to 1).

    Starts from the majority of the votes; nothing but the votes' own polarity names the classes.
    """
    kinds = [(votes == v).astype(float) for v in (-1, 0, 1)]
    posterior = 1 / (1 + np.exp(-2.0 * np.clip((votes > 0).sum(1) - (votes < 0).sum(1), -2, 2)))
    counts = np.ones(votes.shape[1])
    for turn in range(rounds):
        p1 = np.stack([k.T @ posterior + 0.5 for k in kinds]) / (posterior.sum() + 1.5)
        p0 = np.stack([k.T @ (1 - posterior) + 0.5 for k in kinds]) / ((1 - posterior).sum() + 1.5)
        gain = sum(k * (np.log(a) - np.log(b)) for k, a, b in zip(kinds, p1, p0, strict=True))
        if turn >= 2:
            # Correlations that the class does not explain, of votes as numbers.
            rest = votes - np.outer(posterior, p1[2] - p1[0]) - np.outer(1 - posterior, p0[2] - p0[0])
            size = np.sqrt((rest**2).sum(0)) + 1e-9
            counts = 1 / np.maximum(1.0, ((rest.T @ rest / np.outer(size, size)) ** 2).sum(0))
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain @ counts, -30, 30)))
    return posterior, counts


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft targets, by Newton steps; the intercept (first column) is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + shrink * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[str], labels: list[int], weak: bool = True) -> ToxicityModel:
    """The model of (texts, labels); without ``weak`` the classifier is trained on the labels themselves (for comparison)."""
    known = np.array(labels, dtype=int)
    if not len(known) or known.min() == known.max():
        return ToxicityModel(constant=float(known.mean()) if len(known) else 0.0)
    toxic, clean = ([t for t, y in zip(texts, labels, strict=True) if y == v] for v in (1, 0))
    model = ToxicityModel(find_lexicon(toxic, clean))
    votes = np.stack([model.votes(t) for t in texts])
    target = label_model(np.column_stack([votes, np.where(known == 1, 1, -1)]))[0] if weak else known
    return ToxicityModel(model.voters, fit_linear(np.column_stack([np.ones(len(votes)), votes]), target))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from at most about ``sample`` rows of each label; rows with other labels than 0 and 1 are left out.

    The sample is drawn from the narrow ``labels`` and, being bounded, broadcast to ``docs``: no text is shuffled.
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("_label") == label) & (draw < int(min(1.0, sample / n) * (1 << 30))))
    rows = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(labels.where(chosen)), id_col)
    got = sorted((r[0], r[1] or "", r[2]) for r in rows.select(id_col, "_text", "_label").toLocalIterator())
    return fit([r[1] for r in got], [r[2] for r in got])


def _score(model: ToxicityModel, batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every row."""
    whole_text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(functools.partial(_score, model), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
