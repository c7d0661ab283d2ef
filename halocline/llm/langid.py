"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ranked list of the PROFILE most frequent letter n-grams (one to three letters, words padded with a
blank). A document is compared with each language's profile by the out-of-place distance: for each of the document's
n-grams, how far its rank is from its rank in the profile, PROFILE if it is not there. The nearest profile wins.

Profiles are learned from a bounded sample of labelled rows, about SAMPLE_DOCS a language chosen by a hash of the id;
whole texts are counted, in the sample as in every prediction. Predictions are one pass without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; the score is 1 - nearest / (sum of the
two nearest distances), scaled to 0..1 (0: a tie), ties going to the language that sorts first; with one learned
language its score is 1 - distance / largest distance; rows with a null label are not learned from; repeated rows are
each predicted; without any learnable row every document is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import whole_text_batches

PROFILE = 400
SAMPLE_DOCS = 1500
UNKNOWN = "und"
BLANK = 1
PIECE = 1 << 20


@functools.lru_cache(maxsize=1)
def _letter_codes() -> np.ndarray:
    """Code point of the first plane -> itself for letters, BLANK for all else."""
    table = np.full(1 << 16, BLANK, dtype=np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the text's n-grams; a code packs up to three code points of 21 bits."""
    parts = []
    for at in range(0, len(text), PIECE):  # two letters of overlap keep n-grams across pieces
        raw = np.frombuffer(text[max(0, at - 2) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        code = np.where(raw < 1 << 16, _letter_codes()[np.minimum(raw, (1 << 16) - 1)], raw)
        for c in np.unique(raw[raw >= 1 << 16]).tolist():
            if not chr(c).isalpha():
                code[raw == c] = BLANK
        code = np.concatenate([[BLANK] if at == 0 else [], code, [BLANK] if at + PIECE >= len(text) else []]).astype(np.int64)
        skip = 0 if at == 0 else 2
        one, two = code[skip:], ((code[:-1] << 21) | code[1:])[max(0, skip - 1) :]
        three = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
        one = one[one != BLANK]
        two = two[two != (BLANK << 21 | BLANK)]
        middle = code[1:-1] != BLANK  # a trigram is a letter with its neighbours
        parts.append(np.unique(np.concatenate([one, two, three[middle]]), return_counts=True))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(parts) == 1:
        return parts[0]
    return _merge(parts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([x[1] for x in parts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.langs])) if profiles else np.zeros(0, dtype=np.int64)
        # Rank of each known code in each language; ``size`` marks an absent one.
        self.ranks = np.full((len(self.langs), len(self.codes)), size, dtype=np.int32)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not self.langs or not len(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], self.size)
        place = np.arange(len(own))
        distance = np.where(ranks < self.size, np.abs(ranks - place), self.size).sum(axis=1, dtype=np.int64)
        best = int(distance.argmin())
        if len(self.langs) == 1:
            return self.langs[0], 1 - float(distance[0]) / (self.size * len(own))
        second = int(np.partition(distance, 1)[1])
        total = int(distance[best]) + second
        return self.langs[best], 1.0 - 2.0 * float(distance[best]) / total if total else 0.0


def learn_profiles(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from about ``sample`` rows (or all, if fewer) of each label; rows without label or text are left out."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in labels.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (draw < (int(min(1.0, sample / n) * (1 << 30)))))
    counts: dict[str, list] = {}
    for r in rows.where(chosen).select(lang_col, text_col).toLocalIterator():
        counts.setdefault(r[0], []).append(ngram_counts(r[1]))
        if len(counts[r[0]]) >= 64:
            counts[r[0]] = [_merge(counts[r[0]])]
    return Profiles({k: ranked(*_merge(v), size) for k, v in counts.items()}, size)


def _predict(profiles: Profiles, batches):
    for batch in batches:
        got = [profiles.predict(t) if t else (UNKNOWN, 0.0) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row."""
    whole_text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_predict, profiles), f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text", accepted: list[str] | None = None) -> DataFrame:
    """``docs`` without those of unknown language (null texts, no letters) or of one not in ``accepted``; same columns."""
    whole_text_batches(docs.sparkSession)
    wanted = frozenset(accepted if accepted is not None else profiles.langs)
    names = docs.columns
    at = names.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(t) and profiles.predict(t)[0] in wanted for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def crc_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
