"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Patterns (kinds ``assign``, ``access``, ``hex``) find what looks like a secret by its form. A further kind, ``random``,
finds long runs of encoding letters whose letters look drawn at random. For each run the narrowest alphabet that holds it
is inferred (ALPHABETS), and the run is scored by the logarithm of a likelihood ratio: letters drawn at random from that
alphabet, against a null of ordinary runs. The null is measured on the table's own short runs (under 20 letters, which are
never tested; those of every row, on top of fixed priors): pairs of neighbouring letters, and how often runs change
between lower case, upper case, digits and signs. To the score are added the logarithms of the p-values with
which the run passes for random: chi-squared uniformity in its alphabet, the runs test (upper against lower half of the
alphabet) and the lag-one serial correlation. Under the null the chance of a likelihood ratio of e^s or more is e^-s at
most, so e^-score (times the number of alphabets) is the run's p-value. p-values are then held to a false-discovery rate
of FDR within each length class (Benjamini-Hochberg), so the many short runs do not loosen the threshold for long ones.
Random identifiers (UUIDs, digests) look like secrets and are reported. Every run of 20 letters or more is tested.

Everything is DataFrame and SQL functions: each text is scanned where it lies, and only ids and offsets go on. The
table for the false-discovery control has at most LENGTH_CLASSES * P_BINS rows, whatever the input.

Positions are code points, ends exclusive. Defined results: null text counts as empty; a text without findings has
zero counts and empty lists; ``random`` runs that overlap a pattern's span are left to it; repeated rows are each
scanned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocline.llm._common import Table

#: The patterns, as Java regular expressions.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of the two patterns below are maximal, so a minimum in the pattern is the same as dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6

FDR = 0.01
LENGTH_CLASSES = 12
#: p-values are binned on a log scale, P_STEP natural-log units a bin.
P_BINS, P_STEP = 120, 0.25
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"
SHORT_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{2,19}(?![A-Za-z0-9+/_-])"
#: Chance of the next letter's class (lower case, upper case, digit, sign) after each class: half of the null.
CLASS_PRIOR = ((0.93, 0.02, 0.02, 0.03), (0.30, 0.60, 0.05, 0.05), (0.08, 0.07, 0.70, 0.15), (0.40, 0.20, 0.30, 0.10))
#: Common words, counted on top of the table's; and the share of letter pairs that is uniform, whatever was counted.
PRIOR_WORDS = "the and that for with from this have not are was you user name file data value order status item index time number password account service request response message content version config default system error text list type state customer product address country region price quantity description available international der die und den das nicht mit von ist ein eine les des une que pour dans est los las para con por una como".split()
ANY_PAIR = 0.05
#: Narrowest first; the last holds every run.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "hex-": "0123456789abcdef-_",
    "HEX-": "0123456789ABCDEF-_",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36-": "0123456789abcdefghijklmnopqrstuvwxyz-_",
    "BASE36-": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-_",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
PIECE = 256
SPAN_TYPE = "array<struct<start:long,rank:int,end:long>>"


def _spans(text: Column, pattern: str, kind: str, group: int | None = None) -> Column:
    """Spans of all leftmost, non-overlapping matches; with ``group``, of those whose group has MIN_VALUE letters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("len"), F.transform(value, lambda x: F.length(x)).alias("value"))
    zero, none = F.lit(0).cast("long"), F.expr(f"cast(array() as {SPAN_TYPE})")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(begin.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("long").alias("end")))
        keep = F.coalesce(x["value"] >= (MIN_VALUE if group else 1), F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # Appending to an array copies it, so running sums go over PIECE matches at a time, and then over the pieces.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PIECE).cast("int")), lambda i: F.slice(rows, i * PIECE + 1, PIECE))

    def after(acc: Column, piece: Column) -> Column:
        own = F.aggregate(piece, zero, lambda n, x: n + x["gap"] + F.coalesce(x["len"], F.lit(0)))
        return F.struct((acc["at"] + own).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), piece.alias("rows")))).alias("out"))

    start = F.struct(zero.alias("at"), F.expr("cast(array() as array<struct<at:bigint,rows:array<struct<gap:int,len:int,value:int>>>>)").alias("out"))
    placed = F.transform(F.aggregate(pieces, start, after)["out"], lambda p: F.aggregate(p["rows"], F.struct(p["at"].alias("at"), none.alias("out")), step)["out"])
    return F.when(text.rlike(pattern), F.flatten(placed)).otherwise(none)


def _encoding(run: Column) -> Column:
    """The narrowest alphabet that holds the run: every run has one, and the tests decide."""
    out = F.lit(list(ALPHABETS)[-1])
    for name, letters in reversed(list(ALPHABETS.items())[:-1]):
        own = letters.replace("-", "") + ("-" if "-" in letters else "")  # last in the class, "-" stands for itself
        out = F.when(run.rlike(f"^[{own}]+$"), name).otherwise(out)
    return out


def null_costs(pairs: dict[str, int]) -> list[float]:
    """-log chance of each symbol after each symbol in ordinary runs, from counts of neighbours."""
    counted = dict(pairs)
    for word in PRIOR_WORDS:
        for x, y in zip(word, word[1:], strict=False):
            counted[x + y] = counted.get(x + y, 0) + 1
    kind = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
    sizes = (26, 26, 10, 4)
    moves = [[1e-9] * 4 for _ in range(4)]
    letters = [[0.0] * 26 for _ in range(26)]
    for pair, n in counted.items():
        a, b = SYMBOLS.find(pair[0]), SYMBOLS.find(pair[1])
        if pair in pairs:
            moves[kind[a]][kind[b]] += n
        if a < 52 and b < 52:
            letters[a % 26][b % 26] += n
    one = [sum(row[b] for row in letters) + 1 for b in range(26)]
    chance = []
    for row in letters:
        mixed = [(n + 5 * x / sum(one)) / (sum(row) + 5) for n, x in zip(row, one, strict=True)]
        chance.append([(1 - ANY_PAIR) * x + ANY_PAIR / 26 for x in mixed])
    out = []
    for a in range(len(SYMBOLS)):
        seen = moves[kind[a]]
        for b in range(len(SYMBOLS)):
            prior, own = CLASS_PRIOR[kind[a]][kind[b]], seen[kind[b]] / sum(seen)
            move = 0.5 * prior + 0.5 * own if sum(seen) > 1 else prior
            # Within a word (also from a capital to a small letter) the pair counts, else any letter of the class.
            word = a < 52 and b < 52 and (kind[a] == kind[b] or kind[a] == 1)
            out.append(-math.log(move) - math.log(chance[a % 26][b % 26] if word else 1 / sizes[kind[b]]))
    return out


def measured_null(docs: DataFrame, text_col: str) -> list[float]:
    """``null_costs`` of the short runs of all rows."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(SHORT_RUN), F.lit(0))).alias("w"))
    # Exploded by place, not by an array of pairs, and counted before the shuffle: len(SYMBOLS)^2 rows a task at most.
    places = words.select("w", F.explode(F.expr("sequence(1, length(w) - 1)")).alias("i"))
    pairs = places.groupBy(F.expr("substr(w, i, 2)").alias("pair")).agg(F.count("*").alias("n"))
    return null_costs({r["pair"]: r["n"] for r in pairs.collect()})  # len(SYMBOLS)^2 rows at most


def _battery(runs: Column, costs: list[float]) -> Column:
    """(span, run) of each run -> (span, len, score): the log likelihood ratio of random letters against ordinary ones, and
    the log p-values of the tests of randomness. Each step is an array of its own, so nothing is computed twice."""

    def places(r: Column) -> Column:
        name, letters = _encoding(r["run"]), F.split(r["run"], "")
        alphabet, size = F.lit(""), F.lit(1.0)
        for k, v in ALPHABETS.items():
            alphabet, size = F.when(name == k, v).otherwise(alphabet), F.when(name == k, float(len(v))).otherwise(size)
        return F.struct(r["span"].alias("span"), F.length(r["run"]).cast("double").alias("n"), letters.alias("letters"), alphabet.alias("alphabet"), size.alias("size"))

    def codes(r: Column) -> Column:
        place = F.transform(r["letters"], lambda c: F.instr(r["alphabet"], c) - 1)
        symbol = F.transform(r["letters"], lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
        return F.struct(r["span"].alias("span"), r["n"].alias("n"), r["size"].alias("size"), F.array_sort(r["letters"]).alias("ordered"), place.alias("place"), symbol.alias("symbol"))

    def neighbours(values: Column, n: Column, f) -> Column:
        pairs = F.zip_with(F.slice(values, 1, n.cast("int") - 1), F.slice(values, 2, n.cast("int") - 1), f)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    def sums(r: Column) -> Column:
        n, half, mean = r["n"], r["size"] / 2, (r["size"] - 1) / 2
        # Sum of squared counts: each letter of the sorted run adds twice its place among its equals, less one.
        start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("same"), F.lit(0.0).alias("sum"))

        def count(acc: Column, c: Column) -> Column:
            same = F.when(acc["last"] == c, acc["same"] + 1).otherwise(F.lit(1.0))
            return F.struct(c.alias("last"), same.alias("same"), (acc["sum"] + 2 * same - 1).alias("sum"))

        return F.struct(
            r["span"].alias("span"),
            n.alias("n"),
            r["size"].alias("size"),
            neighbours(r["symbol"], n, lambda a, b: F.get(table, a * len(SYMBOLS) + b)).alias("cost"),
            F.aggregate(r["ordered"], start, count, lambda acc: acc["sum"]).alias("squares"),
            F.aggregate(r["place"], F.lit(0.0), lambda acc, p: acc + (p >= half).cast("double")).alias("ones"),
            neighbours(r["place"], n, lambda a, b: ((a >= half) != (b >= half)).cast("double")).alias("changes"),
            neighbours(r["place"], n, lambda a, b: (a - mean) * (b - mean)).alias("product"),
        )

    def tests(r: Column) -> Column:
        n, size = r["n"], r["size"]
        expected = 2 * r["ones"] * (n - r["ones"]) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        return F.struct(
            r["span"].alias("span"),
            n.alias("n"),
            (r["cost"] - (n - 1) * F.log(size)).alias("ratio"),
            F.greatest(F.lit(-3.0), (r["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)).alias("chi"),
            F.when(variance > 0, F.abs(r["changes"] + 1 - expected) / F.sqrt(variance)).otherwise(F.lit(99.0)).alias("runs"),
            F.abs(r["product"] / (F.sqrt(n - 1) * (size * size - 1) / 12)).alias("serial"),
        )

    def score(r: Column) -> Column:
        two_sided = [F.least(F.lit(0.0), math.log(2) + _log_p(-r[k])) for k in ("runs", "serial")]
        total = r["ratio"] - math.log(len(ALPHABETS)) + _log_p(-r["chi"]) + two_sided[0] + two_sided[1]
        return F.struct(r["span"].alias("span"), r["n"].alias("len"), total.alias("score"))

    table = F.expr(f"array({','.join(f'{x:.5f}D' for x in costs)})")
    for step in (places, codes, sums, tests, score):
        runs = F.transform(runs, step)
    return runs


def _log_p(z: Column) -> Column:
    """Logarithm of the lower normal tail (logistic form in the middle, the Mills ratio's bound far out)."""
    middle = -F.log1p(F.exp(-(1.5976 * z + 0.070566 * z * z * z)))
    return F.when(z < -4, -z * z / 2 - F.log(-z) - 0.9189).otherwise(middle)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """id, base (spans of the patterns), random (spans of the battery): sorted arrays of struct(start, rank, end)."""
    costs = measured_null(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 1), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    runs = F.zip_with(
        F.regexp_extract_all(text, F.lit(RUN), F.lit(0)),
        _spans(text, RUN, "random"),
        lambda run, span: F.struct(F.regexp_replace(run, "=+$", "").alias("run"), span.alias("span")),
    )
    found = docs.select(F.col(id_col).alias("_id"), base.alias("base"), F.when(text.rlike(RUN), runs).alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["span"]["end"]) & (r["span"]["start"] < b["end"])))
    tested = _battery(F.coalesce(free, F.expr("cast(array() as array<struct<run:string,span:struct<start:long,rank:int,end:long>>>)")), costs)
    binned = F.transform(
        "tested",
        lambda t: F.struct(
            t["span"].alias("span"),
            F.least(F.lit(LENGTH_CLASSES - 1), F.floor(F.log2(t["len"] / 20.0) * 2).cast("int")).alias("class"),
            F.greatest(F.lit(0), F.least(F.lit(P_BINS - 1), F.floor(t["score"] / P_STEP).cast("int"))).alias("bin"),
        ),
    )
    rows = Table(found.select("_id", "base", tested.alias("tested")).select("_id", "base", binned.alias("tested")), "secret-rows")
    # Benjamini-Hochberg on binned p-values: the lowest bin whose p-bound is within fdr * (tests at or above it) / (tests).
    tests = rows.df.select(F.explode("tested").alias("t")).groupBy(F.col("t.class").alias("class"), F.col("t.bin").alias("bin")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    cut = (
        tests.withColumn("found", F.sum("n").over(above))
        .withColumn("tests", F.sum("n").over(Window.partitionBy("class")))
        .where(F.exp(-F.col("bin") * F.lit(P_STEP)) <= F.lit(fdr) * F.col("found") / F.col("tests"))
        .groupBy("class")
        .agg(F.min("bin").alias("least"))
    )
    limits = {r["class"]: r["least"] for r in cut.collect()}  # LENGTH_CLASSES rows at most
    def significant(t: Column) -> Column:
        out = F.lit(False)
        for k, least in limits.items():
            out = out | ((t["class"] == k) & (t["bin"] >= least))
        return out

    random = F.transform(F.filter("tested", significant), lambda t: t["span"])
    return rows.df.select(F.col("_id").alias(id_col), "base", random.alias("random"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
