"""Quality rules whose cutoffs are chosen under a guaranteed risk.

Each rule rejects documents whose statistic lies above a cutoff. The cutoffs are chosen on labelled
documents, for each stratum by itself: of the labelled good ones, the share that the rules reject
together has an exact binomial upper bound (Clopper and Pearson). Cutoffs of all rules go from loose
to strict in one sequence, which is fixed by documents outside this holdout: in each step every rule
rejects a little more of those. The sequence is followed until the first step whose bound exceeds the
risk, so no error is spent on the number of steps or rules. It is divided by the strata that have
labels enough for any cutoff, so that all bounds hold at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_column, column_like
from tidemark.session import stored

RISK, ERROR = 0.02, 0.05  # at most so many good documents rejected by the rules together, but for this probability
SYMBOLS = b"#*$%&|<>"  # fixed by the contract
MIN_WORDS, REPEAT_PERCENT = 50, 50
# statistics per document, each larger for worse texts, in steps of 1/64 from 0 to 4
RULES = ("symbols_per_word", "dup_lines", "repeat_words", "upper", "short_lines")
GRID, STEP = 256, 64
SHARES = np.arange(513) / 1024  # of other documents that a rule may reject, step by step
OWN_PATH = 1024  # with fewer other documents a stratum has none in the first share, and follows the sequence of all strata
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_NO_CHARACTER = bytes(b for b in range(256) if _IS_SPACE[b] or _CONTINUES[b])


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # too many words for one number: number the pairs first
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    words = text.split()
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    return (
        len(words), len(text.translate(None, _NO_CHARACTER)), len(text.translate(None, _NOT_SYMBOLS)), duplicates, repeat_words(words), lines,
        len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_LETTERS)))


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents and the ``COUNTS`` of their texts (null: none)."""
    base = docs.select(*columns, "text")
    fields = [f for f in base.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS)])

    def run(batches):
        for batch in batches:
            rows = np.array([measure(t) for t in binary_column(batch, "text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*(column_like(batch, c) for c in columns), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [*columns, *COUNTS])

    return base.select(*columns, "text").mapInArrow(run, schema)


def with_grades(rows: DataFrame) -> DataFrame:
    """Adds each rule's grade: the statistic in whole steps, 0 to ``GRID``."""
    per = {
        "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"),
        "upper": ("n_upper", "n_letters"), "short_lines": ("n_lines", "n_words")}
    return rows.withColumns({r: F.least(F.lit(GRID), F.floor(F.col(a) * STEP / F.greatest(F.col(b), F.lit(1)))).cast("int") for r, (a, b) in per.items()})


def upper_bound(bad: int, n: int, error: float) -> float:
    """The exact upper bound of a share after ``bad`` of ``n``: the p at which so few have probability ``error``."""
    if n == 0 or bad >= n:
        return 1.0
    k = np.arange(bad + 1)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k.tolist()])
    low, high = bad / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = choose + k * math.log(p) + (n - k) * math.log1p(-p) if p < 1 else np.full(len(k), -np.inf)
        if np.exp(logs - logs.max()).sum() * math.exp(logs.max()) > error if np.isfinite(logs.max()) else False:
            low = p
        else:
            high = p
    return high


def allowed(n: int, risk: float, error: float) -> int:
    """The most rejected good ones out of ``n`` whose upper bound is within the risk; -1 if not even none is."""
    low, high = -1, n
    while high - low > 1:
        middle = (low + high) // 2
        if upper_bound(middle, n, error) <= risk:
            low = middle
        else:
            high = middle
    return low


def paths_of(others: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n, an array of cutoffs per rule, loose to strict) of documents that no bound is tested on.

    In each step a rule's cutoff leaves at most the next of ``SHARES`` of these documents above it.
    The row with a null stratum has the path of all of them.
    """
    cells = others.select(stratum, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("grade")) for r in RULES])).alias("c"))
    counts = stored(cells.groupBy(stratum, "c.rule", "c.grade").agg(F.count("*").alias("n")), "other_grades")
    overall = counts.groupBy("rule", "grade").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias(stratum), "rule", "grade", "n")

    def quantiles(key, frame):
        import pandas as pd

        steps, total = [], 0
        for rule in RULES:
            own = frame[frame["rule"] == rule]
            by_grade = np.bincount(own["grade"].astype(int), weights=own["n"], minlength=GRID + 1).astype(np.int64)
            total = int(by_grade.sum())
            above = total - np.cumsum(by_grade)
            steps.append([int(np.flatnonzero(above <= share * total)[0]) for share in SHARES])
        return pd.DataFrame([[key[0], total, *steps]], columns=[stratum, "others", *[f"path_{r}" for r in RULES]])

    schema = f"{stratum} string, others bigint, " + ", ".join(f"path_{r} array<int>" for r in RULES)
    return counts.union(overall).groupBy(stratum).applyInPandas(quantiles, schema)


def tested_strata(sizes: list[int], risk: float, error: float) -> int:
    """How many strata, largest first, are tested so that each could have a cutoff with its share of the error; this depends on sizes alone."""
    sizes = sorted(sizes, reverse=True)
    return max((m for m, n in enumerate(sizes, 1) if upper_bound(0, n, error / m) <= risk), default=0)


def choose_cutoffs(graded: DataFrame, others: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, a cutoff per rule): a document is rejected by a rule if its grade is above the cutoff.

    ``graded`` holds the labelled good documents, ``others`` documents that aren't among them. Only
    counts per stratum and step are gathered. All cutoffs are ``GRID`` (nothing is rejected) where
    no step can be guaranteed.
    """
    paths = stored(paths_of(others, stratum), "paths")
    names = [f"path_{r}" for r in RULES]
    own = paths.where(F.col(stratum).isNotNull() & (F.col("others") >= OWN_PATH))
    overall = paths.where(F.col(stratum).isNull()).select(*[F.col(c).alias(f"all_{c}") for c in names])
    sizes = stored(graded.groupBy(stratum).agg(F.count("*").alias("good")), "sizes")
    plain = F.sequence(F.lit(GRID - 1), F.lit(0), F.lit(-1))  # if there are no other documents
    walked = sizes.join(own, stratum, "left").join(F.broadcast(overall), F.lit(True), "left")  # one row
    walked = stored(walked.select(stratum, "good", *[F.coalesce(c, f"all_{c}", plain).alias(c) for c in names]), "walked")
    tested = tested_strata([r["good"] for r in sizes.select("good").collect()], risk, error)

    # the first step that rejects a document; a path's cutoffs never rise
    def passed(rule: str):
        return F.size(F.filter(f"path_{rule}", lambda c: c >= F.col(rule)))

    step = F.least(*map(passed, RULES))
    steps = graded.join(walked, stratum).groupBy(stratum, step.alias("step")).agg(F.count("*").alias("n"))
    lists = steps.groupBy(stratum).agg(F.collect_list(F.struct("step", "n")).alias("steps"))  # one per step at most

    def pick(frames):
        import pandas as pd

        for frame in frames:
            cutoffs = []
            for row in frame.to_dict("records"):
                paths = [list(row[c]) for c in names]
                rejected = np.cumsum(np.bincount([s["step"] for s in row["steps"]], weights=[s["n"] for s in row["steps"]], minlength=len(paths[0])))
                most = allowed(int(row["good"]), risk, error / max(1, tested))
                failed = np.flatnonzero(rejected[:len(paths[0])] > most)
                last = (int(failed[0]) if len(failed) else len(paths[0])) - 1
                cutoffs.append([row[stratum], *(p[last] if last >= 0 else GRID for p in paths)])
            yield pd.DataFrame(cutoffs, columns=[stratum, *[f"max_{r}" for r in RULES]])

    return walked.join(lists, stratum).mapInPandas(pick, f"{stratum} string, " + ", ".join(f"max_{r} int" for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rule that rejects a document (null: none).

    ``labels`` has doc_id and quality; the good ones (1) are the holdout on which cutoffs are
    chosen, each labelled document once. The stratum is a column of the documents; null is a
    stratum of its own, one without labels rejects nothing beyond the base. Null and empty texts
    have no words, which fails the base. Repeated documents are judged each. Without labels or
    documents nothing fails but the base.
    """
    rows = stored(with_grades(measured(docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text"), ["doc_id", "stratum"])), "measured")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    good = labels.where("quality = 1").select("doc_id").distinct()
    # what the base rejects is gone before the rules, so it isn't part of their holdout
    holdout = rows.where(~base).join(good, "doc_id", "left_semi")
    cutoffs = choose_cutoffs(holdout, rows.where(~base).join(good, "doc_id", "left_anti"), "stratum", risk, error)
    above = [F.when(F.col(r) > F.coalesce(F.col(f"max_{r}"), F.lit(GRID)), F.lit(r)) for r in RULES]
    judged = rows.join(cutoffs, "stratum", "left").withColumn("base_failed", base).withColumn("rejected_by", F.coalesce(*above))
    return judged.select(
        "doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
