"""Quality rules as weak supervision (operator 5).

Every rule votes for a document (1), against it (-1) or abstains (0).  The
documents' true quality is never seen: expectation-maximisation over the counts
of all vote patterns estimates the prior and each rule's vote distribution for
good and bad documents, and the posterior probability of being good decides.
Two hard limits (``base_failed``) reject before the rules are asked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import SPACE, codes_of, flat, line_spans, slices, spans, word_spans
from invarium.llm.shared import small_batches
from invarium.llm.tokenizing import release

#: characters of ``n_symbols``
SYMBOLS = "#*$%&|<>"
WINDOW = 8

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_distinct", "n_symbol_words", "n_exclaims", "n_other", "n_caps")

_SYMBOL, _STOP, _LEAD, _CAP, _OTHER = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_STOP[list(b".,;:!?\"')")] = True
_LEAD[0x80:0xC0] = False
_CAP[65:91] = True
_OTHER[[*range(33, 65), *range(91, 97), *range(123, 127)]] = True
_OTHER[48:58] = False
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Votes against a document where ``bad`` holds, else for it where ``good`` holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN coalesce({self.bad}, false) THEN -1 WHEN coalesce({self.good}, false) THEN 1 ELSE 0 END")


RULES = (
    Rule("enough_words", "n_words >= 20", "n_words < 10"),
    Rule("few_symbols", "50 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("plain_words", "50 * n_symbol_words <= n_words", "10 * n_symbol_words > n_words"),
    Rule("letters", "100 * n_other <= 8 * word_chars", "100 * n_other > 12 * word_chars"),
    Rule("calm", "20 * n_exclaims <= n_words", "5 * n_exclaims > n_words"),
    Rule("lower_case", "100 * n_caps <= 15 * word_chars", "100 * n_caps > 40 * word_chars"),
    Rule("few_repeats", "100 * n_repeat_words <= 15 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("few_dup_lines", "5 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("sentences", "n_words <= 40 * n_stops", "n_words > 150 * n_stops"),
    Rule("variety", "5 * n_distinct >= n_words OR n_distinct >= 200", "20 * n_distinct < n_words AND n_distinct < 200"),
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(codes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of ``window`` words that it holds twice or more.

    ``codes``: the words of all texts; ``first``: each text's first word, and
    the total.  Windows meet by a 64-bit hash and are then compared word by
    word.
    """
    n = len(codes) - window + 1
    counts = np.diff(first)
    if n <= 0 or counts.max(initial=0) < window:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        rolled = np.zeros(n, np.uint64)
        for k in range(window):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
        rolled ^= rolled >> np.uint64(32)
        keys = (rolled[starts] * _MULTIPLIER) ^ (text[starts].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys, kind="stable")
    keys, starts = keys[order], starts[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    a, b = starts[same], starts[same + 1]
    equal = text[a] == text[b]
    for k in range(window):
        equal &= codes[a + k] == codes[b + k]
    a, b = a[equal], b[equal]
    edge = np.zeros(len(codes) + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    edge[hit] += 1
    np.subtract.at(edge, hit + window, 1)
    return _sums(np.cumsum(edge[:-1]) > 0, first)


def measure_texts(texts) -> dict[str, np.ndarray]:
    """``METRICS`` of each text of an Arrow array (null: no words)."""
    buf, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(buf, offsets)
    codes, _ = codes_of(spans(buf, starts, ends))
    n_words = np.diff(first)
    word = ~SPACE[buf]
    line_start, line_end, first_line = line_spans(buf, offsets)
    line_codes, _ = codes_of(spans(buf, line_start, line_end))
    words_before = np.concatenate([[0], np.cumsum(word)])
    full = np.flatnonzero(words_before[line_end] > words_before[line_start])
    text_of_line = np.repeat(np.arange(n), np.diff(first_line))[full]
    lines = np.bincount(text_of_line, minlength=n)
    distinct_lines = np.unique(text_of_line * (len(line_codes) + 1) + line_codes[full])
    kept = np.bincount(distinct_lines // (len(line_codes) + 1), minlength=n)
    text_of_word = np.repeat(np.arange(n), n_words)
    distinct_words = np.unique(text_of_word * (len(codes) + 1) + codes)
    return {
        "n_words": n_words,
        "word_chars": _sums(word & _LEAD[buf], offsets),
        "n_symbols": _sums(_SYMBOL[buf], offsets),
        "n_dup_lines": lines - kept,
        "n_repeat_words": repeated_words(codes, first),
        "n_lines": lines,
        "n_stops": np.bincount(text_of_word[_STOP[buf[ends - 1]]], minlength=n) if len(ends) else np.zeros(n, np.int64),
        "n_distinct": np.bincount(distinct_words // (len(codes) + 1), minlength=n),
        "n_symbol_words": np.bincount(text_of_word[_SYMBOL[buf[ends - 1]]], minlength=n) if len(ends) else np.zeros(n, np.int64),
        "n_exclaims": np.bincount(text_of_word[buf[ends - 1] == 33], minlength=n) if len(ends) else np.zeros(n, np.int64),
        "n_other": _sums(_OTHER[buf], offsets),
        "n_caps": _sums(_CAP[buf], offsets),
    }


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and the metrics of the whole ``text``; a metric replaces a kept column of its name."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in METRICS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))

    def measure(batches):
        release()
        for batch in slices(batches, "__text", 4 << 20):
            found = measure_texts(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[m].astype(np.int64)) for m in METRICS)], [*keep, *METRICS])

    schema = rows.schema
    fields = [f"`{c}` {schema[c].dataType.simpleString()}" for c in keep] + [f"{m} long" for m in METRICS]
    return rows.mapInArrow(measure, ", ".join(fields))


def pattern() -> Column:
    """All rules' votes as one number in base three."""
    return sum(((r.vote() + 1) * 3**k for k, r in enumerate(RULES)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class LabelModel:
    """``prior``: of a good document; ``weights[rule][vote + 1]``: log odds that the vote adds."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, w in zip(RULES, self.weights):
            vote = r.vote()
            total = total + F.when(vote == -1, w[0]).when(vote == 0, w[1]).otherwise(w[2])
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit_votes(patterns: list[tuple[int, int]], n_rules: int = len(RULES), rounds: int = 200, prior: float = 0.8, strength: float = 0.05) -> LabelModel:
    """Expectation-maximisation over (pattern, count) of all documents.

    Starts from rules that are right four times in five.  The same belief stays
    as a Dirichlet prior that weighs ``strength`` of the documents, so that no
    rule changes sides.  No documents: the starting belief.
    """
    counts = np.array([c for _, c in sorted(patterns)], float)
    votes = np.array([[p // 3**k % 3 for k in range(n_rules)] for p, _ in sorted(patterns)], int).reshape(-1, n_rules)
    # [good or bad][rule][vote]: the belief at the start
    belief = np.array([[[0.03, 0.07, 0.90]] * n_rules, [[0.35, 0.10, 0.55]] * n_rules])
    table, total = belief.copy(), counts.sum()
    for _ in range(rounds if total else 0):
        score = np.log([prior, 1 - prior])[:, None] + sum(np.log(table[:, k, :][:, votes[:, k]]) for k in range(n_rules))
        good = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
        weight = np.stack([good, 1 - good]) * counts
        new = belief * (strength * total * np.array([prior, 1 - prior])[:, None, None] + 1)
        for k in range(n_rules):
            for v in range(3):
                new[:, k, v] += weight[:, votes[:, k] == v].sum(axis=1)
        new /= new.sum(axis=2, keepdims=True)
        last, prior = prior, float(np.clip((weight[0].sum() + 0.8) / (total + 1), 0.05, 0.95))
        done = abs(prior - last) < 1e-9 and np.abs(new - table).max() < 1e-9
        table = new
        if done:
            break
    odds = np.log(table[0] / table[1])
    return LabelModel(prior, tuple(tuple(float(x) for x in row) for row in odds))


def fit_label_model(measures: DataFrame) -> LabelModel:
    """Label model of all rows of ``measures``; what reaches the driver is a count for each of at most 3^rules patterns."""
    return fit_votes([(r[0], r[1]) for r in measures.groupBy(pattern().alias("p")).count().collect()])


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def judged(measures: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability) and kept."""
    return measures.withColumns({"base_failed": base_failed(), "quality": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns.

    A null or empty text has no words and is rejected; null keys and null
    columns pass through; repeated rows are judged each for itself; an empty
    table gives an empty table; a column named like a metric keeps its own
    value.  Two passes over the texts, no shuffle of them.
    """
    model = fit_label_model(measured(docs, [], text))
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row"), F.col(f"`{text}`").alias("__body"))
    kept = judged(measured(row, ["__row"], "__body"), model).filter("kept")
    return kept.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
