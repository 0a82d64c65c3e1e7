"""Quality rules judged by host: rule failures of the documents, a shrunken failure rate of each host, verdicts joined back.

A document fails a base rule, or stands on a rejected host. The failure rate of host ``h`` for a rule has the posterior
``Beta(failures + a, documents - failures + b)``; ``a`` and ``b`` are fitted to all hosts by moments, so a host with few documents
is drawn to the corpus rate and can't be rejected by one bad page. A host is rejected when, for some rule, the lower bound of
its rate (mean less ``caution`` standard deviations) is above a limit that the prior gives: the rate with ``multiple`` times the
odds of the corpus rate, and ``floor`` at least, since a host's good documents go with it. Where all hosts fail alike, as if
documents were dealt to them at random, no host is rejected.

Defined results. Null text: no words, fails ``short``. Empty text: the same. Null host: a host of its own. Repeated rows: each
counts and each is returned. Empty table: empty result. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import map_arrow, stage, text_slices

_NO_WORD_BYTES = bytes([0x20, 9, 10, 11, 12, 13, *range(0x80, 0xC0)])  # blanks, and bytes that continue a code point
_SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five counts of one UTF-8 text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # bytes split at exactly the six blanks
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            reach = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return n, len(text.translate(None, _NO_WORD_BYTES)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def _measured(batches):
    for rows, texts in text_slices(batches, "_text"):
        counts = zip(*map(measure, texts.to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, pa.int64()) for c in counts)], ["_id", "_host", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: ``_id``, ``_host`` and the five counts."""
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    return map_arrow(narrow, _measured, "_id long, _host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_rules(min_words: int = 50, max_repeat_percent: int = 50) -> dict[str, Column]:
    """The rules a document must pass by itself."""
    return {"short": F.col("n_words") < min_words, "repetitive": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")}


def host_rules() -> dict[str, Column]:
    """The rules whose failures are counted by host; the base rules and three signs of machine-made pages."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base_rules() | {
        "symbols": F.col("n_symbols") > 0.1 * words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        "lines": 10 * F.col("n_dup_lines") > words,
    }


@dataclass(frozen=True)
class BetaPrior:
    a: float
    b: float


def fit_priors(hosts: DataFrame, rules: list[str]) -> dict[str, BetaPrior]:
    """A beta prior for each rule from the moments of the hosts' rates; one row of sums comes to the driver.

    The spread that counting alone would give is taken off the variance; a + b is held between 2 and 10,000.
    """
    rate = lambda r: F.col(f"f_{r}") / F.col("n")
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.avg(1 / F.col("n")).alias("inverse")]
    for r in rules:
        sums += [F.sum(f"f_{r}").alias(f"f_{r}"), F.avg(rate(r)).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}")]
    row = hosts.agg(*sums).first()
    priors = {}
    for r in rules:
        m = ((row[f"f_{r}"] or 0) + 0.5) / ((row["n"] or 0) + 1)
        spread = (row[f"v_{r}"] or 0.0) - m * (1 - m) * (row["inverse"] or 0.0)
        strength = min(max(m * (1 - m) / spread - 1, 2.0), 10_000.0) if spread > 0 else 10_000.0
        priors[r] = BetaPrior(m * strength, (1 - m) * strength)
    return priors


#: Odds of failure that reject a host, as a multiple of the corpus'; the least rate that does; standard deviations taken off.
MULTIPLE, FLOOR, CAUTION = 3.0, 0.25, 2.0


def host_verdicts(measures: DataFrame, rules: dict[str, Column], multiple: float = MULTIPLE, floor: float = FLOOR, caution: float = CAUTION) -> DataFrame:
    """One row a host: documents, highest posterior rate of any rule, ``host_ok``. Partial sums come before the shuffle."""
    hosts = stage(measures.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules.items())), "hosts")
    priors = fit_priors(hosts, list(rules))
    rates, sound = [], F.lit(True)
    for r, p in priors.items():
        rate = (F.col(f"f_{r}") + p.a) / (F.col("n") + p.a + p.b)
        corpus = p.a / (p.a + p.b)
        limit = max(multiple * corpus / (1 + (multiple - 1) * corpus), floor)
        sound = sound & (rate - caution * F.sqrt(rate * (1 - rate) / (F.col("n") + p.a + p.b + 1)) <= limit)
        rates.append(rate)
    worst = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return hosts.select(F.col("_host").alias("_judged"), F.col("n").alias("host_docs"), worst.alias("host_rate"), sound.alias("host_ok"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """Counts, base verdict and host verdict of every document.

    Texts are read once; the counts (some 60 bytes a row) are staged. The host table joins by shuffle, where adaptive
    execution broadcasts it if its measured size allows and splits the partition of a hot host.
    """
    measures = stage(measured(docs, id_col, text_col, host_col), "measures")
    hosts = host_verdicts(measures, host_rules(), **limits)
    failed = base_rules()
    base = failed["short"] | failed["repetitive"]
    joined = measures.join(hosts, F.col("_host").eqNullSafe(F.col("_judged")), "left")
    return joined.select(
        F.col("_id").alias("doc_id"), *MEASURES, base.alias("base_failed"), (~base & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"), "host_rate", "host_ok",
    )
