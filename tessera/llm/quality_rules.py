"""Quality rules of documents, and a verdict on the hosts they come from.

Each document is measured and held against rules.  Failures are counted by host and rule.  Each host's
failure rate of a rule is shrunk towards all hosts' with a beta prior fitted to the hosts
themselves (moments of the beta-binomial), one for each rule, and the verdicts are joined back: documents of a host
that mostly fails some rule are not kept, even where they pass themselves, and a document that fails a
rule which alone says little is not kept where its host is known for such failures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._tables import Tables

U64 = np.uint64
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Fewest words and most percent of words in repeated 3-word windows, of the base rules; highest shrunk failure rates of
    a host: for its documents to stay, and for one that fails the rule itself to stay."""

    least_words: int = 50
    most_repeat_percent: int = 50
    most_host_rate: float = 0.5
    known_rate: float = 0.02

    def rules(self) -> dict[str, str]:
        """Failures as SQL on MEASURES: the base rules, then those that alone say little."""
        return {
            "few_words": f"n_words < {self.least_words}", "repeats": f"100 * n_repeat_words > {self.most_repeat_percent} * n_words",
            "symbols": "5 * n_symbols > n_words", "repeated_lines": "n_dup_lines > 4", "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
        }


#: Rules that a document itself must not fail, whatever its host.
BASE_RULES = ("few_words", "repeats")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands twice or more, and whether it stands before as well."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, twice = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return again | twice, again


def _in_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ by document as well."""
    return T.mix(hashes + (doc.astype(U64) + U64(1)) * U64(T.WORD_BASE))


def measure(block: T.Block) -> dict[str, np.ndarray]:
    """MEASURES of each document of a block."""
    data, offsets, n = block.data, block.offsets, len(block)
    starts, ends, first = block.words()
    held = T.SPACED[data]
    out = {"n_words": np.diff(first), "word_chars": T.per_document(held & ((data & 0xC0) != 0x80), offsets), "n_symbols": T.per_document(_SYMBOLS[data], offsets)}

    prefix = T.byte_prefix(data)
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    line_starts, line_ends = cuts[:-1], cuts[1:]
    filled = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(held, out=filled[1:])
    some = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[some], line_ends[some]
    doc = np.searchsorted(offsets, line_starts, "right") - 1
    _, again = _repeated(_in_document(T.span_hashes(prefix, line_starts, line_ends), doc))
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)

    words = T.span_hashes(prefix, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.arange(max(len(starts) - 2, 0))
    at = at[doc[at] == doc[at + 2]]
    twice, _ = _repeated(_in_document(T.gram_hashes(T.word_prefix(words), at, at + 3), doc[at]))
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = T.per_document(covered, first)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(b) for b in T.blocks(batch.column("text"))]
        columns = [pa.array(np.concatenate([f[m] for f in found]) if found else [], type=pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source") -> DataFrame:
    """(doc_id, host, *MEASURES) for every row; null and empty texts measure zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(host) if isinstance(host, str) else host).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def beta_prior(hosts: int, rows: float, failed: float, squares: float, spread: float) -> tuple[float, float]:
    """Moments of a beta-binomial over hosts: hosts with rows n and failures f, where rows = sum(n),
    failed = sum(f), squares = sum(n * n) and spread = sum(f * f / n).  Where hosts differ no more than
    chance makes them, the prior is as heavy as all rows."""
    if not rows or failed <= 0 or failed >= rows or hosts < 2:
        return (failed + 0.5, rows - failed + 0.5) if rows else (0.5, 0.5)
    p = failed / rows
    chance = p * (1 - p)
    within = (spread - failed * p) - chance * (hosts - 1)
    room = chance * (rows - squares / rows - (hosts - 1))
    rho = within / room if room > 0 else 0.0
    rho = min(max(rho, 1 / (rows + 1)), 1 - 1e-9)
    weight = 1 / rho - 1
    return p * weight, (1 - p) * weight


def host_rates(marked: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(host, n_docs, n_failed_<rule>, rate_<rule>) of rows with `host` and a boolean column for each rule; rows without a host have no say."""
    by_host = marked.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"n_failed_{r}") for r in rules])
    n = F.col("n_docs").cast("double")
    sums = [x for r in rules for f in [F.col(f"n_failed_{r}").cast("double")] for x in (F.sum(f), F.sum(f * f / n))]
    hosts, rows, squares, *found = by_host.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * n), *sums).first()
    for i, r in enumerate(rules):
        a, b = beta_prior(hosts, rows or 0.0, found[2 * i] or 0.0, squares or 0.0, found[2 * i + 1] or 0.0)
        by_host = by_host.withColumn(f"rate_{r}", (F.col(f"n_failed_{r}") + F.lit(a)) / (n + F.lit(a + b)))
    return by_host


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, MEASURES (long), base_failed, kept (boolean), host, and rate_<rule> of the host.

    Words are `[^\\x20\\x09-\\x0D]+`; word_chars counts the code points in them, n_symbols the
    characters `#*$%&|<>`, n_dup_lines the \\n-split lines that have a word and equal an earlier
    line, n_repeat_words the words in 3-word windows that the text has twice or more.  Equality of
    lines and windows is that of 64-bit hashes inside one document.  Null and empty texts measure zero
    and so fail.  A row is kept if it fails no base rule, no rate of its host is over `most_host_rate`, and it fails no other rule of which its
    host's rate is over `known_rate`; a rate equal to a limit is not over it.  A row without a host is judged by the base rules alone (rates null); null ids are kept,
    repeated rows each count.  Other columns are not read.  An empty table gives an empty result.
    """
    tables, rules = Tables(docs.sparkSession, "quality"), limits.rules()
    found = measured(docs, id_col, text_col, host)
    marked = tables.written(found.select("*", *[F.expr(x).alias(r) for r, x in rules.items()]))
    rates = tables.written(host_rates(marked, tuple(rules)).select("host", *[f"rate_{r}" for r in rules]))
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | F.col(r)
    known = F.lit(False)
    for r in rules:
        rate = F.coalesce(f"rate_{r}", F.lit(0.0))
        known = known | (rate > limits.most_host_rate) | (F.col(r) & (rate > limits.known_rate))
    joined = marked.join(rates, "host", "left")
    return joined.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & ~known).alias("kept"), "host", *[f"rate_{r}" for r in rules])


def oracle(limits: Limits = Limits()) -> str:
    """DuckDB: what op6 returns, `kept` included."""
    rules = limits.rules()
    prior = ", ".join(
        f"CASE WHEN k < 2 OR f_{r} <= 0 OR f_{r} >= n THEN f_{r} + 0.5 ELSE f_{r} / n * (1 / rho_{r} - 1) END AS a_{r}, CASE WHEN k < 2 OR f_{r} <= 0 OR f_{r} >= n THEN n - f_{r} + 0.5 ELSE (1 - f_{r} / n) * (1 / rho_{r} - 1) END AS b_{r}" for r in rules
    )
    rho = ", ".join(
        f"CASE WHEN k >= 2 AND f_{r} > 0 AND f_{r} < n THEN least(greatest(CASE WHEN n - sq / n - (k - 1) > 0 THEN (sp_{r} - f_{r} * f_{r} / n - f_{r} / n * (1 - f_{r} / n) * (k - 1)) / (f_{r} / n * (1 - f_{r} / n) * (n - sq / n - (k - 1))) ELSE 0 END, 1 / (n + 1)), 1 - 1e-9) END AS rho_{r}" for r in rules
    )
    known = " OR ".join(f"coalesce(rate_{r}, 0) > {limits.most_host_rate} OR ({r} AND coalesce(rate_{r}, 0) > {limits.known_rate})" for r in rules)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
tri AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2])) AS g FROM w),
two AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM two, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, {", ".join(f"{x} AS {r}" for r, x in rules.items())} FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER ({r}) AS DOUBLE) AS f_{r}" for r in rules)} FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * n) AS sq, {", ".join(f"sum(f_{r}) AS f_{r}, sum(f_{r} * f_{r} / n) AS sp_{r}" for r in rules)} FROM h),
rho AS (SELECT *, {rho} FROM s),
pr AS (SELECT {prior} FROM rho),
v AS (SELECT source, {", ".join(f"(f_{r} + a_{r}) / (n + a_{r} + b_{r}) AS rate_{r}" for r in rules)} FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(BASE_RULES)} AS base_failed, NOT ({" OR ".join(BASE_RULES)}) AND NOT ({known}) AS kept
FROM f LEFT JOIN v USING (source)
"""
