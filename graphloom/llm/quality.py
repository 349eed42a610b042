"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document.  The ledger keeps one bit a rule
and the measurements behind it, so a policy (a named mask of bits) is applied, or
another one compared, by integer operations without reading a text again.

Cases: a null or empty text has no words and fails `few_words`; a text of any length is measured
whole; measurements exactly at a rule's bound pass it; a null id keeps its row; repeated rows are
judged alike; an empty table gives an empty ledger; further columns, whatever they are called, are ignored
by `ledger` and kept by `accept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.shared import map_arrow, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims", "n_digits")
#: Bit, name, and when it fails, in the measurements; one and the same text serves the ledger and the checking SQL.
RULES = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "10 * n_symbols > 2 * n_words"),
    (3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    (4, "capitals", "10 * n_upper > 6 * n_letters"),
    (5, "exclamations", "2 * n_exclaims > n_words"),
    (6, "short_words", "word_chars < 2 * n_words"),
    (7, "long_words", "word_chars > 15 * n_words"),
    (8, "digits", "2 * n_digits > word_chars"),
)
BASE = 0b11
POLICIES = {"base": BASE, "surface.v1": 0b111111, "surface.v2": 0b111111111}
CURRENT = "surface.v2"

_SYMBOL, _UPPER, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])))


def bits_sql() -> str:
    return " + ".join(f"case when {when} then {1 << bit} else 0 end" for bit, _, when in RULES)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each document of a slice."""
    n = len(off) - 1
    starts, ends, wo = tc.spans(buf, off)
    out = {"n_words": np.diff(wo)}
    inside = ~tc.SPACE[buf]
    for name, mask in (("word_chars", inside & ((buf & 0xC0) != 0x80)), ("n_symbols", _SYMBOL[buf]), ("n_upper", _UPPER[buf]), ("n_letters", _LETTER[buf]), ("n_exclaims", buf == 33), ("n_digits", (buf >= 48) & (buf <= 57))):
        out[name] = tc.sums(mask.view(np.uint8), off)
    salt = tc.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    # words in windows of five that come twice
    at, per = tc.ngram_rows(wo, 5)
    edge = np.zeros(len(starts) + 1, np.int32)
    if len(at):
        twice = at[_repeats(tc.ngrams(tc.span_hashes(buf, starts, ends), 5)[at] ^ np.repeat(salt, per))]
        edge[twice] += 1
        np.subtract.at(edge, twice + 5, 1)
    out["n_repeat_words"] = tc.sums((np.cumsum(edge[:-1]) > 0).view(np.uint8), wo)

    # lines that hold a word
    nl = np.flatnonzero(buf == 10)
    full = off[1:] > off[:-1]
    begin = np.unique(np.concatenate([off[:-1][full], nl + 1]))
    begin = begin[begin < len(buf)]
    stop = np.append(begin[1:], len(buf))
    stop = stop - (buf[stop - 1] == 10) if len(begin) else stop
    held = np.searchsorted(starts, stop) > np.searchsorted(starts, begin) if len(begin) else np.zeros(0, bool)
    begin, stop = begin[held], stop[held]
    lo = np.searchsorted(begin, off)
    out["n_lines"] = np.diff(lo)
    keys = tc.span_hashes(buf, begin, stop) ^ np.repeat(salt, np.diff(lo))
    _, one = np.unique(keys, return_index=True)
    distinct = np.zeros(len(keys), np.uint8)
    distinct[one] = 1
    out["n_dup_lines"] = out["n_lines"] - tc.sums(distinct, lo)
    return out


def ledger(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits of every document; one pass, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in tc.slices(batches):
            m = measure(buf, off)
            yield pa.record_batch([tc.column(b, "doc_id"), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(failed(m))], names=["doc_id", *MEASURES, "failed_bits"])

    return map_arrow(texts(docs, doc, text), run, "doc_id long, " + ", ".join(f"{k} long" for k in (*MEASURES, "failed_bits")))


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits of measured documents."""
    bits = np.zeros(len(m["n_words"]), np.int64)
    for bit, _, when in RULES:
        bits |= np.where(eval(when, {}, m), 1 << bit, 0)  # one of RULES, not data
    return bits


def accept(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents, all columns, whose failure bits the base rules' and the policy's masks leave empty."""
    mask = POLICIES[policy] | BASE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in tc.slices(batches, text=text):
            yield b.filter(pa.array(failed(measure(buf, off)) & mask == 0))

    return docs.mapInArrow(run, docs.schema)


def judge(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and the policy's verdict."""
    bad = F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0
    return rows.withColumn("base_failed", bad).withColumn("kept", ~bad & (F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0))


def ablate(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many fail it, fail it alone, and what the policy would keep without it.

    The ledger is first counted by its bits, of which there are at most 2**rules.
    """
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if mask >> bit & 1)))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    bit = F.col("bit")
    return each.groupBy("rule").agg(n(F.col("bits").bitwiseAND(bit) != 0)("n_failed"), n(F.col("bits") == bit)("n_only"), n((F.col("bits") == 0) | (F.col("bits") == bit))("n_kept_without"))


def union_and_common(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Bits that any document fails and that all fail, for each group."""
    g = rows.groupBy(by) if by else rows.groupBy()
    return g.agg(F.bit_or("failed_bits").alias("any_bits"), F.bit_and("failed_bits").alias("all_bits"), F.count("*").alias("n"))


SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
base as (select rid, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as n_letters, length(text) - length(replace(text, '!', '')) as n_exclaims, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as n_digits from w),
lines as (select rid, unnest(string_split(text, chr(10))) as line from d),
held as (select rid, line from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
per_line as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from held group by rid),
win as (select rid, i, array_to_string(ws[i:i + 4], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, i + unnest(range(0, 5)) as p from twice) group by rid),
m as (select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_lines, 0) as n_lines, n_upper, n_letters, n_exclaims, n_digits from base left join per_line using (rid) left join rep using (rid)),
l as (select *, ({bits_sql()})::bigint as failed_bits from m)
select *, failed_bits & {BASE} <> 0 as base_failed, failed_bits & {BASE} = 0 and failed_bits & {POLICIES[CURRENT]} = 0 as kept from l
"""
