"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document. The ledger holds the measurements and one bit for
each rule that failed. A policy is a version and a mask of the rules that it enforces, so a new
policy reads the ledger and no text. Ablations come from a bitwise aggregation over the ledger.

Edge cases: a null or wordless text has no words, so it fails the rules on word counts; a rule whose
denominator would be 0 doesn't fail; a share just at its limit doesn't fail; repeated rows are judged
alike; texts are measured whole at any length, and arrays hold one text's words at most; an empty table
gives an empty ledger; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters")
#: Bit i of a ledger's failures is RULES[i]: a name and the SQL condition of failure.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("exclamations", "10 * n_bangs > 3 * n_words"),
    ("capitals", "10 * n_upper > 6 * n_letters"),
    ("no_letters", "2 * n_letters < word_chars"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int

    @classmethod
    def of(cls, version: str, *names: str) -> Policy:
        return cls(version, sum(BIT[n] for n in set(names)))


V1 = Policy.of("v1", "few_words", "repeated_windows", "symbols", "repeated_lines")
V2 = Policy("v2", (1 << len(RULES)) - 1)


def _hashes(words: str, n: int) -> Column:
    each = ", ".join(f"get({words}, i + {k})" for k in range(n))
    return F.expr(f"CASE WHEN size({words}) > {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({each})) ELSE array() END")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col and MEASURES. Windows that repeat are found by hash, and then counted by their words, so that a chance hit doesn't count."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.select(F.col(id_col), text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(common.SPACE))
    df = df.select(
        id_col,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != "").alias("_lines"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).alias("n_bangs"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).alias("n_letters"),
    )
    df = df.select("*", _hashes("_words", window).alias("_hashes"))
    df = df.select("*", (F.size(F.array_distinct("_hashes")) < F.size("_hashes")).alias("_again"))
    df = df.drop("_hashes").select("*",
        F.expr(f"CASE WHEN _again THEN array_sort(transform(sequence(0, size(_words) - {window}), i -> struct(array_join(slice(_words, i + 1, {window}), ' ') AS s, i AS i))) END").alias("_sorted"))
    df = df.select("*", F.expr("CASE WHEN _again THEN sort_array(transform(filter(sequence(0, size(_sorted) - 1), j -> coalesce(get(_sorted, j - 1).s = get(_sorted, j).s, false) OR coalesce(get(_sorted, j + 1).s = get(_sorted, j).s, false)), j -> get(_sorted, j).i)) ELSE array() END").alias("_at"))
    return df.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_at) > 0 THEN aggregate(sequence(0, size(_at) - 1), 0L, (n, k) -> n + least({window}, coalesce(get(_at, k + 1) - get(_at, k), {window}))) ELSE 0L END").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("n_bangs").cast("long"),
        F.col("n_upper").cast("long"),
        F.col("n_letters").cast("long"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() and failures (long): bit i is set where RULES[i] fails."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, (_, rule) in enumerate(RULES))
    return measure(df, id_col, text_col).select("*", F.expr(bits).alias("failures"))


def verdicts(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy (its version) and kept: no enforced rule failed."""
    return book.select("*", F.lit(policy.version).alias("policy"), (F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0).alias("kept"))


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """One row for each enforced rule: documents that fail it, that it alone rejects (which dropping it would keep), and that it rejects if it stands alone; with the policy's totals.

    First one partial count for each distinct failure mask, of which there are at most 2^rules; then sums over those masks.
    """
    masks = book.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    names = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in names))).alias("r")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return masks.select("m", "n", rules).groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        some(F.col("m").bitwiseAND(F.col("r.bit")) != 0)("failing"),
        some(F.col("m") == F.col("r.bit"))("only_this"),
        some(F.col("m") != 0)("rejected"),
        some(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0)("rejected_without"),
    )


def op2_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v2."""
    book = verdicts(ledger(common.documents(spark, sf_dir)), V2)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failures", "policy")


def rules_policies(spark, sf_dir: str) -> DataFrame:
    """Whether each policy keeps each document, from one ledger."""
    book = ledger(common.documents(spark, sf_dir)).select("doc_id", "failures")
    return verdicts(book, V1).unionAll(verdicts(book, V2)).select("doc_id", "policy", "kept")


def rules_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule does within either policy, over the ledger of all documents."""
    book = common.materialize(ledger(common.documents(spark, sf_dir)).select("failures"), "ledger")
    return ablation(book, V1).unionAll(ablation(book, V2))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, CAST((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (10 * n_bangs > 3 * n_words)::BIGINT + 32 * (10 * n_upper > 6 * n_letters)::BIGINT
        + 64 * (2 * n_letters < word_chars)::BIGINT + 128 * (word_chars > 20 * n_words)::BIGINT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, 'v2' AS policy FROM f
"""
_LEDGER = OP2_SQL[: OP2_SQL.rindex("SELECT doc_id")]
POLICIES_SQL = _LEDGER + "SELECT doc_id, 'v1' AS policy, (failures & 15) = 0 AS kept FROM f UNION ALL SELECT doc_id, 'v2', failures = 0 FROM f"
_NAMED = ", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(RULES))
ABLATION_SQL = _LEDGER + f""", p(policy, mask) AS (VALUES ('v1', 15), ('v2', 255)), u("rule", bit) AS (VALUES {_NAMED})
SELECT policy, "rule", count(*) FILTER (failures & bit <> 0) AS failing, count(*) FILTER (failures & mask = bit) AS only_this,
 count(*) FILTER (failures & mask <> 0) AS rejected, count(*) FILTER (failures & mask & ~bit <> 0) AS rejected_without
FROM f, p, u WHERE mask & bit <> 0 GROUP BY ALL"""
