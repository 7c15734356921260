"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined cases: null or blank texts have no words, fail the base rule and are not kept. Repeated rows are
judged one by one. Extra columns pass through; where one has the name of an output column, the output wins.
Texts of any length are judged whole. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import let, words

WINDOW = 8

#: Frequent function words of the corpus languages, compared with words as they stand.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at this have from or by an not "  # en
    "de la le et les des en un une du que est pour dans qui sur au avec pas ce il plus "  # fr
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an "  # de
    "el los las del se por con una su para al lo como y"  # es
)


@dataclass(frozen=True)
class Rule:
    """Keep a text while lo <= 1000 * part / whole <= hi, in whole numbers."""

    name: str
    part: str
    whole: str
    lo: int | None = None
    hi: int | None = None

    def failed(self) -> str:
        tests = []
        if self.lo is not None:
            tests.append(f"1000 * {self.part} < {self.lo} * {self.whole}")
        if self.hi is not None:
            tests.append(f"1000 * {self.part} > {self.hi} * {self.whole}")
        return "(" + " OR ".join(tests) + ")"


RULES = (
    Rule("word_length", "word_chars", "n_words", lo=1500, hi=20000),
    Rule("symbols", "n_symbols", "n_words", hi=100),
    Rule("exclamation", "n_exclaim", "n_words", hi=200),
    Rule("stop_words", "n_stop", "n_words", lo=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", hi=500),
)


def base_failed_sql() -> str:
    return "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " OR ".join(["base_failed", *(r.failed() for r in rules)])


def repeat_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur at least twice in the text.

    Windows are hashed, sorted with their starts, and kept where a neighbour is equal; the union of the
    kept intervals is the sum of the gaps between their sorted starts, each cut at n.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - s, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(pairs: Column) -> Column:
        same = lambda x, k: x["h"] == F.get(pairs, k)["h"]
        twice = F.filter(pairs, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of(wins: Column) -> Column:
        pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), let(pairs, repeated)).otherwise(F.lit(0).cast("long"))

    wins = F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    return F.when(F.size(hashes) > n, let(wins, of)).otherwise(F.lit(0).cast("long"))


def lines_of(text: str) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def evaluated(df: DataFrame, *cols: Column) -> DataFrame:
    """df with more columns, each evaluated once for a row.

    A filter on a column of a projection is moved below it and evaluates the column's expression again, with
    all that it refers to. Filters stay above a generator, so the columns are the one row of an inlined array.
    """
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the counts that the rules need, one output row for each input row."""
    stop = list(dict.fromkeys(STOP_WORDS.split()))
    own = ("n_words", "word_chars", "n_symbols", "n_exclaim", "n_stop", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "_t", "_w", "_l", "_h")
    kept = [c for c in docs.columns if c.lower() not in own]
    cols = [f"`{c}`" for c in kept]
    split = evaluated(docs.select(*cols, F.col(text).alias("_t")), words(F.col("_t")).alias("_w"), lines_of("_t").alias("_l"))
    hashed = evaluated(split, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    t = F.coalesce("_t", F.lit(""))
    return evaluated(
        hashed,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaim"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long").alias("n_stop"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).alias("n_repeat_words"),
    ).drop("_t", "_w", "_l", "_h")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs plus counts, base_failed and kept."""
    return (
        measure(docs, text)
        .select("*", F.expr(base_failed_sql()).alias("base_failed"))
        .select("*", (~F.expr(verdict_sql(rules))).alias("kept"))
    )


SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, list_aggregate(w[s:s + {WINDOW - 1}], 'string_agg', ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS s) WHERE len(w) >= {WINDOW}
), twice AS (
  SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - s, {WINDOW})))::BIGINT AS n
  FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT x) AS n_kinds
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaim,
    len([x for x in w if x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS.split()))})])::BIGINT AS n_stop,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - n_kinds, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (SELECT *, {base_failed_sql()} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT ({verdict_sql()}) AS kept FROM b
"""
