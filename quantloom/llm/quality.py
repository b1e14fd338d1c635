"""Quality rules: one table of thresholds, compiled into one Spark projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that it for on with as was be by at from this are or an not "
    "der die das und ist von mit den dem des ein eine einer nicht auf für im zu sich auch "
    "le la les et est un une des du de que qui dans pour par sur pas avec au "
    "el los las una que en por con del se su para no lo y como más"
).split()

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= measure <= high; an open end is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_to_words", "n_symbols / n_words", None, 0.2),
    Rule("stop_words_to_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines_to_lines", "n_dup_lines / n_lines", None, 0.7),
    Rule("bullet_lines_to_lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_lines_to_lines", "n_ellipsis_lines / n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, so that lambdas inside body do not evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are compared by 64-bit hashes: sorted with their positions, equal neighbours mark repeated
    windows, and each repeated position adds the words that the one before does not cover."""
    size = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(words[i], F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    )

    def covered(sorted_windows: Column) -> Column:
        equal = lambda j, x: F.coalesce(F.get(sorted_windows, j)["h"] == x["h"], F.lit(False))
        repeated = F.filter(sorted_windows, lambda x, j: equal(j - 1, x) | equal(j + 1, x))
        positions = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(positions, start, step, lambda acc: acc["n"])

    def repeated_of(ws: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(ws, lambda x: x["h"])))
        return F.when(distinct == F.size(ws), F.lit(0).cast("long")).otherwise(_let(F.sort_array(ws), covered))

    return F.when(size < 4, F.lit(0).cast("long")).otherwise(_let(windows, repeated_of))


def measures(text: Column) -> Column:
    """A struct of what the rules read, of one whole text (null: no words, nothing counted)."""
    text = F.coalesce(text, F.lit(""))
    bare = r"^[\x20\x09-\x0D]*[-*•]"

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        by_line = _let(
            lines,
            lambda ls: F.struct(
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: x.rlike(bare))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(ls, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            ),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
            by_line.alias("by_line"),
        )

    return _let(F.array_remove(F.split(text, SPACE), ""), of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of base_failed, kept and the array of failed rules, from a struct of measures()."""
    value = {n: m[n] for n in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")}
    value |= {n: m["by_line"][n] for n in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}

    def broken(rule: Rule) -> Column:
        top, _, bottom = rule.measure.partition(" / ")
        x = value[top].cast("double") / F.nullif(value[bottom].cast("double"), F.lit(0.0)) if bottom else value[top].cast("double")
        out = F.lit(False)
        if rule.low is not None:
            out = out | (x < rule.low)
        if rule.high is not None:
            out = out | (x > rule.high)
        return F.coalesce(out, F.lit(False))

    base = (value["n_words"] < MIN_WORDS) | (100 * value["n_repeat_words"] > MAX_REPEAT_PERCENT * value["n_words"])
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))
    return F.struct(base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the identifier, the measures and the verdict.

    Null and empty texts have no words and fail the base rule. Repeated rows give repeated rows, an empty
    table an empty one; columns other than the two named are not read, so their names cannot clash."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    v = m.select("doc_id", "m", verdict(F.col("m"), rules).alias("v"))
    return v.select(
        "doc_id", *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")], F.col("m.by_line.n_dup_lines").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"), F.col("v.base_failed").alias("base_failed"), F.col("v.kept").alias("kept"), F.col("v.failed_rules").alias("failed_rules"),
    )


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs alone.

    The measures are bound inside one condition: a filter over a computed column would be pushed below it and
    evaluate them once for each mention."""
    return docs.where(_let(measures(F.col(text_col)), lambda m: verdict(m, rules)["kept"]))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows by relational SQL: words and windows as rows, counted by grouping."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def broken(r: Rule) -> str:
        top, _, bottom = r.measure.partition(" / ")
        x = f"({top}::DOUBLE / nullif({bottom}, 0))"
        tests = [f"{x} < {r.low}"] * (r.low is not None) + [f"{x} > {r.high}"] * (r.high is not None)
        return f"coalesce({' OR '.join(tests)}, false)"

    failed = ", ".join(f"CASE WHEN {broken(r)} THEN '{r.name}' END" for r in rules)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {white})) > 0) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules FROM f"""
