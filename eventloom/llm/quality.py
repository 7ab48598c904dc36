"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection are estimated on a sample; rules then run in the order of rejection per cost, and a
document that one rule rejects reaches none of the later ones. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, quoted, words

#: Rows from the sample on which costs and rejections are estimated. It decides the order of the rules, never a verdict.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """fails(text) is true for a text that the rule rejects. Its work on a text is counted in plain passes over the
    characters, passes of them, and steps for each word."""

    name: str
    fails: Callable[[Column], Column]
    passes: float = 1.0
    word_steps: float = 0.0

    def work(self, text: Column) -> Column:
        return self.passes * F.length(text) + self.word_steps * n_words(text)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(w: Column) -> Column:
    """Words of the array w in windows of three that are found twice or more in it; w must be a plain column.

    Hashes of the windows are sorted with their places; a window that equals a neighbour is repeated; each repeated
    place adds the words up to the next one, three at most.
    """
    win = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    return F.coalesce(
        F.aggregate(
            F.array(F.sort_array(win)),  # bound once, as the lambda's variable
            F.lit(0).cast("long"),
            lambda n, s: n + _covered(F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))),
        ),
        F.lit(0).cast("long"),
    )


def _covered(places: Column) -> Column:
    step = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.coalesce(step, F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words of the whole text, 0 where it is null.

    Columns of docs with the name of a measure are replaced; all other names are free.
    """
    t = F.coalesce(F.col("doc")[text], F.lit(""))
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("words", words(t)).withColumn("lines", word_lines(t))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    made = {
        "n_words": long(F.size("words")),
        "word_chars": long(F.length(F.array_join("words", ""))),
        "n_symbols": long(n_symbols(t)),
        "n_dup_lines": long(F.size("lines") - F.size(F.array_distinct("lines"))),
        "n_repeat_words": long(repeat_words(F.col("words"))),
    }
    measured = split.select("doc", F.struct(*[e.alias(name) for name, e in made.items()]).alias("measures"))
    return measured.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in made], *[F.col("measures")[name].alias(name) for name in made])


def _with_words(text: Column, then: Callable[[Column], Column]) -> Column:
    """then(words), the words being found once."""
    return F.get(F.transform(F.array(words(text)), then), 0)


#: Limits set so that clean prose of any length over 50 words stays: junk has symbols on every word or shouts throughout.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("symbols", lambda t: n_symbols(t) * 5 > n_words(t), passes=2),
    Rule("capitals", lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")) * 10 > F.length(t) * 3, passes=1.2),
    Rule("repeated_lines", lambda t: F.get(F.transform(F.array(word_lines(t)), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x)), 0), passes=2.5),
    Rule("word_length", lambda t: _with_words(t, lambda w: ~F.length(F.array_join(w, "")).between(F.size(w) * 2, F.size(w) * 15)), passes=1.5, word_steps=4),
    Rule("repeated_words", lambda t: _with_words(t, lambda w: repeat_words(w) * 100 > F.size(w) * 50), passes=1.5, word_steps=40),
)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both from a sample; the given order decides ties.

    A rule's rejection is the number of sampled rows that it rejects, its cost the work on them, counted and not timed,
    so that the same table always gives the same order. The sample is those rows whose hash is divisible by the number
    that leaves about sample_rows of them, wherever they lie, and at most eight times as many where rows repeat: the
    order of the work depends on them, never a verdict.
    """
    share = max(1, docs.count() // max(sample_rows, 1))
    hashed = F.xxhash64(*[F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    sample = docs.where(F.pmod(hashed, F.lit(share)) == 0).select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("t")).limit(8 * sample_rows)
    t = F.col("t")
    found = sample.agg(*[f for k, rule in enumerate(rules) for f in (F.count_if(F.coalesce(rule.fails(t), F.lit(False))).alias(f"n{k}"), F.sum(rule.work(t)).alias(f"work{k}"))]).first()
    ranked = [(-(found[f"n{k}"] / max(found[f"work{k}"] or 0.0, 1.0)), k) for k in range(len(rules))]
    return [rules[k] for _, k in sorted(ranked)]


def verdict(text: Column, ordered: Sequence[Rule]) -> Column:
    """True if no rule rejects the text; CASE WHEN stops at the first that does. A null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    out = F.when(F.coalesce(ordered[0].fails(t), F.lit(False)), F.lit(False))
    for rule in ordered[1:]:
        out = out.when(F.coalesce(rule.fails(t), F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns. Null, empty and short texts go (few_words);
    repeated rows are judged alike; an empty table stays empty. The verdict doesn't depend on the order of the rules."""
    return docs.where(verdict(F.col(quoted(text)), order_rules(docs, rules, text, sample_rows)))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs, their measures, base_failed (under 50 words, or over half of them in repeated windows) and kept.

    Columns of the input that have the name of a result are replaced; all other names are free. The cascade judges what
    the base rules leave. Null and empty texts have no words and fail; repeated rows are judged alike and all stay in the
    table; an empty table stays empty.
    """
    measured = measures(docs, text)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rest = [r for r in order_rules(docs, rules, text, sample_rows) if r.name not in ("few_words", "repeated_words")]
    return measured.withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(F.col(quoted(text)), rest)))
