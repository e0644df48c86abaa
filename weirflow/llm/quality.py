"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated from the votes alone.

No rule decides by itself. Expectation-maximisation over the table of vote patterns
(at most 3 ** rules rows, whatever the corpus) estimates how often each rule is right
about good and about bad documents; a document's posterior follows from its votes.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_WINDOW = 3  # words of a window that counts as repeated


def measures(docs: DataFrame) -> DataFrame:
    r"""One row of counts per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...

    Words are stretches without ASCII blanks; a null text has none. n_dup_lines counts the \n-split lines with a
    word that equal an earlier line, n_repeat_words the words in three-word windows found at least twice in the text.
    Also n_lines (lines with a word), n_distinct (different words), n_upper (upper-case letters), n_letters, n_runs
    (stretches of two marks or more), n_bare (words without letter and digit), n_marks (words that end in punctuation). Other columns are ignored; repeated rows are measured each.
    """
    words = F.col("words")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select(
        "doc_id", "text",
        F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    starts = F.slice(words, 1, F.greatest(F.size(words) - (_WINDOW - 1), F.lit(0)))
    gram = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, _WINDOW)])
    windows = split.select("*", F.transform(starts, lambda w, i: F.xxhash64(gram(w, i))).alias("hashes"))
    # Equal windows have equal hashes, so only documents with an equal pair of hashes compare the words.
    placed = F.sort_array(F.transform(starts, lambda w, i: F.struct(gram(w, i).alias("gram"), i.alias("at"))))
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    windows = windows.select("*", F.when(suspect, placed).otherwise(F.array()).alias("placed"))

    def twice(x: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.get(F.col("placed"), i + k)["gram"] == x["gram"], F.lit(False))
        return near(-1) | near(1)

    covered = F.transform(F.filter("placed", twice), lambda x: F.sequence(x["at"], x["at"] + _WINDOW - 1))
    matched = lambda regex: (F.length("text") - F.length(F.regexp_replace("text", regex, ""))).cast("long")
    return windows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        matched("\\p{Lu}+").alias("n_upper"),
        matched("\\p{L}+").alias("n_letters"),
        F.regexp_count("text", F.lit("[^\\p{L}\\p{N} \\t-\\r.]{2,}")).cast("long").alias("n_runs"),
        F.regexp_count("text", F.lit("(?:^|[ \\t-\\r])[^\\p{L}\\p{N} \\t-\\r]+(?=[ \\t-\\r]|$)")).cast("long").alias("n_bare"),
        F.regexp_count("text", F.lit("[.,;:!?](?=[ \\t-\\r]|$)")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    """Documents that fail whatever the rules say: too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _between(value: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """1 inside ``good``, 0 outside ``bad``, null (no vote) between the two or without a value."""
    return F.when(value.between(*good), 1).when(~value.between(*bad), 0)


def rules() -> dict[str, Column]:
    """Votes by rule: 1 for good, 0 for bad, null for no opinion. Shares are of words unless named otherwise."""
    per_word = lambda c: F.col(c) / F.nullif(F.col("n_words"), F.lit(0))
    few_lines = F.when(F.col("n_lines") >= 3, F.col("n_dup_lines") / F.col("n_lines"))
    enough = F.when(F.col("n_words") >= 20, per_word("n_distinct"))
    return {
        "symbols": _between(per_word("n_symbols"), (0, 0.02), (0, 0.1)),
        "repeats": _between(per_word("n_repeat_words"), (0, 0.1), (0, 0.4)),
        "lines": _between(few_lines, (0, 0.05), (0, 0.4)),
        "vocabulary": _between(enough, (0.5, 1), (0.2, 1)),
        "letters": _between(F.col("n_letters") / F.nullif(F.col("word_chars"), F.lit(0)), (0.95, 1), (0.93, 1)),
        "runs": _between(per_word("n_runs"), (0, 0.03), (0, 0.15)),
        "bare": _between(per_word("n_bare"), (0, 0.03), (0, 0.1)),
        "capitals": _between(F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0)), (0, 0.1), (0, 0.4)),
        "word_length": _between(per_word("word_chars"), (3.5, 6.5), (2.5, 12)),
        "marks": _between(per_word("n_marks"), (0.05, 0.35), (0.01, 0.6)),
    }


def learn(votes: DataFrame, names: list[str], rounds: int = 30) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and per rule how often it votes good on good and bad on bad ones.

    Starts from the share of good votes of each pattern. Counts are smoothed by one right and one wrong vote, so no
    rule becomes certain, and no rule is taken to be worse than chance, so good and bad cannot swap. The patterns
    are few whatever the corpus, so a round is one task; 2 * rules + 1 numbers reach the driver.
    """
    patterns = votes.groupBy(F.array(*names).alias("votes")).agg(F.count("*").alias("n"))
    patterns = materialize(patterns.coalesce(1), "patterns").coalesce(1)
    cast, good = F.size(F.array_compact("votes")), F.aggregate(F.array_compact("votes"), F.lit(0), lambda a, v: a + v)
    belief = F.when(cast > 0, good / cast).otherwise(0.5)
    prior, accuracy = 0.5, [(0.5, 0.5)] * len(names)
    p, n, vote = F.col("p"), F.col("n"), F.col("vote")
    of = lambda condition, weight: F.sum(F.when(condition, weight).otherwise(0.0))
    for _ in range(rounds):
        cases = patterns.select("n", belief.alias("p"), F.posexplode("votes").alias("rule", "vote"))
        rows = cases.groupBy("rule").agg(
            F.sum(n * p).alias("good"), F.sum(n).alias("all"),
            of(vote == 1, n * p).alias("right"), of(vote.isNotNull(), n * p).alias("on_good"),
            of(vote == 0, n * (1 - p)).alias("caught"), of(vote.isNotNull(), n * (1 - p)).alias("on_bad"),
        ).orderBy("rule").collect()
        if not rows:
            break
        before = [prior, *(x for pair in accuracy for x in pair)]
        prior = (rows[0]["good"] + 1) / (rows[0]["all"] + 2)
        rate = lambda hit, of: max(0.5, (hit + 1) / (of + 2))
        accuracy = [(rate(r["right"], r["on_good"]), rate(r["caught"], r["on_bad"])) for r in rows]
        belief = posterior(prior, accuracy)
        if max(abs(x - y) for x, y in zip(before, [prior, *(x for pair in accuracy for x in pair)], strict=True)) < 1e-4:
            break
    return prior, accuracy


def posterior(prior: float, accuracy: list[tuple[float, float]]) -> Column:
    """Probability that a document is good, given its array ``votes``; the prior where no rule votes."""
    says_good = F.lit([math.log(on_good / (1 - on_bad)) for on_good, on_bad in accuracy])
    says_bad = F.lit([math.log((1 - on_good) / on_bad) for on_good, on_bad in accuracy])
    weighed = F.transform("votes", lambda v, i: F.when(v == 1, F.get(says_good, i)).when(v == 0, F.get(says_bad, i)).otherwise(0.0))
    odds = F.aggregate(weighed, F.lit(math.log(prior / (1 - prior))), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, base_failed, quality (posterior) and kept per row of documents.

    kept is false where base_failed, else whether the posterior reaches ``threshold``. An empty table gives an empty
    result; a row without doc_id is judged like any other.
    """
    measured = materialize(measures(docs), "measures")
    votes = measured.select("*", *[v.alias(f"vote_{n}") for n, v in rules().items()])
    names = [f"vote_{n}" for n in rules()]
    prior, accuracy = learn(votes, names)
    votes = votes.withColumn("votes", F.array(*names))
    failed = votes.select("*", base_failed().alias("base_failed"), posterior(prior, accuracy).alias("quality"))
    return failed.select("*", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))
