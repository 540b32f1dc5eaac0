"""Quality rules by weak supervision, in DataFrame expressions only."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.words import SPACE, WORD
from wordloom.plans.storage import written

WINDOW = 8
ROUNDS = 20
# A rule votes bad where its first condition holds, else good where its second does, else abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "false"),
    "markup": ("4 * n_symbols > n_words", "false"),
    "shouting": ("10 * n_shouted > n_words", "false"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "false"),
    "lines": ("10 * n_dup_lines > 4 * n_lines", "false"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 7 * n_words", "word_chars BETWEEN 4 * n_words AND 6 * n_words"),
    "stops": ("20 * n_stops > 7 * n_words OR (n_words >= 50 AND 100 * n_stops < n_words)",
              "50 * n_stops >= n_words AND 4 * n_stops <= n_words"),
    "length": ("n_words < 30", "n_words >= 50"),
}
VOTES = {"bad": -1, "abstain": 0, "good": 1}
# Before the first round: the share of good documents, and how often a rule votes each way on either kind.
START = {"prior": 0.8, "on_good": (0.02, 0.38, 0.6), "on_bad": (0.4, 0.4, 0.2)}


def _hashed_windows(hashes: str) -> Column:
    """Hashes of the 8-word windows: pairs of pairs of pairs of word hashes."""
    out, size, step = F.col(hashes), F.size(hashes), 1
    while step < WINDOW:
        size = size - step
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(size, F.lit(0))),
                         F.slice(out, F.lit(step + 1), F.greatest(size, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        step *= 2
    return F.when(F.size(hashes) >= WINDOW, out).otherwise(F.array().cast("array<bigint>"))


def _neighbours_equal(df: DataFrame) -> DataFrame:
    """Positions, in order, of windows whose hash occurs more than once: equal neighbours when sorted."""
    n = F.size("_sorted")
    df = df.withColumn("_same", F.zip_with(F.slice("_sorted", F.lit(1), n - 1), F.slice("_sorted", F.lit(2), n - 1),
                                           lambda a, b: a["h"] == b["h"]))
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, F.col("_same")), F.concat(F.col("_same"), no), lambda a, b: a | b)
    at = F.zip_with(F.col("_sorted"), either, lambda s, twice: F.when(twice, s["i"]))
    return df.withColumn("_at", F.sort_array(F.filter(at, lambda i: i.isNotNull())))


def base_measures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_shouted and n_stops, over the whole text.

    Nothing is exploded or shuffled. Windows are compared by hash, and only texts that repeat one sort
    their windows. A null text is empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern)).cast("bigint")

    df = docs.select(F.col(id), whole.alias("_text")).select(
        id, "_text", F.transform(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    df = df.select(
        id, F.size("_hashes").cast("bigint").alias("n_words"),
        (F.char_length("_text") - count(SPACE)).cast("bigint").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        count(r"\p{Lu}{3}").alias("n_shouted"), count(r"[.!?]+").alias("n_stops"),
        _hashed_windows("_hashes").alias("_windows"))
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = _neighbours_equal(df)
    after = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.lit(2 ** 31 - 1)))
    covered = F.aggregate(F.zip_with("_at", after, lambda p, q: F.least(q - p, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(
        "_windows", "_sorted", "_same", "_at")


def votes(measures: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """The measures with each rule's vote: -1 bad, 0 abstains, 1 good. On a text without words all abstain."""
    return measures.withColumns({f"vote_{name}": F.when(F.expr(bad) & (F.col("n_words") > 0), -1).when(
        F.expr(good) & (F.col("n_words") > 0), 1).otherwise(0) for name, (bad, good) in rules.items()})


def _start(names: list[str]) -> dict[str, float]:
    return {"prior": START["prior"]} | {f"{kind}_{vote}_{name}": START[kind][i] for name in names
                                        for kind in ("on_good", "on_bad") for i, vote in enumerate(VOTES)}


def posterior(model: dict[str, float], names: list[str]) -> Column:
    """The probability that a document is good, given its votes."""
    odds = F.lit(0.0)
    start = math.log(model["prior"] / (1 - model["prior"]))
    for name in names:  # one array per rule, indexed by its vote: rounds then share their compiled code
        weights = [start + math.log(model[f"on_good_{v}_{name}"] / model[f"on_bad_{v}_{name}"]) for v in VOTES]
        odds, start = odds + F.element_at(F.lit(weights), F.col(f"vote_{name}") + 2), 0.0
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """How often each rule is right, wrong or silent on good and on bad documents, and the share of good ones.

    Expectation-maximisation over all documents, without labels: they are counted by their votes once,
    which leaves at most 3 ** rules rows whatever the corpus; each round is one aggregate of that table.
    Counts are smoothed by one vote each way, so no rate reaches 0 or 1.
    """
    patterns, _ = written(voted.groupBy(*[f"vote_{name}" for name in names]).agg(F.count("*").alias("n")), "votes")
    cast = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"vote_{name}").alias("vote")) for name in names])
    model = _start(names)
    for _ in range(rounds):
        judged = patterns.coalesce(1).select("n", posterior(model, names).alias("q"), F.explode(cast).alias("cast"))
        sums = judged.groupBy("cast.rule", "cast.vote").agg(
            F.sum(F.col("n") * F.col("q")).alias("on_good"), F.sum(F.col("n") * (1 - F.col("q"))).alias("on_bad")).collect()
        if not sums:  # no documents
            break
        found = {(r.rule, r.vote): r for r in sums}
        whole = {kind: sum(r[kind] for r in sums if r.rule == names[0]) for kind in ("on_good", "on_bad")}
        model = {"prior": (1 + whole["on_good"]) / (2 + whole["on_good"] + whole["on_bad"])} | {
            f"{kind}_{vote}_{name}": (1 + (found[name, i][kind] if (name, i) in found else 0.0)) / (3 + whole[kind])
            for name in names for kind in whole for vote, i in VOTES.items()}
    return model


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str]] = RULES,
          rounds: int = ROUNDS) -> DataFrame:
    """One row per document: measures, votes, base_failed, p_good (posterior probability) and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not
    base_failed, and a posterior of 1/2 or more that the document is good.

    A null or empty text has no words and fails. Repeated rows and null ids are judged like any other;
    other columns are not read. An empty table gives an empty result.
    """
    voted, _ = written(votes(base_measures(docs, id, text), rules), "measures")
    model = fit(voted, list(rules), rounds)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "p_good": posterior(model, list(rules))}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def oracle(rules: dict[str, tuple[str, str]] = RULES, rounds: int = ROUNDS) -> str:
    """The same for DuckDB, from `documents`; each round is one query over the table of votes."""
    names = list(rules)
    word = r"[^\x20\x09-\x0D]+"

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(t, '{pattern}'))"

    vote = ", ".join(f"CASE WHEN n_words > 0 AND ({b}) THEN -1 WHEN n_words > 0 AND ({g}) THEN 1 ELSE 0 END AS vote_{n}"
                     for n, (b, g) in rules.items())
    odds = " + ".join(["ln(prior / (1 - prior))", *(
        f"CASE vote_{n} " + " ".join(f"WHEN {i} THEN ln(on_good_{v}_{n} / on_bad_{v}_{n})" for v, i in VOTES.items()) + " END" for n in names)])
    weight = {"on_good": "n * q", "on_bad": "n * (1 - q)"}
    step = ", ".join(["(1 + sum(n * q)) / (2 + sum(n)) AS prior", *(
        f"(1 + sum(CASE WHEN vote_{n} = {i} THEN {w} ELSE 0 END)) / (3 + sum({w})) AS {k}_{v}_{n}"
        for n in names for k, w in weight.items() for v, i in VOTES.items())])
    start = ", ".join(f"{value}::DOUBLE AS {name}" for name, value in _start(names).items())
    rows = ", ".join(f"vote_{n}" for n in names)
    em = ",\n".join(f"model{i} AS MATERIALIZED (SELECT {step} FROM (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS q "
                    f"FROM patterns, model{i - 1}))" for i in range(1, rounds + 1))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{word}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
spots AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM spots) WHERE c > 1),
gaps AS (SELECT doc_id, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM
  (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  {count('[#*$%&|<>]')} AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(gaps.n, 0)::BIGINT AS n_repeat_words, {count('\\p{Lu}{3}')} AS n_shouted, {count('[.!?]+')} AS n_stops
  FROM split LEFT JOIN gaps USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {vote} FROM base),
patterns AS MATERIALIZED (SELECT {rows}, count(*) AS n FROM voted GROUP BY ALL),
model0 AS (SELECT {start}),
{em},
judged AS (SELECT voted.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  1 / (1 + exp(-({odds}))) AS q FROM voted, model{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept
FROM judged"""
