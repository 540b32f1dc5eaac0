"""Personal data: fixed patterns, and terms that reveal what they match, in DataFrame expressions only."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.plans.storage import written

# Equal to the plain patterns in what they match, without backtracking over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}"
_CHUNK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def weigh(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    fits = F.char_length(digits).between(12, 19)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return F.when(fits, total % 10 == 0).otherwise(False)


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}"),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def _running(sizes: str) -> Column:
    """Sums up to and including each element, in chunks so that no array is copied for each element."""
    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, F.array().cast("array<int>"), lambda done, x: F.concat(
            done, F.array(F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(0) + x)))

    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"(size({sizes}) - 1) div {_CHUNK}")),
                         lambda c: within(F.slice(F.col(sizes), (c * _CHUNK + 1).cast("int"), F.lit(_CHUNK))))

    def after(done: Column, chunk: Column) -> Column:
        base = F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(0)
        return F.concat(done, F.array(base + F.element_at(chunk, -1)))

    ends = F.aggregate(chunks, F.array().cast("array<int>"), after)
    before = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(before) - 1),
                                lambda chunk, base: F.transform(chunk, lambda x: x + base)))


def with_matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds `name`: (start, end, value) of each leftmost match, in code points."""
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    gaps = F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), F.col("_m"), lambda p, m: F.char_length(p) + F.char_length(m))
    df = df.withColumn("_gaps", gaps)
    df = df.withColumn("_ends", F.when(F.size("_gaps") > 0, _running("_gaps")).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_zip", F.arrays_zip(F.col("_m").alias("m"), F.col("_ends").alias("e")))
    return df.withColumn(name, F.transform("_zip", lambda z: F.struct(
        (z["e"] - F.char_length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("value")))).drop(
        "_m", "_p", "_gaps", "_ends", "_zip")


def _span(kind: str, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"))


def _holding(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: _HOLDS[kind](s["value"]))


def _spans(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: _span(kind, s))


def _entities(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.xxhash64(F.lit(kind), F.lower(s["value"])))


def find_entities(docs: DataFrame, text: str) -> DataFrame:
    """All columns, `base` (sorted spans of the four kinds) and `entities` (keys of their distinct values)."""
    found = []
    for kind, pattern in PATTERNS.items():
        docs = with_matches(docs, text, pattern, f"_{kind}")
        docs = docs.withColumn(f"_{kind}", _holding(kind))
        found.append(kind)
    spans = F.sort_array(F.concat(*map(_spans, found)))
    values = F.array_distinct(F.concat(*map(_entities, found)))
    counts = {f"n_{k}": F.size(f"_{k}").cast("bigint") for k in found}
    return docs.withColumns({"base": spans, "entities": values, **counts}).drop(*[f"_{k}" for k in found])


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def _terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))


def revealing_terms(docs: DataFrame, found: DataFrame, text: str, threshold: float, support: int) -> DataFrame:
    """(_row, terms): words of a text that give away most of the information of an entity in it.

    Every word of a text with an entity is a candidate. All counts are of distinct texts, so copies
    count once: N in all, df(term), df(entity), and co with both. A term's disclosure is their pointwise
    mutual information over the entity's own information, log(N co / (df(term) df(entity))) /
    log(N / df(entity)). Terms with a disclosure of `threshold` or more are returned if co is at
    least `support` and large enough that texts met by chance would not do: (df(entity) / N) ** co is
    at most 1 / N.
    """
    plain, _ = written(docs.groupBy("_row").agg(F.first(text).alias(text)), "texts")
    n = math.log(max(2, plain.count()))
    keys = F.transform(_terms(text), lambda w: F.xxhash64(w))
    df_term = plain.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("df_term"))
    df_term, _ = written(df_term.filter(F.col("df_term") >= support), "frequencies")
    units, _ = written(found.groupBy("_row").agg(F.first("entities").alias("entities"), F.first(text).alias(text)), "units")
    of = units.select("_row", F.explode("entities").alias("entity"))
    df_entity = of.groupBy("entity").agg(F.count("*").alias("df_entity")).filter(F.col("df_entity") >= support)
    of, _ = written(of.join(df_entity, "entity").withColumn("own", n - F.log("df_entity")).filter("own > 0"), "holders")
    # a term's disclosure is at most that of co = df(entity): more frequent ones need no counting
    most = of.groupBy("_row").agg(F.max(n - threshold * F.col("own")).alias("most"))
    words = units.join(most, "_row").select("_row", "most", F.explode(_terms(text)).alias("term"))
    words = words.withColumn("key", F.xxhash64("term")).join(df_term, "key").filter(F.log("df_term") <= F.col("most") + 1e-9)
    words, _ = written(words.select("_row", "term", "df_term"), "words")
    met = of.join(words, "_row").filter(F.log("df_term") <= n - threshold * F.col("own") + 1e-9)
    counted = met.groupBy("entity", "term").agg(F.count("*").alias("co"), F.first("df_term").alias("df_term"),
                                                F.first("df_entity").alias("df_entity"), F.first("own").alias("own"))
    disclosed = n + F.log("co") - F.log("df_term") - F.log("df_entity")
    told = counted.filter((F.col("co") >= support) & (F.col("co") * F.col("own") >= n) & (disclosed >= threshold * F.col("own") - 1e-9))
    told, _ = written(told.select("entity", "term"), "told")
    return of.join(told, "entity").join(words, ["_row", "term"]).groupBy("_row").agg(F.collect_set("term").alias("terms"))


def find_private(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 2) -> DataFrame:
    """One row per document: id, _row, _text, n_email, n_ip, n_card, n_phone, base and spans (sorted spans).

    base: leftmost non-overlapping matches of each kind that pass its test. spans: also the terms of
    `revealing_terms`, wherever they stand in the document outside of base spans. _text is the text
    where anything was found, else null.

    A null text is empty. Rows of one id are told apart by a hash of their texts (_row); repeated rows
    stay and get the same spans. Null ids are kept. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    measured = find_entities(rows, "_text").withColumn("_text", F.when(F.size("base") > 0, F.col("_text")))
    measured, _ = written(measured, "entities")
    private = measured.filter("_text IS NOT NULL")
    told, _ = written(revealing_terms(rows, private, "_text", threshold, support), "terms")
    empty = F.array().cast("array<string>")
    termed = private.join(told, "_row", "left").withColumn("terms", F.coalesce("terms", empty))
    worded = with_matches(termed.withColumn("_look", F.when(F.size("terms") > 0, F.col("_text")).otherwise("")), "_look", TERM, "_words")
    shown = F.filter("_words", lambda w: F.array_contains("terms", F.lower(w["value"])) & ~F.exists(
        "base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    more = worded.withColumn("_shown", F.transform(shown, lambda w: _span("term", w)))
    counts = [f"n_{k}" for k in PATTERNS]
    full = more.select("id", "_row", "_text", *counts, "base", F.sort_array(F.concat("base", "_shown")).alias("spans"))
    plain = measured.filter("_text IS NULL").select("id", "_row", "_text", *counts, "base", F.col("base").alias("spans"))
    return full.union(plain).withColumnRenamed("id", id)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    return found.select(id, *[f"n_{k}" for k in PATTERNS], F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def generalised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.when(F.size(done) > 0, last["end"]).otherwise(0) > s["start"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(spans, empty, merge)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(state: Column, s: Column) -> Column:
        kept = text.substr(state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.concat(state["parts"], F.array(kept, F.element_at(kinds, s["rank"] + 1))).alias("parts"), s["end"].alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    return F.aggregate(merged, start, put, lambda state: F.concat(
        F.array_join(state["parts"], ""), text.substr(state["at"] + 1, F.lit(2 ** 31 - 1))))


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents, all columns, with personal data and revealing terms generalised to their kinds.

    Documents in which nothing was found stay as they are, null texts too.
    """
    found = find_private(docs, id, text, **settings).filter("size(spans) > 0").select(
        F.col(id).alias("_id"), "_row", generalised(F.col("_text"), F.col("spans")).alias("_clean")).distinct()
    found, _ = written(found, "sanitised")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_of"), F.xxhash64(text).alias("_hash"))
    joined = whole.join(found, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    return joined.select(*[F.coalesce("_clean", f"_doc.{c}").alias(c) if c == text else F.col(f"_doc.{c}") for c in docs.columns])
