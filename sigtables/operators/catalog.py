"""Searches over pulses, properties, tags and text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtables.functions.scalars import finite
from sigtables.model import placed


def search_pulses(pulses: DataFrame, predicates: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """Pulses inside all closed ranges; NaN, infinities and nulls never match; a bound may be None."""
    if not predicates:
        raise ValueError("predicates: at least one")
    for key, lo, hi in predicates:
        c = F.col(key)
        pulses = pulses.where(finite(c))
        pulses = pulses.where(c >= lo) if lo is not None else pulses
        pulses = pulses.where(c <= hi) if hi is not None else pulses
    return pulses


def zone_maps(pulses: DataFrame, fields: Sequence[str]) -> DataFrame:
    """group_id, key, low and high of the finite values of each field of a group."""
    rows = pulses.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("v")) for f in fields])).alias("p"))
    return rows.where(finite(F.col("p.v"))).groupBy("group_id", F.col("p.key").alias("key")).agg(F.min("p.v").alias("low"), F.max("p.v").alias("high"))


def candidate_groups(zones: DataFrame, predicates: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """Groups whose zone maps may hold a match of every predicate."""
    test = F.lit(False)
    for key, lo, hi in predicates:
        c = F.col("key") == key
        c = c & (F.col("high") >= lo) if lo is not None else c
        test = test | (c & (F.col("low") <= hi) if hi is not None else c)
    return zones.where(test).groupBy("group_id").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len({p[0] for p in predicates})).select("group_id")


def property_index(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """id, key, num_value and txt_value of each property of a JSON object.

    What a value is goes by its JSON type: numbers and, as 0 and 1, booleans are numbers; strings are texts, also those that
    look like numbers; arrays and objects are texts of their JSON; nulls have no row. What isn't an object has none either.
    """
    v = F.try_parse_json(F.col(json_column))
    d = rows.select(F.col(id_column).alias("id"), v.alias("_j")).where(F.schema_of_variant("_j").startswith("OBJECT"))
    d = d.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_j").outer())).select("id", "key", "value", F.schema_of_variant("value").alias("kind"))
    number = F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("double")).when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    text = F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string")).when(number.isNull(), F.to_json("value"))
    return d.where("kind != 'VOID'").select("id", "key", number.alias("num_value"), text.alias("txt_value"))


@dataclass(frozen=True)
class PropertyTest:
    """What a property must be: numbers from low to high (either may be open), a text, or there at all if all are None."""

    low: float | None = None
    high: float | None = None
    equals: str | None = None


def parse_test(text: str) -> PropertyTest:
    """The test that a filter box's text means: nothing, x, =x, >=x, >x, <=x, <x, a..b or a word; > and < take in their bound."""

    def number(t: str) -> float | None:
        try:
            return float(t.strip().replace("_", "x"))
        except ValueError:
            return None

    t = text.strip()
    if not t:
        return PropertyTest()
    low, dots, high = t.partition("..")
    if dots and (number(low) is not None or number(high) is not None):
        return PropertyTest(number(low), number(high))
    for sign, name in ((">", "low"), ("<", "high")):
        x = number(t.removeprefix(sign).removeprefix("=")) if t.startswith(sign) else None
        if x is not None:
            return PropertyTest(**{name: x})
    t = t.removeprefix("=").strip()
    x = number(t)
    return PropertyTest(equals=t) if x is None else PropertyTest(x, x)


def find_signals(index: DataFrame, key: str, test: PropertyTest | str = PropertyTest()) -> DataFrame:
    """Ids whose property passes the test, from rows of property_index()."""
    t = parse_test(test) if isinstance(test, str) else test
    d = index.where(F.col("key") == key)
    if t.equals is not None:
        d = d.where(F.col("txt_value") == t.equals)
    elif t.low is not None or t.high is not None:
        d = d.where(F.col("num_value").isNotNull() & ~F.isnan("num_value"))
        d = d.where(F.col("num_value") >= t.low) if t.low is not None else d
        d = d.where(F.col("num_value") <= t.high) if t.high is not None else d
    return d.select("id").distinct()


def property_key_counts(index: DataFrame) -> DataFrame:
    """key and n: how many ids have each property."""
    return index.groupBy("key").agg(F.count_distinct("id").alias("n"))


def all_tags(tags: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Ids that have every wanted tag; none for no tags."""
    return tags.where(F.col("tag").isin(list(wanted))).groupBy("id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(wanted)) if wanted else F.lit(False)).select("id")


def tag_counts(tags: DataFrame, known: DataFrame) -> DataFrame:
    """tag and n of every known tag, 0 for those that nothing has."""
    return known.select("tag").distinct().join(tags.groupBy("tag").agg(F.count_distinct("id").alias("n")), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def text_search(rows: DataFrame, id_column: str, text_columns: str | Sequence[str], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, matches and score of rows where every term begins a word of any of the columns, without regard to case.

    matches: how many words terms begin. score: Okapi BM25 over the columns' words together, a term being all words that
    it begins: ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / mean words)), summed. No
    terms, no rows. One scan counts N, mean words and df; another, pruned by the terms, scores.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    columns = [text_columns] if isinstance(text_columns, str) else list(text_columns)
    text = F.concat_ws(" ", *[F.lower(F.col(c)) for c in columns])
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")
    d = rows.select(F.col(id_column).alias("id"), words.alias("w"))

    def beginning(term: str):
        return F.size(F.filter("w", lambda x: x.startswith(term)))

    d = d.select("id", F.size("w").alias("words"), *[beginning(t).alias(f"t{i}") for i, t in enumerate(terms)])
    if not terms:
        return d.select("id", F.lit(0).cast("long").alias("matches"), F.lit(0.0).alias("score")).where("false")
    counts = [F.col(f"t{i}") for i in range(len(terms))]
    whole = d.agg(F.count("*").alias("_n"), F.avg("words").alias("_mean"), *[F.count_if(c > 0).alias(f"_df{i}") for i, c in enumerate(counts)])
    for c in counts:
        d = d.where(c > 0)
    d = d.crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i, c in enumerate(counts):
        df = F.col(f"_df{i}")
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("words") / F.col("_mean")))
    return d.select("id", sum(counts[1:], counts[0]).cast("long").alias("matches"), score.alias("score"))


def sort_signals(signals: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By a column: texts without regard to case, unknown numbers last, all the other way round if descending."""
    c = F.lower(column) if dict(signals.dtypes)[column] == "string" else F.col(column)
    return signals.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_first())


def places(signals: DataFrame, column: str, ascending: bool = True, *ties: str) -> DataFrame:
    """signals with place, from 0 in the order of sort_signals(), ties by other columns; no task holds the whole table."""
    c = F.lower(column) if dict(signals.dtypes)[column] == "string" else F.col(column)
    return placed(signals, "place", c.asc_nulls_last() if ascending else c.desc_nulls_first(), *ties)


def content_classes(signals: DataFrame) -> DataFrame:
    """digest, copies and first signal of each distinct content; the digest is of the values' exact shortest texts."""
    text = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ",")
    return signals.withColumn("digest", F.sha2(text, 256)).groupBy("digest").agg(F.count("*").alias("copies"), F.min("signal_id").alias("signal_id"))


def content_classes_of_samples(samples: DataFrame, block: int = 1 << 16) -> DataFrame:
    """digest, copies and first signal, for signals of any length: blocks of samples are digested apart, then their digests in order."""
    d = samples.groupBy("signal_id", F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    d = d.select("signal_id", "block", F.sha2(F.array_join(F.transform("v", lambda x: F.coalesce(x["value"].cast("string"), F.lit("null"))), ","), 256).alias("h"))
    d = d.groupBy("signal_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ","), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("signal_id").alias("signal_id"))


@dataclass(frozen=True)
class Property:
    """A property's definition. kind: number, integer, frequency, duration, bool, text or one of `options`."""

    key: str
    kind: str
    low: float | None = None
    high: float | None = None
    max_length: int | None = None
    options: tuple[str, ...] = ()
    required: bool = False
    default: str | None = None


#: Words of a boolean property.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def property_errors(value: Column, p: Property) -> Column:
    """What is wrong with a property's text, or null. A missing value counts only where it is required and has no default.

    Frequencies and durations aren't negative unless the definition says so.
    """
    t = F.trim(value)
    missing = t.isNull() | (t == "")
    number = t.try_cast("double")
    low = 0.0 if p.low is None and p.kind in ("frequency", "duration") else p.low
    if p.kind in ("number", "integer", "frequency", "duration"):
        wrong = F.when(~F.coalesce(finite(number), F.lit(False)), "type")
        wrong = wrong.when(number != F.floor(number), "type") if p.kind == "integer" else wrong
        wrong = wrong.when(number < low, "too_low") if low is not None else wrong
        wrong = wrong.when(number > p.high, "too_high") if p.high is not None else wrong
    elif p.kind == "bool":
        wrong = F.when(~F.lower(t).isin(*TRUE, *FALSE), "type")
    elif p.kind == "enum":
        wrong = F.when(~t.isin(*p.options), "option")
    elif p.kind == "text":
        wrong = F.when(F.length(t) > p.max_length, "too_long") if p.max_length is not None else F.lit(None).cast("string")
    else:
        raise ValueError(f"{p.key}: no kind {p.kind}")
    return F.when(missing, "missing" if p.required and p.default is None else None).otherwise(wrong)


def property_value(value: Column, p: Property) -> tuple[Column, Column]:
    """(number, text) that a property's text means; a missing one means its default. Null where the text can't be read."""
    t = F.trim(value)
    t = F.when(t.isNull() | (t == ""), F.lit(p.default)).otherwise(t)
    if p.kind in ("number", "integer", "frequency", "duration"):
        n = t.try_cast("double")
        return F.when(finite(n) & ((n == F.floor(n)) if p.kind == "integer" else F.lit(True)), n), F.lit(None).cast("string")
    if p.kind == "bool":
        return F.when(F.lower(t).isin(*TRUE), 1.0).when(F.lower(t).isin(*FALSE), 0.0), F.lit(None).cast("string")
    return F.lit(None).cast("double"), F.when(t.isin(*p.options), t) if p.kind == "enum" else t


def typed_properties(rows: DataFrame, id_column: str, attributes: str, definitions: Sequence[Property]) -> DataFrame:
    """id, key, num_value and txt_value of every defined property of a map<string,string> that has a value or a default."""
    a = F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))
    read = [(p.key, *property_value(F.try_element_at(a, F.lit(p.key)), p)) for p in definitions]
    cells = F.array(*[F.struct(F.lit(k).alias("key"), n.alias("num_value"), t.alias("txt_value")) for k, n, t in read])
    return rows.select(F.col(id_column).alias("id"), F.explode(cells).alias("p")).select("id", "p.*").where("num_value IS NOT NULL OR txt_value IS NOT NULL")


def validate_properties(rows: DataFrame, id_column: str, attributes: str, definitions: Sequence[Property]) -> DataFrame:
    """id, key and error of every fault in a column of map<string,string>; a key without a definition is `unknown`."""
    if len({p.key for p in definitions}) < len(definitions):
        raise ValueError("definitions: a key stands twice")
    a = F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))
    known = [F.struct(F.lit(p.key).alias("key"), property_errors(F.try_element_at(a, F.lit(p.key)), p).alias("error")) for p in definitions]
    others = F.transform(F.filter(F.map_keys(a), lambda k: ~k.isin([p.key for p in definitions])), lambda k: F.struct(k.alias("key"), F.lit("unknown").alias("error")))
    found = F.filter(F.concat(F.array(*known), others) if known else others, lambda x: x["error"].isNotNull())
    return rows.select(F.col(id_column).alias("id"), F.explode(found).alias("e")).select("id", "e.*")
