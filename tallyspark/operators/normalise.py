"""Units, signs and expectations: what a figure is stated in, and whether it fits the concept it was filed under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shapes of scale idioms and the scale each names (null: the word itself), and signs of currencies in the order in which they are tried.
SCALE_IDIOMS = (
    (r"(?<![0-9.])['’`]0{3}[,.]0{3}", "million"), (r"(?<![0-9.])['’`]0{3}", "thousand"), ("百萬|百万", "million"), ("千元", "thousand"), ("億|亿", "hundred million"), ("萬|万", "ten thousand"),
    (r"(?i)\b(thousands?|lakhs?|lacs?|millions?|mn|crores?|cr|billions?|bn)\b", None),
)
CURRENCIES = (
    ("₹", "INR"), ("rs.", "INR"), ("inr", "INR"), ("hk$", "HKD"), ("hkd", "HKD"), ("港幣", "HKD"), ("港币", "HKD"), ("港元", "HKD"), ("rmb", "CNY"), ("cny", "CNY"), ("人民幣", "CNY"), ("人民币", "CNY"),
    ("us$", "USD"), ("usd", "USD"), ("新台幣", "TWD"), ("新台币", "TWD"), ("日圓", "JPY"), ("日元", "JPY"), ("$", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"),
)
#: Concepts that must be unsigned together, faces read for units, and the confidence of a figure of the wrong sign.
COHORT, FACES, WRONG_SIGN = 3, 12, 0.35
CELL = ("doc_id", "basis", "period_label")


def scale_label(text: Column) -> Column:
    """The scale that a text names first."""
    found = []
    for i, (pattern, label) in enumerate(SCALE_IDIOMS):
        at = F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0))
        word = F.lit(label) if label else F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), "s$", "")
        found.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(i).alias("i"), word.alias("label"))))
    return F.array_min(F.array_compact(F.array(*found)))["label"]


def currency(text: Column) -> Column:
    low, out = F.lower(text), F.lit(None).cast("string")
    for sign, code in reversed(CURRENCIES):
        out = F.when(low.contains(sign), code).otherwise(out)
    return out


def document_units(pages: DataFrame) -> DataFrame:
    """doc_id, scale, currency: of the first text that names a scale, front matter (the first two pages) before the faces; the first currency up to there.

    pages: doc_id, page_index, kind (FACE or another), text. Of faces the first twelve are read, which is the rule. Without any scale the first currency counts.
    """
    front = pages.where("page_index < 2").groupBy("doc_id").agg(F.lit(-1).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    face = pages.where("kind = 'FACE'").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index"))).where(F.col("_n") <= FACES)
    texts = front.unionByName(face.select("doc_id", F.col("page_index").cast("int").alias("at"), "text"))
    rows = texts.select("doc_id", "at", scale_label(F.col("text")).alias("s"), currency(F.col("text")).alias("c"))
    first = rows.withColumn("_s", F.min(F.when(F.col("s").isNotNull(), F.col("at"))).over(Window.partitionBy("doc_id")))
    seen = (F.col("at") <= F.col("_s")) | F.col("_s").isNull()
    return first.groupBy("doc_id").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("scale"), F.min_by("c", F.when(F.col("c").isNotNull() & seen, F.col("at"))).alias("currency"))


def declared_unit(caption: Column, signals: dict[str, str]) -> Column:
    """What a heading is stated in, by a rulebook's signals; the longest that occurs."""
    low, out = F.lower(caption), F.lit(None).cast("string")
    for signal in sorted(signals, key=len):
        out = F.when(low.contains(signal.lower()), signals[signal]).otherwise(out)
    return out


def restated(caption: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(caption).rlike("|".join(markers)), F.lit(False))


def money(c: Column) -> Column:
    """A printed amount; a percentage is none, whatever figures it holds."""
    from tallyspark.functions.numbers import parse_number

    return F.when(~c.contains("%"), parse_number(c))


def negate_unsigned(facts: DataFrame, negative: tuple[str, ...]) -> DataFrame:
    """``facts`` with negated: where a statement's expenses (figures that aren't 0 or signed before) are all positive, over three concepts at least, they become negative.

    facts: doc_id, statement, canonical_key, value, sign_normalised.
    """
    one = F.col("canonical_key").isin(*negative) & (F.col("value") != 0) & ~F.col("sign_normalised")
    w = Window.partitionBy("doc_id", "statement")
    unsigned = F.min(F.when(one, F.col("value") > 0)).over(w) & (F.size(F.collect_set(F.when(one, F.col("canonical_key"))).over(w)) >= COHORT)
    rows = facts.withColumn("negated", one & F.col("statement").isNotNull() & F.coalesce(unsigned, F.lit(False)))
    return rows.withColumn("value", F.when(F.col("negated"), -F.col("value")).otherwise(F.col("value"))).withColumn("sign_normalised", F.col("sign_normalised") | F.col("negated"))


def check_expectations(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """``facts`` with sign_confidence, flag, and canonical_key null where a balance stands for a flow or the like.

    facts: statement, canonical_key, value. expected: canonical_key, statement, sign (positive_expected, negative_expected or null), temporality,
    unit_of_account. What a statement holds is what its concepts say alike; subtotals say nothing. Figures themselves don't change.
    """
    units = F.array_sort(F.collect_set(F.when(F.col("unit_of_account") != "subtotal", F.col("unit_of_account"))))
    shape = expected.where("statement is not null").groupBy("statement").agg(F.when(F.count_distinct("temporality") == 1, F.max("temporality")).alias("_t"), units.alias("_u"))
    rows = facts.join(F.broadcast(expected.drop("statement")), "canonical_key", "left").join(F.broadcast(shape), "statement", "left")
    wrong = (F.col("value") != 0) & ((F.col("sign") == "positive_expected") & (F.col("value") < 0) | (F.col("sign") == "negative_expected") & (F.col("value") > 0))
    t = F.when(F.col("temporality") != F.col("_t"), F.concat(F.lit("temporality:"), "temporality", F.lit("!="), "_t"))
    foreign = (F.col("unit_of_account") != "subtotal") & (F.size("_u") > 0) & ~F.array_contains("_u", F.col("unit_of_account"))
    u = F.when(foreign, F.concat(F.lit("unit_of_account:"), "unit_of_account", F.lit("!="), F.array_join("_u", "/")))
    reasons = F.concat_ws(",", t, u)
    rows = rows.withColumn("reasons", reasons).withColumn("wrong_sign", F.coalesce(wrong, F.lit(False)))
    out = rows.withColumn("filed_key", F.col("canonical_key")).withColumn("canonical_key", F.when(F.col("reasons") == "", F.col("canonical_key")))
    return out.withColumn("sign_confidence", F.when(F.col("wrong_sign"), WRONG_SIGN).otherwise(1.0)).drop("_t", "_u", "temporality", "unit_of_account", "sign")


def contradicts_section(rows: DataFrame, signs: dict[str, str]) -> DataFrame:
    """doc_id, line, contradicts: whether all of a line's figures that aren't 0 have the sign that its section's concepts never have. signs: section to its sign."""
    sign = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv])[F.col("section")]
    v = F.when(F.col("value") != 0, F.col("value"))
    against = F.when(sign == "positive_expected", v < 0).when(sign == "negative_expected", v > 0)
    return rows.withColumn("_a", against).groupBy("doc_id", "line").agg(F.coalesce(F.bool_and("_a"), F.lit(False)).alias("contradicts"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, never less than 0."""
    return F.greatest(F.lit(0), F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")))


def presented(figures: DataFrame, rates: DataFrame, target: str, factor: float = 1.0) -> DataFrame:
    """``figures`` (currency, figure) with shown, in the target currency and unit; null where there is no rate. rates: base, rate into the target."""
    rows = figures.join(rates.select(F.col("base").alias("currency"), F.col("rate").alias("_r")), "currency", "left")
    rate = F.when(F.col("currency") == target, 1.0).otherwise(F.col("_r"))
    return rows.withColumn("shown", F.col("figure") * rate / factor).drop("_r")


def display(value: Column, unit: Column) -> Column:
    """A ratio as shown: 1.25×, 12.5%, 37.0 days; nothing is a dash."""
    shown = value.cast("string")
    return F.when(value.isNull(), "—").when(unit == "%", F.concat(shown, F.lit("%"))).when(unit == "days", F.concat(shown, F.lit(" days"))).otherwise(F.concat(shown, F.lit("×")))
