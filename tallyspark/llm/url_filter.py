"""URL filtering by association rules over URL tokens.

Labelled URLs become baskets of tokens (host labels, the path's words; runs of digits are one token). Spark's
FP-growth mines the token sets, and rules "these tokens, so it is blocked" or "... allowed" are kept that reach a
support and are sure enough: a rule's hits count together with ``PRIOR`` URLs of the base rate, so that a few URLs prove
little, and the share must reach ``MIN_CONFIDENCE`` and a conviction against the base rate. A rule goes if one with
fewer of its tokens and the same verdict is as sure. Rules are matched through an inverted index: each is listed under
its rarest token, a URL's tokens fetch the rules listed under them, and a rule fires if the URL has all of its tokens;
the surest one tells the verdict. Explicit rules (host suffix and path prefix) come first.

Null and malformed URLs have an empty host and path and no tokens: the method allows them. Repeated rows are
judged each, null ids are carried along, extra columns are ignored, without labels nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize

#: (rule, verdict): host and all subdomains, and the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Least share of the labelled URLs that a rule holds for, least share of its URLs that have its label, least factor by which it errs more seldom than chance,
#: and URLs of the base rate that count besides its own.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_CONVICTION, PRIOR = 0.004, 0.6, 2.0, 4
#: Rules, and sets of tokens judged, that may be broadcast; more are joined by a shuffle.
BROADCAST_RULES = 10_000
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: h: host labels and their words, p: words of the path."""
    words = lambda c, mark: F.transform(
        F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]+", "#"), "[^a-z#]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x)
    )
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:")))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last, longest, asks first
        domain, _, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _index(rules: DataFrame) -> DataFrame:
    """rule_tokens, sure, label, token: each rule under its rarest token."""
    frequency = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    keyed = rules.select("tokens", "sure", "label", F.explode("tokens").alias("token")).join(frequency, "token")
    index = keyed.groupBy("tokens", "sure", "label").agg(F.min_by("token", F.struct("count", "token")).alias("token")).withColumnsRenamed({"tokens": "rule_tokens", "sure": "rule_sure", "label": "rule_label"})
    return F.broadcast(index) if rules.count() <= BROADCAST_RULES else index


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_conviction: float = MIN_CONVICTION, prior: float = PRIOR) -> DataFrame:
    """tokens, label (block or allow), sure. labelled: tokens array, blocked boolean."""
    label = F.when(F.col("blocked"), LABEL + "block").otherwise(LABEL + "allow")
    baskets = materialize(labelled.select(F.array_append("tokens", label).alias("items"), "blocked"), "baskets")
    total, bad = baskets.agg(F.count("*"), F.count_if("blocked")).first()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(0.5, min_confidence)).fit(baskets.select("items"))
    given = F.col("consequent")[0]
    hits = F.round(F.col("support") * total).cast("long")
    made = model.associationRules.where(given.startswith(LABEL)).select(F.array_sort("antecedent").alias("tokens"), F.substring(given, len(LABEL) + 1, 9).alias("label"), hits.alias("hits"), F.round(hits / F.col("confidence")).cast("long").alias("urls"))
    base = F.when(F.col("label") == "block", F.lit(bad / max(total, 1))).otherwise(F.lit((total - bad) / max(total, 1)))
    sure = (F.col("hits") + F.lit(float(prior)) * base) / (F.col("urls") + F.lit(float(prior)))
    kept = made.withColumns({"sure": sure, "base": base}).where((F.col("sure") >= min_confidence) & (F.lit(1.0) - F.col("base") >= (F.lit(1.0) - F.col("sure")) * min_conviction))
    found = materialize(kept.select("tokens", "label", "sure"), "url-rules")
    discard(baskets)
    if found.isEmpty():
        return found
    inner = found.select("tokens", "label", "sure", F.explode("tokens").alias("token")).join(_index(found), "token")
    as_sure = (F.size("rule_tokens") < F.size("tokens")) & (F.col("rule_label") == F.col("label")) & (F.col("rule_sure") >= F.col("sure"))
    superfluous = inner.where(as_sure & (F.size(F.array_except("rule_tokens", "tokens")) == 0)).select("tokens").distinct()
    return found.join(superfluous, "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """_row, matched (the tokens of the surest rule that fires) and found (its label) of the ``urls`` (tokens and a unique ``_row``) for which one fires."""
    posted = urls.select("_row", "tokens", F.explode("tokens").alias("token")).join(_index(rules), "token")
    fired = posted.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    order = F.struct("rule_sure", F.size("rule_tokens"), F.array_join("rule_tokens", " "))
    best = fired.groupBy("_row").agg(F.max_by(F.struct("rule_tokens", "rule_label"), order).alias("best"))
    return best.select("_row", F.array_join("best.rule_tokens", " ").alias("matched"), F.col("best.rule_label").alias("found"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, matched (the tokens of the mined rule that fired, in one string).

    labelled: url, blocked. Equal sets of tokens are matched once.
    """
    parts = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    row = F.array_join(F.array_sort("tokens"), " ").alias("_row")
    mined = materialize(mine_rules(parts(labelled).select("tokens", "blocked"), **mining), "mined-rules")
    judged = materialize(match_rules(parts(pages.select("url")).select(row, "tokens").dropDuplicates(["_row"]), mined), "judged-urls")
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_RULES else judged
    rows = parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).withColumn("_row", row)
    fit = explicit_rule(F.col("host"), F.col("path"), rules)
    return rows.join(judged, "_row", "left").select("page_id", "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], "found", F.lit("allow")).alias("verdict"), "matched")


def oracle_sql(rules=RULES) -> str:
    """The verdicts in DuckDB's dialect over pages and labels: token sets are counted by joins instead of grown."""
    words = "list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[0-9]+', '#', 'g'), '[^a-z#]+'), lambda x: x <> ''), lambda x: '{m}' || x)"
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        domain, _, prefix = rule.partition("/")
        fits.append((f"when (host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{prefix}') then", rule, verdict))
    case = lambda k: "case " + " ".join(f"{f[0]} '{f[k]}'" for f in fits) + " end"
    return (
        "with p as (select page_id, "
        f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages), "
        f"u as (select *, list_distinct(list_concat({words.format(c='host', m='h:')}, {words.format(c='path', m='p:')})) as tokens from p), "
        "b as (select row_number() over () as r, tokens, toxic = 1 as blocked from u join labels on doc_id = page_id where toxic is not null), "
        f"n as (select count(*) as n, count(*) filter (where blocked) as nb, ceil({MIN_SUPPORT} * count(*)) as least from b), "
        "i as (select t from (select unnest(tokens) as t from b), n group by t having count(*) >= any_value(least)), "
        "g as (select r, blocked, list_sort(list(t)) as ts from (select r, blocked, unnest(tokens) as t from b) join i using (t) group by r, blocked), "
        "s as (select blocked, list_filter(ts, lambda t, j: (m >> (j - 1)) & 1 = 1) as k from (select blocked, ts, unnest(range(1, (1 << len(ts))::bigint)) as m from g)), "
        "f as (select k, count(*) as c, count(*) filter (where blocked) as cb from s group by k), "
        "l as (select k, 'block' as label, c, cb as hits, nb / n as base, least from f, n union all select k, 'allow', c, c - cb, (n - nb) / n, least from f, n), "
        f"m as (select * from (select k, label, base, (hits + {float(PRIOR)} * base) / (c + {float(PRIOR)}) as sure from l where hits >= least and hits / c >= {min(0.5, MIN_CONFIDENCE)}) "
        f"where sure >= {MIN_CONFIDENCE} and 1.0 - base >= (1.0 - sure) * {MIN_CONVICTION}), "
        "kept as (select * from m where not exists (select 1 from m o where len(o.k) < len(m.k) and o.label = m.label and list_has_all(m.k, o.k) and o.sure >= m.sure)), "
        "hit as (select tokens, arg_max(array_to_string(k, ' '), (sure, len(k), array_to_string(k, ' '))) as matched, arg_max(label, (sure, len(k), array_to_string(k, ' '))) as found from (select distinct tokens from u) t join kept on list_has_all(t.tokens, k) group by tokens) "
        f"select page_id, host, path, {case(1)} as rule, coalesce({case(2)}, found, 'allow') as verdict, matched from u left join hit using (tokens)"
    )
