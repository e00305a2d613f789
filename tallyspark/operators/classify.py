"""Kinds of pages from their lines: titles of statements, features, scores of states, scope and confidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements with the patterns that name one by themselves, and those that count where a line is a title by its words.
TITLES = (
    ("changes_in_equity", (
        r"statements?\s+of\s+changes\s+in\s+[a-z'’\s]{0,28}equity", r"statements?\s+of\s+(?:shareholders|owners|stockholders|equity\s+holders)'?’?\s*equity",
        r"statements?\s+of\s+changes\s+in\s+net\s+assets", r"[權权]益[變变][動动][報报]?表",
    ), (r"changes\s+in\s+[a-z'’\s]{0,28}equity",)),
    ("cash_flow", (r"statements?\s+of\s+cash\s?flows?", r"cash\s?flows?\s+statements?", r"[現现]金流[量動动][報报]?表"), (r"cash\s?flows?",)),
    ("balance_sheet", (
        r"statements?\s+of\s+financial\s+(?:position|condition)", r"balance\s+sheets?", r"statements?\s+of\s+assets\s+and\s+liabilities",
        r"[資资][產产][負负][債债][報报]?表", r"[財财][務务][狀状][況况][報报]?表",
    ), (r"financial\s+position",)),
    ("comprehensive_income", (
        r"statements?\s+of\s+(?:other\s+)?comprehensive\s+(?:income|loss|expenses?)", r"(?:其他)?全面(?:收益|收入|[虧亏][損损])[報报]?表", r"其他[綜综]合收益[報报]?表",
    ), (r"(?:other\s+)?comprehensive\s+(?:income|loss)",)),
    ("profit_and_loss", (
        r"statements?\s+of\s+profit\s+(?:or|and|&)\s+loss(?:es)?", r"statements?\s+of\s+(?:loss|profit|income|earnings|operations)(?:es|s)?\b", r"income\s+statements?",
        r"profit\s+and\s+loss\s+accounts?", r"[損损]益[表報报賬帳账]", r"[利][潤润][報报]?表", r"[虧亏][損损][報报]?表", r"收益[報报]?表", r"[經经][營营][業业][績绩][報报]?表",
    ), (r"profit\s+(?:or|and|&)\s+loss(?:es)?",)),
)
#: What makes a line a title by its words, what no title says, summaries, and titles that are of two statements or of either.
ANCHOR = r"(?i)statements?\s+of|balance\s+sheets?|income\s+statements?|profit\s+and\s+loss\s+accounts?"
NO_TITLE = (
    r"(?i)notes?\s+to\s+the\b|notes?\s+to\s+(?:consolidated|financial)\b|notes\s+forming\s+part\s+of|附\s*[註注]|\.{3,}|·{3,}|…|\bpages?\s+\d+|\bset\s+out\s+(?:on|in)\b|\brefer(?:\s+to)?\b"
    r"|\bin\s+our\s+opinion\b|\bwe\s+have\s+audited\b|\bas\s+described\s+in\b|\breconciliation\s+of\b|\bextract(?:ed|s)?\s+from\b|\bsummar(?:y|ised)\b|\bpro\s+forma\b|[備备]考"
    r"|\bunaudited\s+supplementary\b|[載载][於于]|[見见]\s*[附第]|[第]\s*\d+\s*[頁页]|^\s*(?:contents|index|目[錄录])\s*$"
)
SUMMARY = r"(?i)\bsummar(?:y|ies)\b|\bhighlights?\b|\bextract(?:ed|s)?\s+from\b|[摘概][要要]|[概][覽览]"
COMBINED = (
    r"(?i)\b(?:profit\s+(?:or|and|&)\s+loss(?:es)?|loss(?:es)?|income|operations)\b[^\n]{0,24}\band\s+other\s+comprehensive\s+(?:income|loss)\b"
    r"|[損损]益及其他(?:全面|[綜综]合)(?:收益|[虧亏][損损])|[虧亏][損损]及其他(?:全面|[綜综]合)(?:收益|[虧亏][損损])|收益及其他全面收益"
)
EITHER = r"[綜综]合收益[報报]?表"
#: Running headers, banners of notes, back matter, prose of reports, headings of notes, and what scopes are called.
RUNNING = r"(?i)annual report|interim report|年報|年度報告|中期報告"
NOTES_BANNER = (
    r"(?i)notes?\s+to\s+(?:the\s+)?(?:consolidated\s+|unconsolidated\s+|standalone\s+)?financial\s+statements|notes?\s+to\s+(?:the\s+)?accounts|notes\s+forming\s+part\s+of\s+the"
    r"|(?:material|significant)\s+accounting\s+polic|[財财][務务][報报]?表?附\s*[註注]|[合併合并綜综]+[財财][務务][報报]表附\s*[註注]|(?:重要|主要)[會会][計计]政策"
)
BACK_MATTER = r"(?i)five[\s-]?year\s+(?:financial\s+)?summary|financial\s+(?:summary|highlights)|[五][年][財财][務务][摘概][要要]|[財财][務务][摘概][要要]"
NARRATIVE = (
    r"(?i)\bin\s+our\s+opinion\b|\bwe\s+have\s+audited\b|\bindependent\s+auditor|\bdirectors'?\s+report\b|\bkey\s+audit\s+matters?\b|\bbasis\s+for\s+opinion\b"
    r"|[核][數数][師师][報报][告告]|[董][事][會会][報报][告告]|[獨独][立][核][數数][師师]"
)
NOTE_ONE = r"(?m)^\s*(?:note\s*)?1[.)、]?\s+[A-Za-z一-鿿]{2,}"
NOTE_HEADING = r"(?m)^\s*(?:note\s*)?\d{1,2}[.)、]?\s+[A-Za-z一-鿿]{2,}"
CORPORATE = r"(?:limited|ltd\.?|plc|inc\.?|incorporated|corporation|corp\.?|holdings?|group|company|companies|pte|llc|llp|s\.?a\.?|n\.?v\.?|a\.?g\.?)"
CONSOLIDATED = rf"(?i)\bconsolidated\b|\bgroup\b(?!\s+{CORPORATE}\b)|[合][併并]|綜合|综合(?!收益|[損损]益|全面|[虧亏][損损])"
COMPANY = rf"(?i)\bcompany\b(?!\s+{CORPORATE}\b)|\bthe\s+bank\b(?!\s+{CORPORATE}\b)|\bparent\b|\bstandalone\b|\bunconsolidated\b|[母][公][司]|[本][公][司]"
NUMBER = r"\(?-?[\d,]+\.?\d*\)?"
#: Lines of a title zone, lines and characters of a joined title, share of a title that its name is, titles that make a list of contents, and how dense figures are.
ZONE, JOIN_LINES, JOIN_CHARS, COVERAGE, CONTENTS, DENSE = 8, 3, 90, 0.35, 3, 0.18


def heading_like(t: Column) -> Column:
    """A short line that doesn't end like a sentence, with at most one figure."""
    s = F.trim(t)
    ends = s.rlike(r"[.;:,。，、；：]$")
    return (s != "") & (F.length(s) <= 110) & ~ends & (F.regexp_count(s, F.lit(NUMBER)) <= 1) & (F.regexp_count(s, F.lit("[0-9]")) <= 8)


def title_zone(lines: Column) -> Column:
    """The first lines of a page, without its number and running header. lines: array of structs (y, text)."""
    stays = lambda x: (F.trim(x["text"]) != "") & ~F.trim(x["text"]).rlike(r"^\d{1,4}$") & ~x["text"].rlike(RUNNING)
    return F.slice(F.filter(lines, stays), 1, ZONE)


def title_candidates(zone: Column) -> Column:
    """Lines like headings, and what runs of them begin with, joined as far as a title goes."""
    own = F.filter(zone, lambda x: heading_like(x["text"]))

    def joined(x, i):
        first = heading_like(x["text"]) & ((i == 0) | ~F.coalesce(heading_like(F.get(zone, i - 1)["text"]), F.lit(False)))
        start = F.struct(x["text"].alias("text"), F.lit(True).alias("open"))
        more = lambda a, y: F.when(a["open"] & heading_like(y["text"]) & (F.length(a["text"]) + F.length(y["text"]) + 1 <= JOIN_CHARS), F.struct(F.concat(a["text"], F.lit(" "), y["text"]).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open")))
        text = F.aggregate(F.slice(zone, i + 2, JOIN_LINES - 1), start, more)["text"]
        return F.when(first & (text != x["text"]), F.struct(x["y"].alias("y"), text.alias("text")))

    return F.concat(own, F.filter(F.transform(zone, joined), lambda x: x.isNotNull()))


def _best_name(text: Column) -> Column:
    """struct (n, name) of the longest pattern that is most of a line; of equal ones that listed first; n is 0 if none is."""
    found = []
    for i, (name, strong, weak) in enumerate(TITLES):
        hit = lambda p: F.length(F.regexp_extract(text, f"(?i)({p})", 1))
        n = F.greatest(*[hit(p) for p in strong], F.when(text.rlike(ANCHOR), F.greatest(*[hit(p) for p in weak], F.lit(0))).otherwise(0))
        found.append(F.struct(F.when(n >= COVERAGE * F.length(text), n).otherwise(0).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
    return F.array_max(F.array(*found))


def resolve_title(candidates: Column) -> Column:
    """struct (statement, combined, title, ambiguous) of a page: the topmost title, of equally high ones the longest name; none on a page that names three statements."""
    fit = F.filter(candidates, lambda c: ~c["text"].rlike(NO_TITLE) & ~c["text"].rlike(SUMMARY))
    named = F.filter(F.transform(fit, lambda c: F.struct(c["y"].alias("y"), _best_name(c["text"]).alias("b"), c["text"].alias("text"))), lambda c: c["b"]["n"] > 0)
    names = F.array_distinct(F.transform(named, lambda c: c["b"]["name"]))
    first = F.array_min(F.transform(named, lambda c: F.struct(c["y"].alias("y"), (-c["b"]["n"]).alias("n"), c["b"]["name"].alias("name"), c["text"].alias("text"))))
    combined = first["text"].rlike(COMBINED)
    statement = F.when(combined | (first["name"] == "comprehensive_income"), "profit_and_loss").otherwise(first["name"])
    out = F.struct(statement.alias("statement"), combined.alias("combined"), first["text"].alias("title"), (first["text"].rlike(EITHER) & ~combined).alias("ambiguous"))
    return F.when((F.size(names) > 0) & (F.size(names) < CONTENTS), out)


def page_features(lines: DataFrame) -> DataFrame:
    """A row for each page: statement, title, combined, ambiguous, scope, columns and the flags that scores are made of.

    lines: doc_id, page_index, line_no, text, y (share of the height). A page's lines are an array in one row.
    """
    page = lines.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct("y", "text").alias("l")))).alias("ls"))
    page = page.withColumn("ls", F.transform("ls", lambda x: x["l"]))
    page = page.withColumn("text", F.array_join(F.transform("ls", lambda x: x["text"]), "\n")).withColumn("zone", title_zone(F.col("ls")))
    page = page.withColumn("head", F.array_join(F.transform("zone", lambda x: x["text"]), " ")).withColumn("found", resolve_title(title_candidates(F.col("zone"))))
    page = page.withColumn("narrative", F.col("head").rlike(NARRATIVE) | F.substring("text", 1, 1500).rlike(NARRATIVE))
    page = page.withColumn("found", F.when(~F.col("narrative"), F.col("found"))).withColumn("strong_title", F.col("found.statement").isNotNull())
    tokens = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda t: t != "")
    density = F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: t.rlike(f"^{NUMBER}$"))), F.size(tokens)), F.lit(0.0))
    band = F.array_join(F.transform(F.filter("ls", lambda x: x["y"] <= 0.42), lambda x: x["text"]), " ")
    columns = F.array_compact(F.array(F.when(band.rlike(r"(?i)\bgroup\b|[本][集][團团]"), "consolidated"), F.when(band.rlike(r"(?i)\bcompany\b|\bbank\b|[本][公][司]"), "company")))
    title = F.col("found.title")
    scope = F.when(F.size(columns) == 2, "mixed").when(title.rlike(CONSOLIDATED), "consolidated").when(title.rlike(COMPANY), "company")
    return page.select(
        "doc_id", "page_index", "found.statement", "found.title", F.coalesce("found.combined", F.lit(False)).alias("combined"), F.coalesce("found.ambiguous", F.lit(False)).alias("ambiguous"), scope.alias("scope"), F.array_join(columns, ",").alias("columns"),
        "strong_title", "narrative", F.col("head").rlike(NOTES_BANNER).alias("notes_banner"), (F.col("text").rlike(NOTE_HEADING) & ~F.col("strong_title")).alias("note_heading"),
        (F.col("text").rlike(NOTE_ONE) & ~F.col("strong_title")).alias("note_one"), F.col("head").rlike(BACK_MATTER).alias("back_matter"), density.alias("density"),
    )


def page_scores(features: DataFrame) -> DataFrame:
    """``features`` with the score of each state: how well a page's own evidence fits it (fixed values)."""
    w = lambda flag, n: F.when(F.col(flag), float(n)).otherwise(0.0)
    dense = F.when(F.col("density") >= DENSE, 1.0).otherwise(0.0)
    note = F.when(F.col("note_heading") | F.col("note_one"), 3.0).otherwise(0.0)
    return features.withColumns({
        "PRE": 1.0 + w("narrative", 2) - w("strong_title", 3) - w("notes_banner", 3) - dense,
        "FACE": w("strong_title", 6) + dense - w("narrative", 6) - w("notes_banner", 4) - note - w("back_matter", 4),
        "NOTES": w("notes_banner", 6) + w("note_one", 4) + w("note_heading", 2.5) + dense * 0.5 - w("strong_title", 4) - w("narrative", 5) - w("back_matter", 4),
        "POST": F.when(F.col("back_matter"), 6.0).otherwise(-2.0),
    })


def margins(scored: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """``scored`` (state and a score for each) with margin, the state's score over the best other, and confidence."""
    at = lambda s: F.greatest(*[F.col(o) for o in states if o != s])
    margin = functools.reduce(lambda out, s: F.when(F.col("state") == s, F.col(s) - at(s)).otherwise(out), states, F.lit(None).cast("double"))
    return scored.withColumn("margin", margin).withColumn("confidence", confidence(F.col("margin")))


def confidence(margin: Column) -> Column:
    return F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.30), 0.5 + margin / 20.0)), 4)


def run_scopes(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page_index, state, statement, scope) with scope filled on face pages: one past the notes that shows again a statement
    shown as the group's before, without a scope of its own, is the company's; other untitled face pages take the one before them."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("doc_id", "statement").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    notes = F.coalesce(F.max(F.col("state") == "NOTES").over(w), F.lit(False))
    shown = F.coalesce(F.max((F.col("state") == "FACE") & F.coalesce(F.col("scope") == "consolidated", F.lit(False))).over(same), F.lit(False))
    own = F.when(F.col("scope").isNotNull(), F.col("scope")).when((F.col("state") == "FACE") & F.col("statement").isNotNull() & notes & shown, "company")
    rows = pages.withColumn("_own", own)
    run = F.sum(F.when(F.col("state") != "FACE", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run)
    carried = F.last("_own", True).over(Window.partitionBy("doc_id", "_run").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("scope", F.when(F.col("state") == "FACE", carried).otherwise(F.col("_own"))).drop("_own", "_run")
