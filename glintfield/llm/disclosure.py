"""Personal data and the words that give it away, in DataFrame functions alone.

Personal data are emails, IP addresses, card and phone numbers, found by patterns and confirmed by their rules
(`KINDS`). Each distinct value is a protected entity. Words beside it may reveal it even where it is
removed: a word t discloses an entity c by PMI(c; t) / IC(c), with

    PMI(c; t) = ln(p(c, t) / (p(c) p(t))),    IC(c) = -ln p(c),

1 where every document that has t has c beside it, and 0 where they are independent. p(t) is the share of all
documents that have the word, p(c) of those that have the entity, p(c, t) of those where t stands within
`CONTEXT` characters of c, without other personal data in between. In documents that hold c, the words beside it
with a disclosure of `remove_at` or more are removed and those of `generalise_at` or more are
generalised to their class (a number, a name, a word), if the two are together in `support` documents at least;
a document without personal data is left alone.

Plan: one pass over the texts finds the spans; what stands beside them (a small part of the text) becomes
pairs of word and entity, counted in aggregates that combine before their shuffle. A second pass counts
the documents of the candidate words only: those in `support` pairs. They are broadcast while they are at most
`broadcast_terms` (checked by a count), else met in a shuffle. Documents meet their words' spans by
a number given when the spans were written; texts are not shuffled.

Matches do not overlap within a kind, leftmost first; failing ones are dropped and consumed. The patterns are the
contract's with possessive loops and starts that are not inside a run, which match the same and take a time in
proportion to the text.

Defined cases: a null text counts as empty and has no spans; documents without spans have empty ones; rows
that repeat an id (or null ids) are documents of their own; an empty table gives an empty result;
columns besides id and text are dropped; the entity that all documents hold (IC 0) is disclosed by no word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintfield.llm.common import discard, settled

CONTEXT = 100
LOCAL = "A-Za-z0-9._%+-"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind: what a text must contain, the pattern.
KINDS = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TERM = r"[\p{L}\p{N}]++"
GAP = r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' checksum is right."""
    digits = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    if kind == "card":
        return F.char_length(_digits(value)).between(16, 19) & _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def entity(kind: Column, value: Column) -> Column:
    """What counts as one protected value: letter case and separators do not tell values apart."""
    plain = F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.concat(kind, F.lit(":"), plain)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(lengths: Column, block: int = 64) -> Column:
    """The sums of all elements before each: inside blocks and of the blocks before, for arrays of any length."""
    part = lambda all_of, b: F.slice(all_of, b * block + 1, F.lit(block))
    before = lambda numbers: F.transform(numbers, lambda _, i: _total(F.slice(numbers, F.lit(1), i)))

    def sums(all_of: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(all_of) / block).cast("int") - 1)
        totals = F.transform(blocks, lambda b: _total(part(all_of, b)))
        inside = lambda ahead: F.transform(ahead, lambda start, b: let(part(all_of, b), lambda own: F.transform(before(own), lambda x: x + start)))
        return F.flatten(let(let(totals, before), inside))

    return let(lengths, lambda all_of: F.when(F.size(all_of) > 0, sums(all_of)).otherwise(F.array().cast("array<int>")))


def located(found: Column, pieces: Column) -> Column:
    """Matches as structs (start, end, value, before, after) in code points; pieces: the text split at them."""
    starts = running_sums(F.transform(found, lambda x, i: F.char_length(x) + F.char_length(F.get(pieces, i))))

    def span(x: Column, i: Column, starts: Column) -> Column:
        start = F.get(starts, i) + F.char_length(F.get(pieces, i))
        return F.struct(start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("value"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"))

    return let(starts, lambda s: F.transform(found, lambda x, i: span(x, i, s)))


LOCATED = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _kept(kind: str, spans: Column) -> Column:
    """The confirmed ones, with their kind."""
    named = lambda s: F.struct(F.lit(kind).alias("kind"), *(s[x].alias(x) for x in ("start", "end", "value", "before", "after")))
    return F.transform(F.filter(spans, lambda s: confirmed(kind, s["value"])), named)


def personal_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(row, id, spans): a number for each row, its id, and the confirmed spans by kind and start. Settle it: row holds for one run."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"found_{k}": F.when(F.contains("text", F.lit(need)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none) for k, (need, pattern) in KINDS.items()})
    rows = rows.withColumns({f"pieces_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", pattern, -1)).otherwise(none) for k, (_, pattern) in KINDS.items()})
    rows = rows.withColumns({f"spans_{k}": F.when(F.size(f"found_{k}") > 0, located(F.col(f"found_{k}"), F.col(f"pieces_{k}"))) for k in KINDS})
    kept = [_kept(kind, F.coalesce(f"spans_{kind}", F.array().cast(LOCATED))) for kind in KINDS]
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.concat(*kept).alias("spans"), *(["text"] if keep_text else []))


def words_beside(spans: DataFrame) -> DataFrame:
    """spans(row, spans) as (row, entity, term, start, end): the words in an entity's context."""
    each = spans.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = order.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"free_from": F.coalesce(F.max("end").over(reach), F.lit(0)), "free_to": F.coalesce(F.lead("start").over(order), F.lit(2**31 - 1))})
    # A context of full length may begin or end within a word.
    cut = lambda c, pattern: F.when(F.char_length(c) == CONTEXT, F.regexp_replace(c, pattern, "")).otherwise(F.col(c))
    before, after = cut("before", r"^[\p{L}\p{N}]+"), cut("after", r"[\p{L}\p{N}]+$")
    sides = F.array(F.struct(before.alias("text"), (F.col("start") - F.char_length(before)).alias("at"), F.col("free_from").alias("low"), F.col("start").alias("high")), F.struct(after.alias("text"), F.col("end").alias("at"), F.greatest("end", "free_from").alias("low"), F.col("free_to").alias("high")))
    around = each.select("row", entity(F.col("kind"), F.col("value")).alias("entity"), F.explode(sides).alias("side")).select("row", "entity", "side.*")
    around = around.withColumn("found", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("pieces", F.split("text", TERM, -1))
    terms = around.select("row", "entity", "at", "low", "high", F.explode(located(F.col("found"), F.col("pieces"))).alias("t"))
    placed = terms.select("row", "entity", F.col("t.value").alias("term"), (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end"), "low", "high")
    return placed.where("start >= low AND end <= high").drop("low", "high")


def disclosures(df: DataFrame, beside: DataFrame, spans: DataFrame, *, text_col: str = "text", support: int = 2, broadcast_terms: int = 200_000) -> DataFrame:
    """(entity, term, disclosure) of all pairs that `support` documents have."""
    pairs = beside.groupBy("row", "entity", "term").agg(F.lit(1)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    pairs = settled(pairs)
    asked = settled(pairs.select("term").distinct())
    entities = spans.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: entity(s["kind"], s["value"])))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    words = df.select(F.explode(F.array_distinct(F.split(F.col(text_col), GAP))).alias("term"))
    known = F.broadcast(asked) if asked.count() <= broadcast_terms else asked
    terms = words.join(known, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    n = spans.count()
    told = pairs.join(terms, "term").join(entities, "entity")
    information = F.log(F.lit(n) / F.col("entity_docs"))
    mutual = F.log(F.lit(float(n)) * F.col("both") / (F.col("entity_docs").cast("double") * F.col("term_docs")))
    out = settled(told.where(F.col("entity_docs") < n).select("entity", "term", (mutual / information).alias("disclosure")))
    discard(pairs, asked)
    return out


ACTION = "array<struct<start:int,end:int,action:string>>"


def find_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.97, generalise_at: float = 0.9, support: int = 2, broadcast_terms: int = 200_000, sanitise: bool = False) -> DataFrame:
    """Per row: id_col, spans (kind, start, end, value, ...) and terms (start, end, action), in order.

    sanitise=True keeps the texts by their rows and adds `sanitised`, the text with spans and terms replaced.
    """
    spans = settled(personal_spans(df, id_col=id_col, text_col=text_col, keep_text=sanitise))
    beside = settled(words_beside(spans))
    told = disclosures(df, beside, spans, text_col=text_col, support=support, broadcast_terms=broadcast_terms)
    action = F.when(F.col("disclosure") >= remove_at, "remove").when(F.col("disclosure") >= generalise_at, "generalise")
    acted = told.select("entity", "term", action.alias("action")).where(F.col("action").isNotNull())
    # A word beside two entities is removed if one of them asks for it.
    hit = beside.join(acted, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("action").alias("action"))
    terms = hit.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    out = spans.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast(ACTION)))
    whole = [sanitised_text(F.col("text"), F.col("spans"), F.col("terms")).alias("sanitised")] if sanitise else []
    return out.select(F.col("id").alias(id_col), "spans", "terms", *whole)


def sanitised_text(text: Column, spans: Column, terms: Column) -> Column:
    """text with each span as its kind in brackets, removed terms gone and generalised ones as their class."""
    word = lambda t: F.substr(text, t["start"] + 1, t["end"] - t["start"])
    kind = lambda w: F.when(w.rlike(r"^\p{N}+$"), "[NUMBER]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    marks = F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), F.when(t["action"] == "remove", "").otherwise(kind(word(t))).alias("mark"))),
    )
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    more = lambda a, m: F.struct((-m["back"]).alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, m["start"] - a["at"]), m["mark"]).alias("out"))
    done = F.aggregate(F.array_sort(marks), begun, lambda a, m: F.when(m["start"] >= a["at"], more(a, m)).otherwise(a))
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.char_length(text)))
