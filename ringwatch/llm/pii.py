"""Personal data: fixed patterns give seeds, their contexts find identifiers the patterns miss.

Four patterns (email, ip, card, phone) give base spans. Every token with a digit or an @ is an
instance; the one or two words before it, with its shape (digits 9, letters a, both x), are its
lexical patterns. Patterns and instances form a graph: a pattern's confidence in a kind is the
mean score of its instances, an instance's score is one less the chance that all its patterns
are wrong, seeds stay at one. After a few rounds the patterns with high confidence and enough
seeds mark their other instances, which become spans unless they touch a base span.

All of it is column expressions. The text is read once; only spans and tokens with their contexts
go on. Patterns that could start anywhere in a run of characters are bound to the start of the
run or the end of the last match, which finds the same spans in linear time.

Edge cases: a null text has no spans. Offsets count code points. Rows are told apart by position
in the written table, so repeated ids and rows are kept apart. Columns besides doc_id and text
are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import SPACE, counted, with_missing
from ringwatch.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CONTEXT = 64
ROUNDS = 3
MIN_SEEDS = 5
CONFIDENT = 0.8


def located(text: Column, pattern: str) -> Column:
    """All matches as (before, found, start): the characters since the last match, the match, its offset.

    A long gap keeps its last characters only; its whole length counts for the offsets.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<before:string,found:string,start:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        hit = F.struct(F.right(piece["gap"], F.lit(CONTEXT)).alias("before"), piece["hit"].alias("found"), start.alias("start"))
        return F.when(
            piece["hit"].isNotNull(),
            F.struct((start + F.length(piece["hit"])).alias("at"), F.concat(state["out"], F.array(hit)).alias("out")),
        ).otherwise(state)

    return F.aggregate(pieces, nothing, step, lambda state: state["out"])


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substr(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def is_valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(found, F.lit(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))
    if kind == "card":
        number = digits(found)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end) of one kind; texts without its marks are not searched."""
    marks = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "phone": F.contains(text, F.lit("+"))}
    hits = F.filter(located(text, PATTERNS[kind]), lambda h: is_valid(kind, h["found"]))
    spans = F.transform(
        hits,
        lambda h: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), h["start"].alias("start"), (h["start"] + F.length(h["found"])).alias("end")
        ),
    )
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return F.when(marks.get(kind, F.lit(True)), spans).otherwise(empty)


def shape(core: Column) -> Column:
    mixed = F.regexp_replace(core, r"[0-9]++[A-Za-z][A-Za-z0-9]*+|[A-Za-z]++[0-9][A-Za-z0-9]*+", "x")
    return F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "9"), "[A-Za-wyz][A-Za-z]*+|x[A-Za-z]++", "a")


def tokens(text: Column) -> Column:
    """Array of (start, end, core, before): identifier-like tokens without the punctuation around them."""

    def token(h: Column) -> Column:
        lead = F.length(F.regexp_extract(h["found"], "^[^A-Za-z0-9+]*+", 0))
        core = F.regexp_extract(h["found"], "(?s)[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0)
        start = h["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), h["before"].alias("before"))

    return F.filter(F.transform(located(text, TOKEN), token), lambda t: F.length(t["core"]) > 0)


def text_facts(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, base, tokens): one row per document, without its text."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", *[base_spans(text, k).alias(k) for k in KINDS], tokens(text).alias("tokens"))
    return found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.concat(*KINDS).alias("base"), "tokens")


def token_patterns(facts: DataFrame) -> DataFrame:
    """(_row, start, end, seed, instance, pattern): every token under each of its lexical patterns.

    seed is the kind of the base span that the token starts in, null outside of all.
    """
    exploded = facts.where(F.size("tokens") > 0).select("_row", "base", F.explode("tokens").alias("t"))
    seed = F.filter("base", lambda b: (b["start"] <= F.col("t.start")) & (F.col("t.start") < b["end"]))
    touched = F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))
    words = F.split(F.lower(F.btrim("t.before", F.lit(" \t\n\x0b\x0c\r"))), f"[{SPACE}]+")
    one = F.nullif(F.element_at("_words", -1), F.lit(""))
    two = F.when(F.size("_words") > 1, F.concat_ws(" ", F.element_at("_words", -2), one))
    rows = exploded.select(
        "_row",
        F.col("t.start").alias("start"),
        F.col("t.end").alias("end"),
        F.when(F.size(seed) > 0, F.element_at(seed, 1)["kind"]).alias("seed"),
        touched.alias("touched"),
        F.lower("t.core").alias("instance"),
        shape(F.col("t.core")).alias("_shape"),
        words.alias("_words"),
    )
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(one, two)))).select(
        "_row", "start", "end", "seed", "touched", "instance", F.concat_ws("\n", "pattern", "_shape").alias("pattern")
    )


def confident_patterns(
    found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT
) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may mark new instances."""
    edges = cut_lineage(
        found.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"))
    )
    seeds = edges.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = cut_lineage(seeds)
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores, patterns = seeds, None
    for step in range(rounds):
        hits = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("score"), F.sum((F.col("score") == 1.0).cast("long")).alias("seeds")
        )
        patterns = cut_lineage(
            hits.join(sizes, "pattern").select("pattern", "kind", "seeds", (F.col("score") / F.col("n")).alias("confidence"))
        )
        if step < rounds - 1:
            trusted = patterns.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= confident / 2))
            wrong = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
            spread = edges.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(wrong)).alias("score"))
            new = spread.join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind", "score")
            scores = cut_lineage(seeds.unionByName(new))
    best = F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("kind"))).alias("b")
    return (
        patterns.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= confident))
        .groupBy("pattern")
        .agg(best)
        .select("pattern", "b.kind", "b.confidence")
    )


def find_pii(
    docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT
) -> DataFrame:
    """Per document: doc_id, base and found, arrays of (kind, start, end); kind counts in KINDS."""
    facts = cut_lineage(text_facts(with_missing(docs, doc_id="long", text="string")))
    found = cut_lineage(token_patterns(facts))
    patterns = counted(confident_patterns(found, rounds, min_seeds, confident))
    marked = (
        found.where(~F.col("touched"))
        .join(patterns, "pattern")
        .groupBy("_row", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    )
    new = marked.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return facts.select("_row", "doc_id", "base").join(new, "_row", "left").select(
        "doc_id", F.array_sort("base").alias("base"), F.array_sort(F.coalesce("found", empty)).alias("found")
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas, in order of kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
