"""Personal data: pattern spans, and an information-theoretic sanitisation of the words that give them away.

Pattern matches (e-mail addresses, IP addresses, card and telephone numbers) are the protected entities. The corpus says
how strongly a word reveals an entity that it shares documents with: PMI(e; t) = log2(p(t | e) / p(t)) is the part of the
entity's information IC(e) = log2(N / n(e)) that the word discloses. With N documents, n(t) of them with the word, n(e) with
the entity and n(e, t) with both, p(t) is n(t) / N and p(t | e) is estimated as (n(e, t) + p(t)) / (n(e) + 1), as if one
more document had the entity and words as usual: an entity of one document has neighbours, but surer ones the more
documents it has. Words above a threshold of PMI / IC are generalised, those above a higher one removed, wherever they stand
in the entity's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach, written

#: Possessive forms of the contract's patterns, and look-behinds that start where a run starts: the same leftmost
#: matches, in linear time and without recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))
#: A word is a run of at least three letters. The shares of IC(e) from which it is generalised, or removed.
WORD, GENERALISE, REMOVE = r"\p{L}{3,}+", 0.7, 0.9
#: Matches whose places are summed up at once.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and value of each match.

    Places are sums of lengths: first within blocks of BLOCK matches, then over the blocks, so that a text with very many
    matches doesn't copy its growing list for each.
    """
    zero, kind = F.lit(0).cast("long"), "struct<start: bigint, end: bigint, value: string>"
    pieces = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, v: F.struct(F.length(gap).cast("long").alias("skip"), v.alias("v"))))

    def one(a: Column, x: Column) -> Column:
        start = a["at"] + x["skip"]
        return F.struct((start + F.length(x["v"])).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["v"])).alias("end"), x["v"].alias("value")))).alias("out"))

    def block(a: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    empty = lambda t: F.struct(zero.alias("at"), F.array().cast(t).alias("out"))
    blocks = lambda found: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / BLOCK)), lambda i: F.aggregate(F.slice(found, (i * BLOCK + 1).cast("int"), F.lit(BLOCK)), empty(f"array<{kind}>"), one))
    return F.flatten(F.aggregate(let(pieces, blocks), empty(f"array<array<{kind}>>"), block)["out"])


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """All kinds' spans: start, kind_at, end, kind and value, sorted by start, then kind as listed."""

    def of(at: int, kind: str, pattern: str, needs: str | None) -> Column:
        made = lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind_at"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))
        found = F.transform(F.filter(spans(text, pattern), lambda s: passes(kind, s["value"])), made)
        none = F.array().cast("array<struct<start: bigint, kind_at: int, end: bigint, kind: string, value: string>>")
        return F.when(text.contains(needs) if needs else text.rlike("[0-9]"), found).otherwise(none)

    return F.array_sort(F.concat(*[of(i, *kind) for i, kind in enumerate(KINDS)]))


def joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def share(n: Column, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """The share of an entity's information that a word discloses; null where every document has the entity."""
    part = F.log2((n_et + n_t / n) / (n_e + 1) * n / n_t) / F.log2(n / n_e)
    return F.when(n_e < n, F.round(part, 9))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """row, spots (start, end) and share of each word that discloses too much of an entity of its row.

    found: row, entities (distinct) and words (start, end, word) of the rows that have an entity; docs: all texts.
    """
    n = docs.count()
    total = F.lit(float(max(n, 1)))
    named = found.select("row", F.explode("entities").alias("entity"))
    entities = written(named.groupBy("entity").agg(F.count("*").alias("n_e")).withColumn("rows", F.col("n_e")), "pii-entities")
    sums = entities.agg(F.sum("rows"), F.max(F.when(F.col("n_e") < n, F.col("n_e")))).first()
    named = written(attach(named, entities, "entity", "rows", sums[0] or 0, "row").select("row", "entity", "found.n_e"), "pii-named")
    words = written(found.select("row", F.explode("words").alias("w")).groupBy("row", F.col("w.word").alias("word")).agg(F.collect_list(F.struct("w.start", "w.end")).alias("spots")), "pii-words")

    # frequencies of the words that can disclose anything: p(t | e) is at most 1, so n(t) has a bound for each n(e)
    everywhere = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), 0), F.lower))).alias("word")).groupBy("word").agg(F.count("*").alias("n_t"))
    can = lambda n_e: F.log2(total / F.col("n_t")) >= GENERALISE * F.log2(total / n_e) - 1e-6
    rare = everywhere.join(words.groupBy("word").agg(F.count("*").alias("rows")), "word").where(can(F.lit(float(sums[1] or max(n, 1)))))
    rare = attach(words, written(rare, "pii-frequencies"), "word", "rows", words.count(), "row").where("found is not null")
    rare = written(rare.select("row", "word", "spots", "found.n_t"), "pii-rare")

    # an entity of one document: n(e) and n(e, t) are 1
    alone = named.where("n_e = 1").select("row").distinct()
    one = F.lit(1.0)
    single = rare.join(alone, "row", "left_semi").select("row", "word", share(total, one, F.col("n_t"), one).alias("share"))
    pairs = rare.join(named.where("n_e > 1"), "row").where(can(F.col("n_e"))).select("row", "word", "n_t", "n_e", F.concat_ws(" ", "entity", "word").alias("pair"))
    pairs = written(pairs, "pii-pairs")
    leaks = pairs.groupBy("pair").agg(F.count("*").alias("rows"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    leaks = written(leaks.select("pair", "rows", share(total, F.col("n_e"), F.col("n_t"), F.col("rows")).alias("share")).where(F.col("share") >= GENERALISE), "pii-leaks")
    several = attach(pairs, leaks, "pair", "rows", pairs.count(), "row").where("found is not null").select("row", "word", "found.share")
    most = single.where(F.col("share") >= GENERALISE).unionByName(several).groupBy("row", "word").agg(F.max("share").alias("share"))
    return rare.join(most, ["row", "word"]).select("row", "spots", "share")


def with_spans(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, base (spans of patterns) and terms (start, end, action of disclosing words outside them), a row for each of docs.

    carry: further columns to keep. A null text is empty. A repeated row is one more document in all counts alike. An
    entity that every document names has nothing left to disclose.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("_text"), *carry)
    found = rows.withColumn("base", base_spans(F.col("_text")))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind_at"].alias("kind_at"), s["end"].alias("end"), s["kind"].alias("kind")))
    names = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    words = F.when(F.size("base") > 0, F.transform(spans(F.col("_text"), WORD), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("word"))))
    found = written(found.select("row", "doc_id", slim.alias("base"), names.alias("entities"), words.alias("words"), *carry), "pii-spans")
    leaks = disclosing(found.where("size(base) > 0").select("row", "entities", "words"), docs.select(F.coalesce("text", F.lit("")).alias("text")))
    action = F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised")
    terms = leaks.select("row", F.explode("spots").alias("s"), action.alias("action")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end", "action"))).alias("terms"))
    out = found.join(terms, "row", "left")
    clear = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.select("doc_id", "base", F.coalesce(clear, F.array().cast("array<struct<start: bigint, end: bigint, action: string>>")).alias("terms"), *carry)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans (with the kind `term` for disclosing words) and actions of each row of docs."""
    term = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind_at"), t["end"].alias("end"), F.lit("term").alias("kind")))
    count = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS]
    actions = joined(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["action"].alias("kind"))))
    return with_spans(docs.select("doc_id", "text")).select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", term))).alias("spans"), actions.alias("actions"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind in angle brackets, generalised words by <word>, and removed words left out.

    Where spans overlap, the first counts. A null text stays null; columns named like the operator's own don't clash.
    """
    found = with_spans(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), "_row")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("by")))
    term = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "removed", "").otherwise("<word>").alias("by")))
    found = found.select("_row", F.array_sort(F.concat(base, term)).alias("_spans"))
    text = F.coalesce("_row.text", F.lit(""))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(cut(a["at"], s["start"]), s["by"])).alias("out")))
    whole = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    made = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step, whole)
    own = lambda c: F.when(F.col("_row.text").isNotNull(), made).alias("text") if c == "text" else F.col("_row")[c].alias(c)
    return found.select(*[own(c) for c in docs.columns])
