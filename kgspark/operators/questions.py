"""Many competency questions at once: patterns with constants, tagged by question and judged in one scan of the graph.

    Question("q1", "non_empty", [("?c", TYPE, CUSTOMER), ("?c", SEGMENT, "?s")], absent=[("?o", OF, "?c")])

A term that starts with ? is a variable. All patterns of a question meet in one variable, its hub, or share none. So a node
answers a question if it is the hub of a match of each pattern and of none of the absent ones, and the patterns that a node
takes part in say which questions it answers; nodes alike in that are judged once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources.quads import TERM

#: (s, p, o) or (s, p, o, kind of o): iri, bnode or literal; a constant o is an IRI where none is given.
Pattern = tuple[str, ...]

EXPECT = ("ask_true", "non_empty", "empty")
#: Patterns up to this number are broadcast.
MOST = 100_000
PLACES = ("s", "p", "o")


@dataclass(frozen=True)
class Question:
    """expect is ask_true, non_empty or empty. Without patterns it can't be asked, and fails."""

    id: str
    expect: str
    patterns: Sequence[Pattern]
    absent: Sequence[Pattern] = ()

    def hub(self) -> str | None:
        """The variable that all patterns share; None where none is shared. Others can't be judged in one scan: ValueError."""
        every = [{x for x in t[:3] if x.startswith("?")} for t in (*self.patterns, *self.absent)]
        shared = {x for i, own in enumerate(every) for x in own if any(x in other for other in every[:i])}
        if not shared:
            return None
        if len(shared) > 1 or any(not shared <= own for own in every):
            raise ValueError(f"the patterns of {self.id} do not meet in one variable")
        return shared.pop()


def _tagged(pattern: Pattern, hub: str | None) -> tuple:
    """mask and key of the pattern's constants, the place of its hub, the kind of o that it needs, and the places that must be equal."""
    s, p, o, *kind = pattern
    terms = dict(zip(PLACES, (s, p, o), strict=True))
    fixed = [c for c in PLACES if not terms[c].startswith("?")]
    kind = kind[0] if kind else "iri" if "o" in fixed else None
    key = "\x1f".join([*(terms[c] for c in fixed), *([kind] if "o" in fixed else [])])
    equal = ",".join(f"{a}{b}" for i, a in enumerate(PLACES) for b in PLACES[i + 1 :] if terms[a] == terms[b] and a not in fixed)
    place = next((c for c in PLACES if terms[c] == hub), None) if hub else None
    return sum(1 << PLACES.index(c) for c in fixed), key, place, kind, equal


def ask_all(questions: Iterable[Question], quads: DataFrame, ns: str, g: str = "") -> DataFrame:
    """id, expect, passed and evaluated of each question over one graph, in one scan of it.

    ask_true and non_empty pass where some match exists, empty where none does; only existence is tested. A question without
    patterns, or with an unknown expectation, is not evaluated and fails. Ids must be unique. Each quad is looked up by its
    terms, once for each combination of places that some pattern fixes; the lookup table has a row for each distinct pattern.
    """
    questions = list(questions)
    if len({q.id for q in questions}) < len(questions):
        raise ValueError("two questions have one id")
    spark = quads.sparkSession
    numbers: dict[tuple, int] = {}
    uses = []
    for q in questions:
        if q.patterns and q.expect in EXPECT:
            hub, number = q.hub(), lambda t: numbers.setdefault(t, len(numbers))
            needed = {number(_tagged(t, hub)) for t in q.patterns}
            uses += [(n, q.id, True, len(needed)) for n in needed] + [(number(_tagged(t, hub)), q.id, False, len(needed)) for t in q.absent]
    listed = spark.createDataFrame([(q.id, q.expect, bool(q.patterns) and q.expect in EXPECT) for q in questions], "id string, expect string, evaluated boolean")
    if not numbers:
        return listed.select("id", "expect", F.lit(False).alias("passed"), "evaluated")
    known = spark.createDataFrame([(n, *t) for t, n in numbers.items()], "pattern int, mask int, key string, place string, kind string, equal string")
    known = F.broadcast(known) if len(numbers) <= MOST else known

    def key(mask: int):
        fixed = [c for i, c in enumerate(PLACES) if mask >> i & 1]
        return F.concat_ws("\x1f", *fixed, *(["o_kind"] if "o" in fixed else [])) if fixed else F.lit("")

    rows = quads.where((F.col("ns") == ns) & (F.col("g") == g))
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), key(m).alias("key")) for m in sorted({t[0] for t in numbers})])
    hits = rows.select("s", "s_kind", "p", *TERM, F.explode(keys).alias("k")).select("*", "k.*").join(known, ["mask", "key"])
    same = {f"{a}{b}": F.col(a) == F.col(b) for i, a in enumerate(PLACES) for b in PLACES[i + 1 :]}
    fits = F.col("kind").isNull() | (F.col("kind") == F.col("o_kind"))
    for pair, holds in same.items():
        fits = fits & (~F.contains("equal", F.lit(pair)) | (holds & (F.col("o_kind") != "literal" if "o" in pair else F.lit(True))))
    literal = F.concat_ws("\x1f", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
    term = lambda kind, value: F.struct(kind.alias("kind"), value.alias("term"))
    node = (
        F.when(F.col("place") == "s", term(F.col("s_kind"), F.col("s"))).when(F.col("place") == "p", term(F.lit("iri"), F.col("p")))
        .when(F.col("place") == "o", term(F.when(F.col("o_kind") == "literal", literal).otherwise(F.col("o_kind")), F.col("o")))
    )
    return _judged(hits.where(fits).select(node.alias("node"), "pattern"), uses, listed)


def _judged(hits: DataFrame, uses: list[tuple], listed: DataFrame) -> DataFrame:
    """The questions' results from the patterns that each node is the hub of; patterns without a hub meet in the node null."""
    nodes = hits.groupBy("node").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    by = hits.sparkSession.createDataFrame(uses, "pattern int, id string, needed boolean, n int")
    met = nodes.select("patterns").distinct().select("patterns", F.explode("patterns").alias("pattern")).join(by, "pattern")
    met = met.groupBy("patterns", "id").agg((F.count_if("needed") == F.first("n")).alias("all"), F.bool_or(~F.col("needed")).alias("spoilt"))
    found = met.where("all and not spoilt").select("id", F.lit(True).alias("found")).distinct()
    some = F.coalesce("found", F.lit(False))
    passed = F.when(~F.col("evaluated"), F.lit(False)).when(F.col("expect") == "empty", ~some).otherwise(some)
    return listed.join(found, "id", "left").select("id", "expect", passed.alias("passed"), "evaluated")
