"""Graph-pattern queries as a chain of DataFrame operations.

    GraphQuery(quads, "sales").match("?c", TYPE, CLASS).optional("?c", LABEL, "?l").select("c", "l")

A term that starts with ? is a variable and becomes a column of that name; with details=True an object variable also gets
its kind, datatype and language as name_kind, name_dt and name_lang. Without graph() only the default graph is seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.paths import path_plus, path_seq, path_star


class GraphQuery:
    def __init__(self, quads: DataFrame, ns: str, rows: DataFrame | None = None, g: str | None = "", loose: frozenset[str] = frozenset()):
        """loose: variables that some rows may leave unbound."""
        self.quads, self.ns, self.rows, self.g, self.loose = quads, ns, rows, g, loose

    def _with(self, rows: DataFrame, loose: frozenset[str] | None = None) -> GraphQuery:
        return GraphQuery(self.quads, self.ns, rows, self.g, self.loose if loose is None else loose)

    def graph(self, g: str) -> GraphQuery:
        """Patterns from here on read this named graph, or bind the variable to the named graph's label."""
        return GraphQuery(self.quads, self.ns, self.rows, g, self.loose)

    def pattern(self, s: str, p: str, o: str, o_kind: str | None = None, details: bool = False) -> DataFrame:
        """Rows of one triple pattern. A repeated variable must be equal. Quads are a set, so rows need no distinct."""
        rows = self.quads.where(F.col("ns") == self.ns)
        places = {"s": s, "p": p, "o": o}
        if self.g is not None and self.g.startswith("?"):
            rows, places = rows.where(F.col("g") != ""), places | {"g": self.g}
        else:
            rows = rows.where(F.col("g") == self.g)
        bound: dict[str, str] = {}
        for column, term in places.items():
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term[1:] in bound:
                rows = rows.where(F.col(column) == F.col(bound[term[1:]]))
            else:
                bound[term[1:]] = column
        if not o.startswith("?"):
            rows = rows.where(F.col("o_kind") == (o_kind or "iri"))
        elif o_kind:
            rows = rows.where(F.col("o_kind") == o_kind)
        if "o" in places and o in (s, p):
            rows = rows.where(F.col("o_kind") != "literal")
        more = [F.col(f"o_{x}").alias(f"{o[1:]}_{x}") for x in ("kind", "dt", "lang")] if details and o.startswith("?") else []
        return rows.select(*[F.col(c).alias(v) for v, c in bound.items()], *more)

    def _joined(self, rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """rows joined with other on the shared variables. A variable that a row leaves unbound fits any value, and takes it.

        One join whatever rows leave unbound: other's rows are given for each combination of unbound variables that occurs,
        with these blanked, and rows meet those of their own combination. So it stays a join by equality.
        """
        shared = [c for c in other.columns if c in rows.columns]
        loose = [c for c in shared if c in self.loose]
        if not loose:
            if shared:
                return rows.join(other, shared, how)
            return rows.crossJoin(other) if how == "inner" else rows.join(other, F.lit(True), how)
        free = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in loose])
        rows = rows.withColumn("_free", free)
        combinations = rows.select(F.col("_free").alias("_of")).distinct()  # at most two to the number of loose variables
        new = [c for c in other.columns if c not in shared]
        blank = lambda c: F.when(F.substring("_of", loose.index(c) + 1, 1) == "0", F.col(c)) if c in loose else F.col(c)
        given = other.crossJoin(F.broadcast(combinations)).select("_of", *[blank(c).alias(f"_key_{c}") for c in shared], *[F.col(c).alias(f"_own_{c}") for c in (*loose, *new)])
        on = F.col("_free") == F.col("_of")
        for c in shared:
            on = on & (F.col(c).eqNullSafe(F.col(f"_key_{c}")) if c in loose else F.col(c) == F.col(f"_key_{c}"))
        out = rows.join(given, on, how)
        if how in ("left_semi", "left_anti"):
            return out.drop("_free")
        taken = [F.coalesce(c, f"_own_{c}").alias(c) if c in loose else F.col(c) for c in rows.columns if c != "_free"]
        return out.select(*taken, *[F.col(f"_own_{c}").alias(c) for c in new])

    def _join(self, other: DataFrame, how: str = "inner") -> GraphQuery:
        if self.rows is None:
            return self._with(other)
        new = frozenset(c for c in other.columns if c not in self.rows.columns)
        # a variable is bound after an inner join; an optional pattern may leave it, and its own, unbound
        return self._with(self._joined(self.rows, other, how), self.loose | new if how == "left" else self.loose - frozenset(other.columns))

    def match(self, s: str, p: str, o: str, **more) -> GraphQuery:
        """Joins a pattern on the shared variables; without any, all combinations."""
        return self._join(self.pattern(s, p, o, **more))

    def bgp(self, patterns) -> GraphQuery:
        """All patterns, in an order in which each shares a variable with those before it wherever there is one.

        So patterns that share none but through a later one don't make all combinations first.
        """
        out, todo = self, list(patterns)
        while todo:
            known = set(out.rows.columns) if out.rows is not None else set()
            ties = [x for x in todo if known & {t[1:] for t in x[:3] if t.startswith("?")}]
            x = (ties or todo)[0]
            todo.remove(x)
            out = out.match(*x)
        return out

    def join(self, other: GraphQuery | DataFrame) -> GraphQuery:
        """Joins solutions; other binds the variables that it shares with these."""
        return self._join(other.rows if isinstance(other, GraphQuery) else other)

    def optional(self, s: str, p: str, o: str, **more) -> GraphQuery:
        """Left join: an unbound variable is null."""
        return self._join(self.pattern(s, p, o, **more), "left")

    def not_exists(self, s: str, p: str, o: str, where: Column | None = None, **more) -> GraphQuery:
        """Keeps rows without such a triple; where filters the inner pattern (with its details)."""
        inner = self.pattern(s, p, o, details=True, **more)
        inner = inner.where(where) if where is not None else inner
        shared = [c for c in inner.columns if c in self.rows.columns]
        return self._with(self._joined(self.rows, inner.select(*shared).distinct(), "left_anti"))

    def exists(self, s: str, p: str, o: str, **more) -> GraphQuery:
        inner = self.pattern(s, p, o, **more)
        return self._with(self._joined(self.rows, inner, "left_semi"))

    def lacks_any(self, *patterns: tuple[str, str, str]) -> GraphQuery:
        """Keeps rows for which at least one of the patterns has no match."""
        rows, flags = self.rows, []
        for i, x in enumerate(patterns):
            inner = self.pattern(*x)
            shared = [c for c in inner.columns if c in self.rows.columns]
            rows = rows.join(inner.select(*shared).distinct().withColumn(f"_has{i}", F.lit(True)), shared, "left")
            flags.append(F.col(f"_has{i}").isNull())
        keep = flags[0]
        for f in flags[1:]:
            keep = keep | f
        return self._with(rows.where(keep).select(*self.rows.columns))

    def filter(self, condition: Column | str) -> GraphQuery:
        return self._with(self.rows.where(condition))

    def bind(self, **columns: Column) -> GraphQuery:
        return self._with(self.rows.withColumns(columns))

    def union(self, other: GraphQuery) -> GraphQuery:
        """Both branches' rows, repeats kept; a variable that one branch lacks is null there."""
        either = frozenset(self.rows.columns) ^ frozenset(other.rows.columns)
        return self._with(self.rows.unionByName(other.rows, allowMissingColumns=True), self.loose | other.loose | either)

    def path(self, s: str, p: str, o: str, kind: str = "+", first: str | None = None) -> GraphQuery:
        """Joins the property path p+ or p*, or first/p* where first is given. From a constant s only its paths are followed."""
        edge = lambda q: self.pattern("?src", q, "?dst")
        start = self.quads.sparkSession.createDataFrame([(s,)], "src string") if not s.startswith("?") else None
        if first:
            begin = edge(first)
            pairs = path_seq(begin if start is None else begin.join(start, "src"), edge(p))
        else:
            pairs = path_plus(edge(p), start) if kind == "+" else path_star(edge(p), start)
        for column, term in (("src", s), ("dst", o)):
            if not term.startswith("?"):
                pairs = pairs.where(F.col(column) == term)
        names = [F.col(c).alias(t[1:]) for c, t in (("src", s), ("dst", o)) if t.startswith("?")]
        if s == o:
            pairs, names = pairs.where("src = dst"), names[:1]
        return self._join(pairs.select(*names).distinct() if names else pairs)

    def select(self, *names: str) -> DataFrame:
        """Columns by variable name; one that no pattern binds is null."""
        return self.rows.select(*[F.col(x) if x in self.rows.columns else F.lit(None).cast("string").alias(x) for x in names])

    def select_distinct(self, *names: str) -> DataFrame:
        return self.select(*names).distinct()

    def count(self, name: str = "n") -> DataFrame:
        """One row with the number of rows, zero included."""
        return self.rows.agg(F.count("*").alias(name))

    def count_distinct(self, variable: str, name: str = "n") -> DataFrame:
        return self.rows.agg(F.countDistinct(variable).alias(name))

    def ask(self, name: str = "answer") -> DataFrame:
        """One row: whether there is any solution. Only one is looked for."""
        return self.rows.limit(1).agg((F.count("*") > 0).alias(name))

    def construct(self, *template: tuple[str, str, str]) -> DataFrame:
        """Distinct (s, p, o) of the template; a row that leaves a variable of a triple unbound gives no such triple."""
        value = lambda t: F.col(t[1:]).cast("string") if t.startswith("?") else F.lit(t)
        triples = F.array(*[F.struct(*[value(t).alias(c) for c, t in zip(("s", "p", "o"), x, strict=True)]) for x in template])
        return self.rows.select(F.explode(triples).alias("t")).select("t.*").dropna().distinct()


def describe(quads: DataFrame, ns: str, iri: str) -> DataFrame:
    """All triples of a node in the default graph, and of the blank nodes below it."""
    own = quads.where((F.col("ns") == ns) & (F.col("g") == ""))
    first = own.where(F.col("s") == iri)
    links = own.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    below = path_plus(links, first.select(F.col("s").alias("src"))).select(F.col("dst").alias("s"))
    return first.unionByName(own.join(below.distinct(), "s", "left_semi").where("s_kind = 'bnode'").select(*own.columns)).distinct()


def cap_rows(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows up to limit, each with `truncated` and the `total` before the cut."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def cap_triples(df: DataFrame, limit: int) -> DataFrame:
    """df, if it has no more rows than limit; a graph is never cut, so more is an error."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"the graph has more than {limit} triples")
    return df


def long_cells(df: DataFrame, *variables: str) -> DataFrame:
    """var, type and value of the cells of IRI-or-literal variables that have a name_kind column."""
    cells = F.array(*[F.struct(F.lit(v).alias("var"), F.col(f"{v}_kind").alias("type"), F.col(v).cast("string").alias("value")) for v in variables])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null")


def deprecated_in_result(cells: DataFrame, deprecated: DataFrame) -> DataFrame:
    """Distinct sorted IRIs of cells of type iri that are deprecated (a column iri). The result itself keeps its rows."""
    return cells.where("type = 'iri'").select(F.col("value").alias("iri")).distinct().join(deprecated.select("iri"), "iri", "left_semi").orderBy("iri")


def terms_with_prefix(quads: DataFrame, base_iri: str) -> DataFrame:
    """Distinct IRIs, subjects, predicates or objects, under a prefix; an empty prefix has none."""
    own = F.array(F.when(T.is_iri(F.col("s_kind")), F.col("s")), F.col("p"), F.when(T.is_iri(F.col("o_kind")), F.col("o")))
    found = quads.select(F.explode(own).alias("iri")).where(F.col("iri").startswith(base_iri) & F.lit(base_iri != ""))
    return found.distinct()


def edge_list(quads: DataFrame, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, rank, kept, total_nodes) and edges (s, p, o, total_edges) of a drawing.

    Nodes come in the order in which the sorted triples first name them, subjects before objects; edges stay where both
    ends are kept. Literals are no nodes.
    """
    links = quads.where("o_kind <> 'literal'").select("s", "s_kind", "p", "o", "o_kind").distinct()
    place = lambda col, kind, i: F.struct(F.col(col).alias("node"), F.col(kind).alias("kind"), F.struct("s", "p", "o", F.lit(i).alias("i")).alias("at"))
    named = links.select(F.explode(F.array(place("s", "s_kind", 0), place("o", "o_kind", 1))).alias("x")).select("x.*")
    nodes = named.groupBy("node", "kind").agg(F.min("at").alias("at"))
    total = nodes.agg(F.count("*").alias("total_nodes"))
    kept = nodes.orderBy("at", "node").limit(max_nodes).select("node", "kind").crossJoin(F.broadcast(total))
    edges = links.join(kept.select(F.col("node").alias("s")), "s", "left_semi").join(kept.select(F.col("node").alias("o")), "o", "left_semi")
    return kept, edges.select("s", "p", "o").distinct().crossJoin(F.broadcast(links.agg(F.count("*").alias("total_edges"))))
