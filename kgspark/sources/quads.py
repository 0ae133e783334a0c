"""Quads: their schema, N-Triples files, and named graphs in partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources import snapshots

COLUMNS = ("ns", "g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
TERM = ("o", "o_kind", "o_dt", "o_lang")
#: What names a graph in a table.
BY = ("ns", "g")

_NODE = r'<([^<>"{}|^`\\\x00-\x20]*)>|_:([^\s<>"]+)'
_LINE = rf'\A\s*(?:{_NODE})\s*<([^<>"{{}}|^`\\\x00-\x20]*)>\s*(?:{_NODE}|"([^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+)"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?\z'


def quad(ns, g, s, p, o, o_kind="iri", s_kind="iri", o_dt=None, o_lang=None) -> tuple:
    """A row of SCHEMA."""
    return (ns, g, s, s_kind, p, o, o_kind, o_dt, o_lang)


def from_rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A relational source: parquet by default, or any format that Spark reads, with its options (jdbc, orc, csv, json)."""
    return spark.read.format(fmt).options(**options).load(path) if path else spark.read.format(fmt).options(**options).load()


def _unescaped(text: Column) -> Column:
    """N-Triples escapes resolved: characters named by \\u and \\U, and the short forms."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), 0)
    short = F.create_map(*[F.lit(x) for x in (r"\t", "\t", r"\b", "\b", r"\n", "\n", r"\r", "\r", r"\f", "\f", r"\"", '"', r"\'", "'", "\\\\", "\\")])
    code = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    one = lambda x: F.when(x.rlike(r"\A\\[uU]"), code(x)).when(x.startswith("\\"), F.coalesce(F.element_at(short, x), x)).otherwise(x)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def parse_ntriples(lines: DataFrame, ns: str, g: str = "", column: str = "value") -> DataFrame:
    """Quads and `malformed` (the line, else null) of each line that is neither blank nor a comment."""
    line = F.col(column)
    part = lambda i: F.nullif(F.regexp_extract(line, _LINE, i), F.lit(""))
    rows = lines.where(~line.rlike(r"\A\s*(#.*)?\z")).withColumn("_ok", line.rlike(_LINE))
    subject, obj = F.coalesce(part(1), part(2)), F.coalesce(part(4), part(5))
    literal = F.when(F.col("_ok") & obj.isNull(), _unescaped(F.regexp_extract(line, _LINE, 6)))
    kind = lambda iri, node: F.when(iri.isNotNull(), "iri").when(node.isNotNull(), "bnode")
    return rows.select(
        F.lit(ns).alias("ns"), F.lit(g).alias("g"), subject.alias("s"), kind(part(1), part(2)).alias("s_kind"), part(3).alias("p"), F.coalesce(obj, literal).alias("o"),
        F.coalesce(kind(part(4), part(5)), F.when(F.col("_ok"), "literal")).alias("o_kind"), part(7).alias("o_dt"), F.lower(part(8)).alias("o_lang"), F.when(~F.col("_ok"), line).alias("malformed"),
    )


def read_ntriples(spark: SparkSession, path: str, ns: str, g: str = "") -> tuple[DataFrame, DataFrame]:
    """The distinct quads of N-Triples files, and the lines that could not be read."""
    rows = parse_ntriples(spark.read.text(path), ns, g)
    return rows.where("malformed is null").select(*COLUMNS).distinct(), rows.where("malformed is not null").select("malformed")


def ntriples(quads: DataFrame) -> Column:
    """The line of each quad."""
    escaped = F.col("o")
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(coded))
    node = lambda v, k: F.when(k == "bnode", F.concat(F.lit("_:"), v)).otherwise(F.concat(F.lit("<"), v, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(node(F.col("o"), F.col("o_kind")))
    return F.concat(node(F.col("s"), F.col("s_kind")), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" ."))


def write_ntriples(quads: DataFrame, path: str) -> None:
    quads.select(ntriples(quads).alias("value")).write.text(path)


def write_graph(quads: DataFrame, path: str, ns: str, g: str = "") -> int:
    """Makes quads the whole of one graph of a table, and gives the commit's number; other graphs stay.

    No quads make the graph empty, which is as if it weren't there. The names ns and g of the quads are replaced by those
    given. Readers see the graph as it was until the commit. The default graph is g = ''.
    """
    rows = quads.withColumns({"ns": F.lit(ns), "g": F.lit(g)}).select(*COLUMNS).distinct()
    return snapshots.replace(rows, path, BY, [(ns, g)])


def write_graphs(quads: DataFrame, path: str) -> int:
    """Replaces all the graphs (ns, g) that quads has rows of, in one commit. Their names pass the driver."""
    rows = quads.select(*COLUMNS).distinct()
    return snapshots.replace(rows, path, BY, [tuple(r) for r in rows.select(*BY).distinct().collect()])


def read_graphs(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """Quads of a table that write_graph made, now or as of a commit; filters on ns and g reach the files."""
    return snapshots.current(spark, path, SCHEMA, BY, until)


def delete_graph(spark: SparkSession, path: str, ns: str, g: str = "") -> int:
    """Removes one graph of a table; a graph that isn't there is no error."""
    return snapshots.drop(spark, path, [(ns, g)])


def drop_graph(quads: DataFrame, ns: str, g: str) -> DataFrame:
    """quads without one graph; a graph that isn't there is no error."""
    return quads.where(~((F.col("ns") == ns) & (F.col("g") == g)))


def list_graphs(quads: DataFrame, ns: str) -> DataFrame:
    """The labels of a namespace's named graphs in order; the default graph isn't one."""
    return quads.where((F.col("ns") == ns) & (F.col("g") != "")).select("g").distinct().orderBy("g")


def has_default_graph_content(quads: DataFrame, ns: str) -> bool:
    return not quads.where((F.col("ns") == ns) & (F.col("g") == "")).limit(1).isEmpty()


def node_documents(quads: DataFrame) -> DataFrame:
    """s and doc, a JSON object with sorted keys that holds each predicate's sorted values."""
    values = F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("datatype"), F.col("o_lang").alias("language"))
    by = quads.select("s", "p", values.alias("v")).distinct().groupBy("s", "p").agg(F.array_sort(F.collect_list("v")).alias("values"))
    return by.groupBy("s").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "values"))))).alias("doc"))
