"""Column functions over RDF terms, identifiers and query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary IRIs of the W3C standards.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"

TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
SUBCLASS, DOMAIN, RANGE, SEE_ALSO = RDFS + "subClassOf", RDFS + "domain", RDFS + "range", RDFS + "seeAlso"
CLASS, DEPRECATED, DISJOINT, UNION_OF = OWL + "Class", OWL + "deprecated", OWL + "disjointWith", OWL + "unionOf"
REPLACED_BY, REPLACES = DCTERMS + "isReplacedBy", DCTERMS + "replaces"

# Lengths and patterns of identifiers.
MAX_IRI = 1024
IRI_FORBIDDEN = r'[\x00-\x20\x7f<>"{}|^`\\]'
IRI_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"
NAMESPACE = r"\A[a-z0-9][a-z0-9-]{1,62}\z"
VERSION = r"\A[A-Za-z0-9][A-Za-z0-9.+-]{0,63}\z"
RESERVED = ("ds",)


def is_iri(kind: Column) -> Column:
    """Whether a term of this kind is an IRI; a literal that looks like one is not."""
    return kind == "iri"


def is_true(value: Column, kind: Column) -> Column:
    """Whether a term is the literal true."""
    return (kind == "literal") & value.isin("true", "1")


def valid_term_iri(iri: Column) -> Column:
    """An absolute IRI of bounded length without forbidden characters; null is not one."""
    return F.coalesce((F.length(iri) > 0) & (F.length(iri) <= MAX_IRI) & ~iri.rlike(IRI_FORBIDDEN) & iri.rlike(IRI_SCHEME), F.lit(False))


def valid_namespace(name: Column) -> Column:
    return F.coalesce(name.rlike(NAMESPACE) & ~name.isin(*RESERVED), F.lit(False))


def valid_version(version: Column) -> Column:
    return F.coalesce(version.rlike(VERSION), F.lit(False))


def local_name(iri: Column) -> Column:
    """What follows the last # or /, or the whole where nothing does."""
    tail = F.regexp_extract(iri, r"[^#/]+\z", 0)
    return F.when(tail != "", tail).otherwise(iri)


def percent_encode(value: Column) -> Column:
    """Percent-encodes all but letters, digits and -._~ of the UTF-8 bytes."""
    coded = F.url_encode(value)
    return F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def content_hash(body: Column) -> Column:
    """SHA-256 of the UTF-8 body as hex."""
    return F.sha2(body, 256)


def template_prefix(template: Column) -> Column:
    """The text before the first placeholder."""
    return F.regexp_extract(template, r"(?s)\A([^{]*)", 1)


def normalize_table_name(name: Column) -> Column:
    """Quoted parts joined by dots; without quotes, the trimmed name."""
    parts = F.regexp_extract_all(name, F.lit(r'"([^"]*)"'), 1)
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(F.trim(name))


def data_iri_prefix(base: Column) -> Column:
    """Where a namespace's data IRIs begin."""
    return F.concat(F.regexp_replace(base, r"[#/]+\z", ""), F.lit("/data/"))


# What is blanked before keywords are sought, and the keywords. Strings are matched without backtracking
# into them, so long ones don't exhaust the stack.
NOISE = "|".join((
    r'"""[^\\"]*+(?:(?:\\(?s:.)|"(?!""))[^\\"]*+)*+"""', r"'''[^\\']*+(?:(?:\\(?s:.)|'(?!''))[^\\']*+)*+'''", r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'", r'<[^<>"{}|^`\\\s]*>', r"#[^\n]*",
))
FORMS = r"(?iU)\b(SELECT|ASK|CONSTRUCT|DESCRIBE)\b"
UPDATES = r"(?iU)\b(INSERT|DELETE|LOAD|CLEAR|CREATE|DROP|COPY|MOVE|ADD)\b"
SERVICE = r"(?iU)\bSERVICE\b"
GRAPH = r"(?iU)(?<![\w?$:])graph(?![\w])"
RELATION = r"(?iU)\b(?:FROM|JOIN)\s+([A-Za-z_][\w.]*)"
MAX_QUERY_TEXT = 2000


def query_form(text: Column) -> Column:
    """select, ask, construct or describe: the first such word outside strings, IRIs and comments; else unknown."""
    found = F.lower(F.regexp_extract(F.regexp_replace(text, NOISE, " "), FORMS, 1))
    return F.when(found != "", found).otherwise("unknown")


def is_read_only(text: Column) -> Column:
    """Whether a query is not empty, of a known form, and neither updates nor calls another service."""
    body = F.regexp_replace(text, NOISE, " ")
    return F.coalesce((F.trim(text) != "") & ~body.rlike(UPDATES) & ~body.rlike(SERVICE) & (query_form(text) != "unknown"), F.lit(False))


def uses_graph_clause(text: Column) -> Column:
    """Whether the word GRAPH stands anywhere in the raw text, comments included."""
    return text.rlike(GRAPH)


def query_fingerprint(text: Column) -> Column:
    """The whole text's hash, its first MAX_QUERY_TEXT characters and whether more was cut off."""
    return F.struct(F.sha2(text, 256).alias("query_hash"), F.substring(text, 1, MAX_QUERY_TEXT).alias("query_text"), (F.length(text) > MAX_QUERY_TEXT).alias("query_truncated"))


def referenced_relations(sql: Column) -> Column:
    """Sorted relation names after FROM or JOIN, nested ones too; LATERAL is no name."""
    names = F.filter(F.regexp_extract_all(sql, F.lit(RELATION), 1), lambda x: F.upper(x) != "LATERAL")
    return F.array_sort(F.array_distinct(names))


# The marks in an audit reason of generated revisions.
GENERATED = "LLM による生成"
ATTEMPTS = r"(?U)試行\s*([0-9]+)\s*回"
MODEL, DEPLOYMENT = r"(?U)model=([^、)\s]+)", r"(?U)deployment=([^、)\s]+)"


def generation_provenance(reason: Column) -> Column:
    """generated, attempts, model, deployment and struggled (three attempts or more); null is what can't be read."""
    generated = F.coalesce(F.contains(reason, F.lit(GENERATED)), F.lit(False))
    read = lambda p: F.when(generated, F.nullif(F.regexp_extract(reason, p, 1), F.lit("")))
    attempts = read(ATTEMPTS).try_cast("int")
    return F.struct(generated.alias("generated"), attempts.alias("attempts"), read(MODEL).alias("model"), read(DEPLOYMENT).alias("deployment"), F.when(~generated, F.lit(None)).otherwise(attempts >= 3).cast("boolean").alias("struggled"))
