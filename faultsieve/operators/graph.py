"""Provenance as triples: made from attempts, written and read as N-Triples, and asked by patterns.

Triples are rows (s, p, o) of prefixed names and literals as N-Triples writes them, so that equal terms are equal texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

PREFIXES = {"repr": "urn:notebook-repair:", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "prov": "http://www.w3.org/ns/prov#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
TRIPLE = "struct<s:string,p:string,o:string>"


def repair_triples(facts: DataFrame) -> DataFrame:
    """Triples (s, p, o) of each attempt and its notebook, with prefixed names; null objects give none."""
    node = F.concat(F.lit("repr:repairattempt_"), F.col("id"))
    text = lambda c: F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"'))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    time = F.concat(F.lit('"'), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"^^xsd:dateTime'))
    rows = F.array(
        triple(F.concat(F.lit("repr:notebook_"), F.col("notebook_execution_id")), "repr:hadRepairAttempt", node), triple(node, "rdf:type", F.lit("prov:Activity")), triple(node, "rdf:type", F.lit("repr:RepairAttempt")),
        triple(node, "repr:failingModule", text("failing_module")), triple(node, "repr:appliedFix", text("command")), triple(node, "repr:fixOutcome", text("outcome")), triple(node, "repr:exception", text("new_error_type")),
        triple(node, "prov:wasAssociatedWith", F.concat(F.lit("repr:"), F.url_encode("llm_model"))), triple(node, "prov:endedAtTime", time),
    )
    return facts.select(F.explode(rows).alias("t")).select("t.*").where("o is not null")


def triple_lines(triples: DataFrame) -> DataFrame:
    """Triples as lines of N-Triples: prefixed names become whole identifiers, also the type of a literal."""
    def whole(c: Column) -> Column:
        kind = F.regexp_extract(c, r'"\^\^(\w+:\w+)$', 1)
        name = F.when(c.startswith('"'), kind).otherwise(c)
        iri = F.concat(F.lit("<"), F.coalesce(*[F.when(name.startswith(k + ":"), F.concat(F.lit(v), F.substr(name, F.lit(len(k) + 2)))) for k, v in PREFIXES.items()]), F.lit(">"))
        return F.when(~c.startswith('"'), iri).when(kind == "", c).otherwise(F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(kind)), iri))

    return triples.select(F.concat_ws(" ", *[whole(F.col(x)) for x in ("s", "p", "o")], F.lit(".")).alias("line"))


# An identifier in angle brackets, and a literal with its type or language, in the grammar of N-Triples.
_IRI = r'<((?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4})*+)>'
_LITERAL = r'"((?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)"(?:\^\^' + _IRI + r"|(@[A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
_NAMED, _END = rf"^[ \t]*{_IRI}[ \t]*{_IRI}[ \t]*", r"[ \t]*\.[ \t]*(?:#.*)?$"
LINK, FACT = _NAMED + _IRI + _END, _NAMED + _LITERAL + _END
_PIECE = r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\[\s\S]|[^\\]+"


def unescaped(c: Column) -> Column:
    """A literal's text, with what its escapes stand for."""
    named = F.create_map(*[F.lit(x) for kv in {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}.items() for x in kv])
    rest = lambda x: F.substr(x, F.lit(3))
    piece = lambda x: (
        F.when(~x.startswith("\\"), x).when(x.startswith("\\u"), F.decode(F.unhex(rest(x)), "UTF-16BE"))
        .when(x.startswith("\\U"), F.decode(F.unhex(rest(x)), "UTF-32")).otherwise(F.try_element_at(named, F.substr(x, F.lit(2))))
    )
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), piece), "")


_MARKS = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _MARKS.items(), c.cast("string"))


def _prefixed(iri: Column) -> Column:
    """A known namespace as its prefix; other identifiers stay in brackets."""
    known = [F.when(iri.startswith(v), F.concat(F.lit(f"{k}:"), F.substr(iri, F.lit(len(v) + 1)))) for k, v in PREFIXES.items()]
    return F.coalesce(*known, F.concat(F.lit("<"), iri, F.lit(">")))


def read_triples(lines: DataFrame, column: str = "line") -> DataFrame:
    """s, p, o and error of each line of N-Triples that is neither blank nor a comment.

    A line that is no triple (blank nodes are not known here) has the line itself as error and no terms. Literals are written
    again with the fewest escapes, as `repair_triples` writes them, so that what was written is read back equal.
    """
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\r$", "")

    def terms(x: Column, kind: str) -> Column:
        part = lambda n: F.regexp_extract(x, kind, n)
        tag = F.when(part(4) != "", F.concat(F.lit("^^"), _prefixed(part(4)))).otherwise(part(5)) if kind == FACT else None
        o = _prefixed(part(3)) if kind == LINK else F.concat(F.lit('"'), escaped(unescaped(part(3))), F.lit('"'), tag)
        return F.struct(_prefixed(part(1)).alias("s"), _prefixed(part(2)).alias("p"), o.alias("o"))

    rows = lines.where(~F.coalesce(F.col(column), F.lit("")).rlike(r"^\s*(#.*)?$"))
    good = let(text, lambda x: F.when(x.rlike(LINK), terms(x, LINK)).when(x.rlike(FACT), terms(x, FACT)))
    return rows.select(F.col(column).alias("_line"), good.alias("t")).select("t.s", "t.p", "t.o", F.when(F.col("t").isNull(), F.col("_line")).alias("error"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples as lines of N-Triples in text files."""
    triple_lines(triples).write.mode("overwrite").text(path)


def match(triples: DataFrame, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = (), repeated: bool = False) -> DataFrame:
    """A column for each variable of the patterns, a row for each way in which triples match all of them.

    Terms that begin with `?` are variables. Each pattern is a filter on its own predicate; they are joined from the one with
    the fewest triples on, always along a shared variable and with the next fewest. Patterns that share nothing with the rest would be
    a cross join and are refused. Optional patterns are joined last, in the order given; their variables may be null. With
    `repeated` the triples are made a set first. Each pattern reads the triples, so they should be a table, best in partitions of p.
    """
    triples = triples.select("s", "p", "o").distinct() if repeated else triples
    if not patterns:
        raise ValueError("there is no pattern")
    names = sorted({p for _, p, _ in patterns if not p.startswith("?")})
    counts = {r["p"]: r["n"] for r in triples.where(F.col("p").isin(names)).groupBy("p").agg(F.count("*").alias("n")).collect()} if len(patterns) > 1 else {}
    weight = lambda p: float("inf") if p[1].startswith("?") else counts.get(p[1], 0)
    variables = lambda p: list(dict.fromkeys(t[1:] for t in p if t.startswith("?")))

    def rows(pattern: tuple[str, str, str]) -> DataFrame:
        kept, seen, out = triples, {}, []
        for column, term in zip("spo", pattern):
            if not term.startswith("?"):
                kept = kept.where(F.col(column) == term)
            elif term[1:] in seen:
                kept = kept.where(F.col(column) == F.col(seen[term[1:]]))
            else:
                seen[term[1:]] = column
                out.append(F.col(column).alias(term[1:]))
        return kept.select(*out) if out else kept.select(F.lit(True).alias("_")).limit(1)

    left = sorted(patterns, key=weight)
    first = left.pop(0)
    found, have = rows(first), set(variables(first))
    while left:
        near = [p for p in left if have & set(variables(p))]
        if not near:
            raise ValueError(f"no variable links {left} to the other patterns")
        left.remove(near[0])
        found, have = found.join(rows(near[0]), [v for v in variables(near[0]) if v in have]), have | set(variables(near[0]))
    for p in optional:
        shared = [v for v in variables(p) if v in have]
        if not shared:
            raise ValueError(f"no variable links the optional {p} to the other patterns")
        found, have = found.join(rows(p), shared, "left"), have | set(variables(p))
    return found
