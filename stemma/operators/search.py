"""Pattern search: a template is compiled to joins over the node tables.

    customer segment=BUILDING        a node of a type, with conditions on its features
      order status=F                 indented: inside the node above
      < order status=O               a relation to the node before it
    /without/                        a quantifier on the node before it, up to /-/
      item flag=R
    /-/

Conditions: f=v, f#v (a missing value doesn't match), f~regex, f<v and f>v (numeric where the feature is),
?f (defined). Relations: <: right before, < before, =: the same slots, || overlapping, -name> by an edge.
Quantifiers: /where/ /have/ /with/ (a match exists) and /without/ (none does); /or/ between sub-templates
takes either, and between whole templates gives the union of their results.

Planning: every node line is filtered before any join. Adjacency, equality and edges are equi-joins;
containment and overlap are bucketed equi-joins; `<` is a filter between two nodes of one container.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.corpus import Corpus
from ..plans.tables import cut
from .structure import bucket_width, headings, held, node_text, section_ref

_CONDITION = re.compile(r"^(?:\?(?P<has>\w+)|(?P<name>\w+)(?P<op>[=#~<>])(?P<value>.*))$")
_RELATION = re.compile(r"^(<:|<|=:|\|\||-(\w+)>)\s+(.*)$")
_QUANTIFIERS = ("/without/", "/where/", "/have/", "/with/")


class TemplateError(ValueError):
    """A template that can't be read or planned."""


@dataclass
class Atom:
    otype: str
    conditions: list[tuple[str, str, str]]
    indent: int
    parent: int | None = None
    relation: tuple[str, int] | None = None
    quantifiers: list[tuple[str, list[list[str]]]] = field(default_factory=list)


def parse(lines: list[str]) -> list[Atom]:
    """The node lines of one template, with parents, relations and quantifiers."""
    atoms: list[Atom] = []
    i = 0
    while i < len(lines):
        line = lines[i].split("#  ")[0].rstrip()
        text, indent = line.strip(), len(line) - len(line.lstrip())
        i += 1
        if not text or text.startswith("# "):
            continue
        if text in _QUANTIFIERS:
            if not atoms:
                raise TemplateError(f"{text} needs a node line before it")
            depth, body = 1, []
            while i < len(lines):
                here = lines[i].strip()
                i += 1
                depth += (here in _QUANTIFIERS) - (here == "/-/")
                if not depth:
                    break
                body.append(lines[i - 1])
            else:
                raise TemplateError(f"{text} isn't closed by /-/")
            owner = next((a for a in reversed(atoms) if a.indent <= indent), atoms[-1])
            owner.quantifiers.append((text, alternatives(body)))
            continue
        if text.startswith("/"):
            raise TemplateError(f"unknown quantifier {text}")
        relation = None
        if m := _RELATION.match(text):
            before = next((k for k in range(len(atoms) - 1, -1, -1) if atoms[k].indent == indent), None)
            if before is None:
                raise TemplateError(f"no node line before the relation in {text!r}")
            relation, text = (m[1], before), m[3]
        otype, *rest = text.split()
        conditions = []
        for c in rest:
            m = _CONDITION.match(c)
            if not m:
                raise TemplateError(f"can't read the condition {c!r}")
            conditions.append((m["has"], "?", "") if m["has"] else (m["name"], m["op"], m["value"]))
        parent = next((k for k in range(len(atoms) - 1, -1, -1) if atoms[k].indent < indent), None)
        atoms.append(Atom(otype, conditions, indent, parent, relation))
    if not atoms:
        raise TemplateError("the template has no node line")
    return atoms


def alternatives(lines: list[str]) -> list[list[str]]:
    """The parts between /or/ lines outside quantifiers."""
    out: list[list[str]] = [[]]
    depth = 0
    for x in lines:
        here = x.strip()
        depth += (here in _QUANTIFIERS) - (here == "/-/")
        if here == "/or/" and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return out


def condition(corpus: Corpus, name: str, op: str, value: str) -> Column:
    c, number = F.col(name), corpus.value_types.get(name) == "int"
    if op == "?":
        return c.isNotNull()
    if op == "~":
        return c.cast("string").rlike(value)
    v = F.lit(int(value)) if number else F.lit(value)
    return {"=": c == v, "#": c != v, "<": c < v, ">": c > v}[op]


def candidates(corpus: Corpus, atom: Atom, i: int) -> DataFrame:
    """corpus, n{i}, f{i}, l{i}: the nodes that satisfy a node line on its own."""
    gaps = [F.col("ranges").alias(f"g{i}")] if "ranges" in corpus.nodes.columns else []
    nodes = corpus.of_type(atom.otype).where("first_slot is not null").select("corpus", "node", "first_slot", "last_slot", *[F.col("ranges") for _ in gaps])
    for name in dict.fromkeys(c[0] for c in atom.conditions):
        own = [condition(corpus, *c) for c in atom.conditions if c[0] == name]
        # every condition needs the value: the filtered feature joins, and the filter reaches its scan
        nodes = nodes.join(corpus.feature(name).where(reduce(lambda a, b: a & b, own)).select("corpus", "node"), ["corpus", "node"])
    return nodes.select("corpus", F.col("node").alias(f"n{i}"), F.col("first_slot").alias(f"f{i}"), F.col("last_slot").alias(f"l{i}"), *gaps)


def _contains(d: DataFrame, p: int, c: int) -> str:
    """SQL: has p all slots of c? With gaps where the corpus has some."""
    span = f"f{p} <= f{c} and l{c} <= l{p} and n{p} <> n{c}"
    return f"{span} and {held(f'g{p}', f'g{c}', f'f{p},l{p}', f'f{c},l{c}')}" if f"g{p}" in d.columns and f"g{c}" in d.columns else span


def _meets(d: DataFrame, a: int, b: int) -> str:
    """SQL: do a and b share a slot?"""
    span = f"f{a} <= l{b} and f{b} <= l{a} and n{a} <> n{b}"
    if f"g{a}" not in d.columns or f"g{b}" not in d.columns:
        return span
    of = lambda i: f"coalesce(g{i}, array(named_struct('lo', f{i}, 'hi', l{i})))"
    return f"{span} and exists({of(a)}, x -> exists({of(b)}, y -> x.lo <= y.hi and y.lo <= x.hi))"


def _inside(left: DataFrame, right: DataFrame, p: int, c: int, width: int) -> DataFrame:
    a = left.withColumn("bucket", F.explode(F.sequence(F.expr(f"f{p} div {width}"), F.expr(f"l{p} div {width}"))))
    b = right.withColumn("bucket", F.expr(f"f{c} div {width}"))
    both = a.join(b, ["corpus", "bucket"])
    return both.where(_contains(both, p, c)).drop("bucket")


def _related(corpus: Corpus, left: DataFrame, right: DataFrame, op: str, a: int, b: int, width: int) -> DataFrame:
    if op == "<:":
        return left.withColumn(f"f{b}", F.col(f"l{a}") + 1).join(right, ["corpus", f"f{b}"])
    if op == "=:":
        return left.withColumn(f"f{b}", F.col(f"f{a}")).withColumn(f"l{b}", F.col(f"l{a}")).join(right, ["corpus", f"f{b}", f"l{b}"]).where(f"n{a} <> n{b}" + (f" and g{a} <=> g{b}" if f"g{a}" in left.columns and f"g{b}" in right.columns else ""))
    if op == "||":
        x = left.withColumn("bucket", F.explode(F.sequence(F.expr(f"f{a} div {width}"), F.expr(f"l{a} div {width}"))))
        y = right.withColumn("bucket", F.explode(F.sequence(F.expr(f"f{b} div {width}"), F.expr(f"l{b} div {width}"))))
        once = f"bucket = greatest(f{a} div {width}, f{b} div {width})"
        both = x.join(y, ["corpus", "bucket"])
        return both.where(f"{_meets(both, a, b)} and {once}").drop("bucket")
    edge = corpus.edge_features.where(F.col("feature") == op[1:-1]).select("corpus", F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"))
    return left.join(edge, ["corpus", f"n{a}"]).join(right, ["corpus", f"n{b}"])


def _holds(found: DataFrame, op: str, a: int, b: int) -> DataFrame:
    """A relation between two nodes that are joined already."""
    test = {"<:": f"l{a} + 1 = f{b}", "<": f"l{a} < f{b}", "=:": f"f{a} = f{b} and l{a} = l{b} and n{a} <> n{b}" + (f" and g{a} <=> g{b}" if f"g{a}" in found.columns and f"g{b}" in found.columns else ""), "||": _meets(found, a, b)}
    return found.where(test[op])


def _match(corpus: Corpus, lines: list[str], outer: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(results, number of node lines) of one template. outer: a node (n0, f0, l0) that all top lines lie in."""
    atoms = parse(lines)
    found = outer
    for k, atom in enumerate(atoms):
        i = k + 1
        own = candidates(corpus, atom, i)
        for kind, bodies in atom.quantifiers:
            seed = own.select("corpus", *[F.col(f"{x}{i}").alias(f"{x}0") for x in "nflg" if f"{x}{i}" in own.columns])
            hits = reduce(DataFrame.unionAll, [_match(corpus, body, seed)[0].select("corpus", F.col("n0").alias(f"n{i}")) for body in bodies])
            own = own.join(hits, ["corpus", f"n{i}"], "left_anti" if kind == "/without/" else "left_semi")
        parent = 0 if atom.parent is None and outer is not None else atom.parent + 1 if atom.parent is not None else None
        if found is None:
            found = own
        elif atom.relation and (op := atom.relation[0]) != "<":
            width = bucket_width(own.select(F.col(f"f{i}").alias("first_slot"), F.col(f"l{i}").alias("last_slot"))) if op == "||" else 1
            found = _related(corpus, found, own, op, atom.relation[1] + 1, i, width)
            if parent is not None:
                found = found.where(_contains(found, parent, i))
        elif parent is not None:
            span = found.select("corpus", F.col(f"f{parent}").alias("first_slot"), F.col(f"l{parent}").alias("last_slot"))
            # by the mean span of the type above, so that each node touches few buckets
            above = atoms[parent - 1].otype if parent else None
            width = bucket_width(corpus.of_type(above)) if above else bucket_width(span)
            found = _inside(found, own, parent, i, width)
            if atom.relation:
                found = _holds(found, atom.relation[0], atom.relation[1] + 1, i)
        elif atom.relation:
            raise TemplateError("'<' needs a node that contains both")
        else:
            raise TemplateError(f"line {i} ({atom.otype}) has no relation to the lines before it")
    return found, len(atoms)


def search(corpus: Corpus, template: str) -> DataFrame:
    """corpus, n1, f1, l1, n2, ...: one row for each result, a node for each node line. T01-T11."""
    parts = [_match(corpus, body) for body in alternatives(template.splitlines())]
    if len({n for _, n in parts}) > 1:
        raise TemplateError("the templates around /or/ have different numbers of node lines")
    columns = ["corpus", *[f"{x}{i}" for i in range(1, parts[0][1] + 1) for x in "nfl"]]
    out = [p.select(*columns) for p, _ in parts]
    return out[0] if len(out) == 1 else reduce(DataFrame.unionAll, out).distinct()


def result_nodes(results: DataFrame) -> list[str]:
    return [c for c in results.columns if c[0] == "n" and c[1:].isdigit()]


def count(results: DataFrame) -> DataFrame:
    """T12."""
    return results.agg(F.count(F.lit(1)).alias("n"))


def statistics(corpus: Corpus, results: DataFrame) -> DataFrame:
    """otype, n: nodes over all positions of all results, by type. T13."""
    nodes = results.select("corpus", F.explode(F.array(*result_nodes(results))).alias("node")).groupBy("corpus", "node").agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(corpus.nodes.select("corpus", "node", "otype"), ["corpus", "node"]).groupBy("otype").agg(F.sum("k").alias("n"))


def result_order(results: DataFrame) -> list[Column]:
    """Results in canonical order of their nodes, position by position."""
    return [c for n in result_nodes(results) for c in (F.col("f" + n[1:]), F.col("l" + n[1:]).desc(), F.col(n))]


def page(results: DataFrame, limit: int, after: dict[str, int] | None = None) -> DataFrame:
    """The next `limit` (1 to 100) results in canonical order after the one given by its n, f and l columns. No
    state is kept between pages: the last row is the cursor. P10, T16."""
    limit = max(1, min(limit, 100))
    if after:
        same, later = F.lit(True), F.lit(False)
        for n in result_nodes(results):
            for name, sign in ((f"f{n[1:]}", 1), (f"l{n[1:]}", -1), (n, 1)):
                value = F.lit(after[name])
                later = later | (same & ((F.col(name) > value) if sign > 0 else (F.col(name) < value)))
                same = same & (F.col(name) == value)
        results = results.where(later)
    return results.orderBy("corpus", *result_order(results)).limit(limit)


def passages(corpus: Corpus, results: DataFrame) -> DataFrame:
    """corpus, node, text of the first node of each result, once for each node. T14."""
    first = results.select("corpus", F.col("n1").alias("node"), F.col("f1").alias("first_slot"), F.col("l1").alias("last_slot")).distinct()
    return node_text(corpus, first)


def export(corpus: Corpus, results: DataFrame, features: list[str]) -> DataFrame:
    """result_index, slot_index, node, otype and features: a row for each node of each result. T17."""
    from pyspark.sql import Window

    numbered = results.withColumn("result_index", F.row_number().over(Window.partitionBy("corpus").orderBy(*result_order(results))) - 1)
    rows = numbered.select("corpus", "result_index", F.posexplode(F.array(*result_nodes(results))).alias("slot_index", "node"))
    typed = rows.join(corpus.nodes.select("corpus", "node", "otype"), ["corpus", "node"])
    return corpus.with_features(typed, features).select("corpus", "result_index", "slot_index", "node", "otype", *features)


def references(corpus: Corpus, results: DataFrame) -> DataFrame:
    """results with refs: the section reference of each node, joined by ' | '. A section has labels down to its own level. T15."""
    names, results = result_nodes(results), cut(results)
    every = results.select("corpus", F.explode(F.array(*[F.struct(F.col(n).alias("node"), F.col("f" + n[1:]).alias("first_slot")) for n in names])).alias("x")).select("corpus", "x.*").distinct()
    typed = cut(every.join(corpus.nodes.select("corpus", "node", "otype"), ["corpus", "node"]))
    depth = F.array_position(F.array(*[F.lit(t) for t in corpus.section_types]), F.col("otype"))
    heads = headings(corpus, typed.drop("otype")).join(typed.select("corpus", "node", F.when(depth > 0, depth).otherwise(len(corpus.section_types)).alias("depth")), ["corpus", "node"])
    heads = heads.select("corpus", "node", *[F.when(F.col("depth") > i, F.col(t)).alias(t) for i, t in enumerate(corpus.section_types)])
    refs = cut(heads.select("corpus", "node", section_ref(corpus.section_types).alias("ref")))
    for n in names:
        results = results.join(refs.select("corpus", F.col("node").alias(n), F.col("ref").alias(f"r{n[1:]}")), ["corpus", n], "left")
    return results.withColumn("refs", F.concat_ws(" | ", *[f"r{n[1:]}" for n in names])).drop(*[f"r{n[1:]}" for n in names])


#: T18.
SYNTAX = __doc__
