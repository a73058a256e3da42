"""Graph patterns over a store of triples (s, p, o, optionally lang), as joins.

A pattern is a group of triple patterns, options, unions, groups, exclusions and
filters. A variable may be unbound in some rows of what a group gives: two rows go
together if they agree on every variable that both bind, so that an unbound one
goes with all. Variables that are bound in every row are keys of a join; the
others are conditions of it, or, without any key, the rows are told apart by what
they bind, and each kind is joined on what it shares with the other.

Triple patterns of one subject are answered by one grouping of their triples. What
is left is counted, in one pass, and joined in the order of least intermediate
rows. Paths are pairs of their ends; closures grow round by round in scratch tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import chain, combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import Scratch
from factloom.plans.skew import salted_join

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Values that the pattern language has of itself. Fixed values.
_PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
_TOKEN = re.compile(
    r"""\s*(?:
      \?(?P<variable>\w+)
    | <(?P<address>[^\s<>"{}|^`\\]*)>
    | "(?P<text>(?:[^"\\]|\\.)*)"(?:@(?P<lang>[\w-]+)|\^\^(?:<[^>]*>|\w*:\w+))?
    | (?P<number>[+-]?\d+(?:\.\d+)?)
    | (?P<prefix>\w*):(?P<local>[\w.-]*\w)
    | (?P<word>[A-Za-z]\w*)
    | (?P<mark>&&|\|\||!=|<=|>=|[.;,{}()=<>!^/|*+?])
    )""",
    re.X,
)
_PREFIX = re.compile(r"PREFIX\s+(\w*):\s*<([^>]*)>", re.I)
_WORDS = frozenset("OPTIONAL UNION MINUS FILTER NOT EXISTS BOUND REGEX CONTAINS STRSTARTS STRENDS STR".split())
#: Parts of a group up to which all orders of joins are looked at.
SEARCHED = 10


class Term(NamedTuple):
    """A variable, or a constant with its language."""

    variable: str | None = None
    value: str | None = None
    lang: str | None = None
    number: bool = False


class Solutions(NamedTuple):
    """Bindings: a column for each variable, and the variables that every row binds."""

    frame: DataFrame
    sure: frozenset[str]

    @property
    def variables(self) -> list[str]:
        return self.frame.columns


# ---------------------------------------------------------------- reading


class _Reader:
    """A pattern as nested lists: (kind, ...) for each part of a group. Variables are numbered, so that no name clashes."""

    def __init__(self, text: str) -> None:
        known = _PREFIXES | dict(_PREFIX.findall(text))
        text = _PREFIX.sub(" ", text).strip()
        self.names: dict[str, str] = {}
        self.tokens: list[tuple[str, Term | None]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"can't be read: {text[at : at + 40]!r}")
            at = m.end()
            if m["variable"]:
                self.tokens.append(("term", Term(self.names.setdefault(m["variable"], f"v{len(self.names)}"))))
            elif m["prefix"] is not None:
                if m["prefix"] not in known:
                    raise ValueError(f"no prefix {m['prefix']!r}")
                self.tokens.append(("term", Term(value=known[m["prefix"]] + m["local"])))
            elif m["word"] == "a":
                self.tokens.append(("term", Term(value=TYPE)))
            elif m["word"]:
                if m["word"].upper() not in _WORDS:
                    raise ValueError(f"can't be read: {m['word']!r}")
                self.tokens.append((m["word"].upper(), None))
            elif m["mark"]:
                self.tokens.append((m["mark"], None))
            else:
                value = next(m[k] for k in ("address", "text", "number") if m[k] is not None)
                self.tokens.append(("term", Term(None, value, m["lang"], m["number"] is not None)))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, *kinds: str) -> Term | None:
        if self.peek() not in kinds:
            raise ValueError(f"expected {' or '.join(kinds)}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def skip(self, kind: str) -> bool:
        found = self.peek() == kind
        self.at += found
        return found

    def braces(self) -> list[tuple]:
        self.take("{")
        out = self.group("}")
        self.take("}")
        return out

    def group(self, end: str) -> list[tuple]:
        out: list[tuple] = []
        while self.peek() != end:
            kind = self.peek()
            if self.skip("."):
                continue
            if self.skip("OPTIONAL"):
                out.append(("option", self.braces()))
            elif self.skip("MINUS"):
                out.append(("minus", self.braces()))
            elif self.skip("FILTER"):
                out.append(self.filter())
            elif kind == "{":
                parts = [self.braces()]
                while self.skip("UNION"):
                    parts.append(self.braces())
                out.append(("union", parts))
            else:
                out += self.triples()
        return out

    def filter(self) -> tuple:
        no = self.skip("NOT")
        if no or self.peek() == "EXISTS":
            self.take("EXISTS")
            return ("absent" if no else "present", self.braces())
        if self.peek() in ("BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS"):
            return ("filter", self.call())
        self.take("(")
        found = self.either()
        self.take(")")
        return ("filter", found)

    def either(self) -> tuple:
        found = self.both()
        while self.skip("||"):
            found = ("or", found, self.both())
        return found

    def both(self) -> tuple:
        found = self.single()
        while self.skip("&&"):
            found = ("and", found, self.single())
        return found

    def single(self) -> tuple:
        if self.skip("!"):
            return ("not", self.single())
        if self.skip("("):
            found = self.either()
            self.take(")")
            return found
        if self.peek() in _WORDS - {"STR"}:
            return self.call()
        one = self.operand()
        sign = self.peek()
        self.take("=", "!=", "<", "<=", ">", ">=")
        return (sign, one, self.operand())

    def operand(self) -> Term:
        if not self.skip("STR"):
            return self.take("term")
        self.take("(")
        found = self.take("term")
        self.take(")")
        return found

    def call(self) -> tuple:
        name = self.peek()
        self.take("BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS")
        self.take("(")
        given = [self.operand()]
        while self.skip(","):
            given.append(self.operand())
        self.take(")")
        most = {"BOUND": (1, 1), "REGEX": (2, 3)}.get(name, (2, 2))
        if not most[0] <= len(given) <= most[1] or any(x.value is None for x in given[1:]) or given[0].variable is None:
            raise ValueError(f"{name} of a variable and texts")
        return (name, *given)

    def triples(self) -> list[tuple]:
        """Patterns of one subject: ; goes on with another property, a comma with another object."""
        subject, out = self.take("term"), []
        while True:
            verb = self.path()
            out.append(("triple", subject, verb, self.take("term")))
            while self.skip(","):
                out.append(("triple", subject, verb, self.take("term")))
            more = False
            while self.skip(";"):
                more = True
            if not more or self.peek() not in ("term", "^", "("):
                if self.peek() in ("term", "^", "("):
                    raise ValueError("a pattern has three terms")
                return out

    def path(self) -> Term | tuple:
        """A property, or of paths: sequences, alternatives, inverses, closures."""
        found = self.steps()
        while self.skip("|"):
            found = ("|", found, self.steps())
        return found

    def steps(self) -> Term | tuple:
        found = self.step()
        while self.skip("/"):
            found = ("/", found, self.step())
        return found

    def step(self) -> Term | tuple:
        if self.skip("^"):
            return ("^", self.step())
        if self.skip("("):
            found = self.path()
            self.take(")")
        else:
            found = self.take("term")
        while self.peek() in ("+", "*", "?"):
            found = (self.peek(), found)
            self.at += 1
        return found


def _variables(of: object, tests: bool = False) -> set[str]:
    """The variables of triple patterns, or of filters."""
    if isinstance(of, Term):
        return {of.variable} - {None}
    if not isinstance(of, (list, tuple)):
        return set()
    if of and of[0] == "filter":
        return set().union(*map(_variables, of[1])) if tests else set()
    if of and of[0] == "triple" and tests:
        return set()
    return set().union(*(_variables(x, tests) for x in of))


# ---------------------------------------------------------------- rows that go together


def _other(variable: str) -> str:
    """The name of a variable's column of the right side."""
    return "w" + variable[1:]


def _agree(variables: list[str], sure: set[str]) -> Column:
    """Whether two rows agree on what both bind."""
    each = (F.col(v) == F.col(_other(v)) if v in sure else (F.col(v) == F.col(_other(v))) | F.col(v).isNull() | F.col(_other(v)).isNull() for v in variables)
    return reduce(lambda a, b: a & b, each)


def _kinds(variables: list[str], side: Solutions) -> list[frozenset[str]]:
    """The sets of these variables that rows may bind."""
    always, open_ = [v for v in variables if v in side.sure], [v for v in variables if v not in side.sure]
    return [frozenset([*always, *x]) for x in chain.from_iterable(combinations(open_, k) for k in range(len(open_) + 1))]


def _of_kind(frame: DataFrame, variables: list[str], bound: frozenset[str], name: Callable[[str], str]) -> DataFrame:
    for v in variables:
        frame = frame.where(F.col(name(v)).isNotNull() if v in bound else F.col(name(v)).isNull())
    return frame


def _beside(left: Solutions, right: Solutions, sharing: bool = False) -> DataFrame:
    """All pairs of rows that go together, the columns of the right renamed; ``sharing``: only those that both bind some variable."""
    renamed = right.frame.select(*(F.col(v).alias(_other(v)) for v in right.variables))
    shared = [v for v in left.variables if v in right.variables]
    if not shared:
        raise ValueError("a pattern shares no variable with the others")
    sure = left.sure & right.sure & set(shared)
    if sure:
        return left.frame.join(renamed, _agree(shared, sure))
    found = None
    for own in _kinds(shared, left):
        for other in _kinds(shared, right):
            a, b, keys = _of_kind(left.frame, shared, own, str), _of_kind(renamed, shared, other, _other), sorted(own & other)
            if keys:
                part = a.join(b, _agree(keys, set(keys)))
            elif sharing:
                continue
            else:  # nothing that both bind: the result is the product
                part = a.crossJoin(b)
            found = part if found is None else found.unionByName(part)
    return found


def _merged(left: Solutions, right: Solutions) -> dict[str, Column]:
    """The value of each variable of a pair of rows."""
    found = {v: F.col(v) for v in left.variables}
    for v in right.variables:
        found[v] = F.coalesce(F.col(v), F.col(_other(v))) if v in found and v not in left.sure else found.get(v, F.col(_other(v)))
    return found


def _join(left: Solutions, right: Solutions) -> Solutions:
    values = _merged(left, right)
    return Solutions(_beside(left, right).select(*(c.alias(v) for v, c in values.items())), left.sure | right.sure)


def _without(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``frame`` that aren't among ``rows``, nulls being equal."""
    renamed = rows.select(*(F.col(c).alias(_other(c)) for c in frame.columns)).distinct()
    return frame.join(renamed, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(_other(c))) for c in frame.columns)), "left_anti")


def _optional(left: Solutions, right: Solutions, kept: list[tuple]) -> Solutions:
    """Each row with those that go with it and pass the option's filters, or alone."""
    values = _merged(left, right)
    shared = [v for v in left.variables if v in right.variables]
    sure = left.sure & right.sure & set(shared)
    passes = [_truth(x, values) for x in kept]
    if sure:
        renamed = right.frame.select(*(F.col(v).alias(_other(v)) for v in right.variables))
        found = left.frame.join(renamed, reduce(lambda a, b: a & b, passes, _agree(shared, sure)), "left")
        return Solutions(found.select(*(c.alias(v) for v, c in values.items())), left.sure)
    pairs = reduce(lambda f, x: f.where(x), passes, _beside(left, right))
    alone = _without(left.frame, pairs.select(*left.variables))
    return Solutions(pairs.select(*(c.alias(v) for v, c in values.items())).unionByName(alone, allowMissingColumns=True), left.sure)


def _minus(left: Solutions, right: Solutions) -> Solutions:
    """The rows that share no binding with a row that they go with."""
    shared = [v for v in left.variables if v in right.variables]
    sure = left.sure & right.sure & set(shared)
    if not shared:
        return left
    if sure:
        renamed = right.frame.select(*(F.col(v).alias(_other(v)) for v in shared)).distinct()
        return Solutions(left.frame.join(renamed, _agree(shared, sure), "left_anti"), left.sure)
    pairs = _beside(left, right, sharing=True)
    return left if pairs is None else Solutions(_without(left.frame, pairs.select(*left.variables)), left.sure)


def _where_exists(left: Solutions, right: Solutions, kept: list[tuple], there: bool) -> Solutions:
    """The rows that go with some row which passes the filters, or with none."""
    values = _merged(left, right)
    shared = [v for v in left.variables if v in right.variables]
    sure = left.sure & right.sure & set(shared)
    passes = [_truth(x, values) for x in kept]
    if sure:
        renamed = right.frame.select(*(F.col(v).alias(_other(v)) for v in right.variables))
        condition = reduce(lambda a, b: a & b, passes, _agree(shared, sure))
        return Solutions(left.frame.join(renamed, condition, "left_semi" if there else "left_anti"), left.sure)
    pairs = reduce(lambda f, x: f.where(x), passes, _beside(left, right)).select(*left.variables)
    absent = _without(left.frame, pairs)
    return Solutions(_without(left.frame, absent) if there else absent, left.sure)


# ---------------------------------------------------------------- filters


def _truth(test: tuple, values: dict[str, Column]) -> Column:
    """A filter as a column: null where an unbound variable is asked for its value."""
    kind, *given = test
    if kind in ("and", "or"):
        one, two = (_truth(x, values) for x in given)
        return one & two if kind == "and" else one | two
    if kind == "not":
        return ~_truth(given[0], values)
    value = lambda x: F.lit(x.value) if x.variable is None else values.get(x.variable, F.lit(None).cast("string"))
    first = value(given[0])
    if kind == "BOUND":
        return first.isNotNull()
    if kind == "REGEX":
        flags = f"(?{given[2].value})" if len(given) > 2 else ""
        return first.rlike(flags + given[1].value)
    if kind in ("CONTAINS", "STRSTARTS", "STRENDS"):
        return {"CONTAINS": first.contains, "STRSTARTS": first.startswith, "STRENDS": first.endswith}[kind](given[1].value)
    compared = lambda a, b: {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind]
    second = value(given[1])
    numbers = compared(first.try_cast("double"), second.try_cast("double"))
    if given[0].number or given[1].number:
        return numbers
    if given[0].variable is None or given[1].variable is None:
        return compared(first, second)
    return F.coalesce(numbers, compared(first, second))


# ---------------------------------------------------------------- triples, stars, paths


def _is(column: str, term: Term, triples: DataFrame) -> Column:
    """Whether a column is a constant; a language asks for the triple's."""
    found = F.col(column) == term.value
    if term.lang is None:
        return found
    return found & (F.col("lang") == term.lang) if "lang" in triples.columns else F.lit(False)


def _bound(frame: DataFrame, ends: dict[str, Term]) -> Solutions:
    """Columns as the variables that they stand for; constants and variables that occur twice are tests."""
    named: dict[str, str] = {}
    for column, term in ends.items():
        if term.variable is None:
            frame = frame.where(_is(column, term, frame))
        elif term.variable in named:
            frame = frame.where(F.col(column) == F.col(named[term.variable]))
        else:
            named[term.variable] = column
    return Solutions(frame.select(*(F.col(c).alias(v) for v, c in named.items())), frozenset(named))


class Part(NamedTuple):
    """What is joined: bindings, how many rows and values of each variable they have, about."""

    solutions: Solutions
    rows: float
    values: dict[str, float]


class _Solver:
    def __init__(self, triples: DataFrame) -> None:
        self.triples = triples.select(*(c for c in ("s", "p", "o", "lang") if c in triples.columns)).where("s is not null and p is not null and o is not null")
        self.scratch = Scratch(triples.sparkSession, "patterns")

    def star(self, subject: Term, patterns: list[tuple[Term, Term]]) -> Part:
        """Patterns (property, object) of one subject variable, by one grouping.

        It gives the subjects that have one value each; those with more of some
        property are joined, as their values would not fit into one row. Its rows are
        counted with all of these, so that no order of joins takes it for smaller than it is.
        """
        tests = [(F.col("p") == p.value) & (_is("o", o, self.triples) if o.variable is None else F.lit(True)) for p, o in patterns]
        some = self.triples.where(F.col("p").isin(sorted({p.value for p, _ in patterns})))
        counts = [F.count_if(x).alias(f"n{i}") for i, x in enumerate(tests)]
        values = [F.max(F.when(x, F.col("o"))).alias(f"o{i}") for i, x in enumerate(tests)]
        n = [F.col(f"n{i}") for i in range(len(tests))]
        found = some.groupBy("s").agg(*counts, *values).where(reduce(lambda a, b: a & b, (x > 0 for x in n)))
        found = self.scratch.save(found, "star")
        one = reduce(lambda a, b: a & b, (x == 1 for x in n))
        ends = {"s": subject} | {f"o{i}": o for i, (_, o) in enumerate(patterns) if o.variable is not None}
        solutions = _bound(found.where(one), ends)
        many = self.scratch.save(found.where(~one).select("s"), "many")
        if not many.isEmpty():
            own = self.scratch.save(salted_join(some.withColumn("place", F.xxhash64("p", "o")), many, "s", F.col("place"), some.count()).drop("place"), "own")
            each = [_bound(own.where(F.col("p") == p.value), {"s": subject, "o": o}) for p, o in patterns]
            rest = reduce(_join, each)
            solutions = Solutions(solutions.frame.unionByName(rest.frame), solutions.sure)
        each = reduce(lambda a, b: a * b, (x.cast("double") for x in n))
        row = found.agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("rows"), *(F.approx_count_distinct(c).alias(c) for c in ends)).first()
        return Part(solutions, row["rows"], {t.variable: float(row[c]) for c, t in ends.items()})

    def pairs(self, path: Term | tuple, start: Term, end: Term) -> DataFrame:
        """Rows (s, o) of the ends of a path; constant ends only bound what a closure looks at."""
        if isinstance(path, Term):
            if path.variable is not None:
                raise ValueError("a path has no variables")
            return self.triples.where(F.col("p") == path.value).select("s", "o")
        free = Term("free")
        kind, *parts = path
        if kind == "^":
            return self.pairs(parts[0], end, start).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "|":
            return self.pairs(parts[0], start, end).unionByName(self.pairs(parts[1], start, end))
        if kind == "/":
            one, two = self.pairs(parts[0], start, free), self.pairs(parts[1], free, end)
            one = self.scratch.save(one if start.variable is not None else one.where(F.col("s") == start.value), "steps")
            met = salted_join(one.select("s", F.col("o").alias("by")), two.select(F.col("s").alias("by"), "o"), "by", F.col("s"), one.count())
            return met.select("s", "o")
        step = self.pairs(parts[0], free, free).distinct()
        found = step if kind == "?" else self.closure(step, start, end)
        return found if kind == "+" else found.unionByName(self.nothing(start, end)).distinct()

    def nothing(self, start: Term, end: Term) -> DataFrame:
        """The pairs of a path of no step: each term with itself; a constant also if no triple has it."""
        fixed = {x.value for x in (start, end) if x.variable is None}
        if fixed:
            return self.triples.sparkSession.createDataFrame([(x, x) for x in sorted(fixed)], "s string, o string")
        terms = self.triples.select("s").unionByName(self.triples.select(F.col("o").alias("s"))).where("s is not null").distinct()
        return terms.select("s", F.col("s").alias("o"))

    def closure(self, step: DataFrame, start: Term, end: Term) -> DataFrame:
        """Distinct pairs (s, o) with one step or more between them.

        From a constant end only what it reaches is followed, a step a round.
        Between free ends each round joins the newest pairs to all, which doubles
        the length of the ways, so that a chain takes as many rounds as its length has bits.
        """
        step = self.scratch.save(step, "step")
        flip = start.variable is not None and end.variable is None
        if flip:
            step = step.select(F.col("o").alias("s"), F.col("s").alias("o"))
        fixed = end if flip else start
        new = self.scratch.save(step if fixed.variable is not None else step.where(F.col("s") == fixed.value), "new")
        found = [new]  # a table for each round: what is known is not written again
        known = new
        while not new.isEmpty():
            reach = known if fixed.variable is not None else step
            met = salted_join(new.select("s", F.col("o").alias("by")), reach.select(F.col("s").alias("by"), "o"), "by", F.col("s"), new.count())
            fresh = self.scratch.save(met.select("s", "o").distinct().join(known, ["s", "o"], "left_anti"), "new")
            found.append(fresh)
            known, new = reduce(DataFrame.unionByName, found), fresh
        return known.select(F.col("o").alias("s"), F.col("s").alias("o")) if flip else known

    def parts(self, elements: list[tuple]) -> list[Part]:
        """What a run of patterns, unions and groups has to be joined from."""
        stars: dict[str, list[tuple]] = {}
        for e in elements:
            if e[0] == "triple" and isinstance(e[2], Term) and e[1].variable and e[2].variable is None:
                stars.setdefault(e[1].variable, []).append(e)
        plain = [e for e in elements if e[0] == "triple" and isinstance(e[2], Term) and e not in [x for own in stars.values() if len(own) > 1 for x in own]]
        out = [self.star(own[0][1], [(p, o) for _, _, p, o in own]) for own in stars.values() if len(own) > 1]
        single = [_bound(self.triples, {"s": s, "p": p, "o": o}) for _, s, p, o in plain]
        known = self.counted(plain) if len(elements) > 2 else [(1.0, dict.fromkeys(x.variables, 1.0)) for x in single]
        out += [Part(x, n, values) for x, (n, values) in zip(single, known, strict=True)]
        for e in elements:
            if e[0] == "triple" and not isinstance(e[2], Term):
                found = self.scratch.save(self.pairs(e[2], e[1], e[3]), "path")
                ends = {"s": e[1], "o": e[3]}
                solutions = _bound(found, ends)
                row = found.agg(F.count(F.lit(1)).alias("rows"), *(F.approx_count_distinct(c).alias(c) for c in ends)).first()
                out.append(Part(solutions, float(row["rows"]), {t.variable: float(row[c]) for c, t in ends.items() if t.variable is not None}))
                continue
            elif e[0] == "union":
                solutions, n = self.union([self.group(g) for g in e[1]]), 1e12  # nothing is known of it
            else:
                continue
            out.append(Part(solutions, n, dict.fromkeys(solutions.variables, n)))
        return out

    def counted(self, patterns: list[tuple]) -> list[tuple[float, dict[str, float]]]:
        """The rows of each triple pattern, and the values of each of its variables, about; one pass over the triples."""
        if not patterns:
            return []
        asked, variables = [], []
        for i, (_, *terms) in enumerate(patterns):
            named = {t.variable: c for c, t in zip("spo", terms, strict=True) if t.variable is not None}
            fits = reduce(lambda a, b: a & b, (_is(c, t, self.triples) for c, t in zip("spo", terms, strict=True) if t.variable is None), F.lit(True))
            asked += [F.count_if(fits).alias(f"n{i}"), *(F.approx_count_distinct(F.when(fits, F.col(c))).alias(f"n{i}{v}") for v, c in named.items())]
            variables.append(list(named))
        row = self.triples.agg(*asked).first()
        return [(float(row[f"n{i}"]), {v: float(row[f"n{i}{v}"]) for v in own}) for i, own in enumerate(variables)]

    def union(self, either: list[Solutions]) -> Solutions:
        """The rows of all, a variable that one of them lacks being unbound in its rows."""
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.frame for x in either))
        return Solutions(frame, frozenset.intersection(*(x.sure for x in either)))

    def group(self, elements: list[tuple]) -> Solutions:
        """The bindings of a group; its filters hold for all of it, and for nothing outside."""
        found, kept = self.unfiltered(elements)
        values = {v: F.col(v) for v in found.variables}
        return Solutions(reduce(lambda f, x: f.where(_truth(x, values)), kept, found.frame), found.sure)

    def unfiltered(self, elements: list[tuple]) -> tuple[Solutions, list[tuple]]:
        """The bindings of a group without its filters, and these. Options and exclusions hold for what stands before them."""
        now: Solutions | None = None
        run: list[tuple] = []
        tests: list[tuple[str, list[tuple]]] = []

        def joined() -> Solutions:
            nonlocal now, run
            if run:
                parts = self.parts(run)
                found = _in_order(parts if now is None else [Part(now, 1.0, dict.fromkeys(now.variables, 1.0)), *parts])
                now, run = found, []
            if now is None:
                raise ValueError("a group begins with a pattern")
            return now

        for e in elements:
            if e[0] == "option":
                right, kept = self.unfiltered(e[1])
                if not set(right.variables) & set(joined().variables):
                    raise ValueError("an option shares no variable with the others")
                now = _optional(joined(), right, kept)
            elif e[0] == "minus":
                now = _minus(joined(), self.group(e[1]))
            elif e[0] in ("present", "absent"):
                tests.append(e)
            elif e[0] != "filter":
                run.append(e)
        found = joined()
        for kind, inner in tests:
            right, kept = self.unfiltered(inner)
            found = _where_exists(found, right, kept, kind == "present")
        return found, [e[1] for e in elements if e[0] == "filter"]


# ---------------------------------------------------------------- the order of joins


def _estimate(a: tuple[float, dict[str, float]], b: tuple[float, dict[str, float]]) -> tuple[float, dict[str, float]]:
    """Rows and values of a join, keys being independent."""
    rows = a[0] * b[0]
    for v in a[1].keys() & b[1].keys():
        rows /= max(a[1][v], b[1][v], 1.0)
    return rows, {v: min(rows, min(x[1][v] for x in (a, b) if v in x[1])) for v in a[1].keys() | b[1].keys()}


def join_order(parts: list[tuple[float, dict[str, float]]]) -> tuple | int:
    """The tree of joins with the fewest intermediate rows; each join shares a variable.

    Of up to ``SEARCHED`` parts over all connected subsets; of more the cheapest join is taken first.
    """
    if len(parts) > SEARCHED:
        open_ = [(x, i) for i, x in enumerate(parts)]
        while len(open_) > 1:
            pairs = [(_estimate(a[0], b[0])[0], i, j) for i, a in enumerate(open_) for j, b in enumerate(open_) if i < j and a[0][1].keys() & b[0][1].keys()]
            if not pairs:
                raise ValueError("a pattern shares no variable with the others")
            _, i, j = min(pairs)
            two, one = open_.pop(j), open_.pop(i)
            open_.append((_estimate(one[0], two[0]), (one[1], two[1])))
        return open_[0][1]
    best: dict[int, tuple[float, tuple[float, dict[str, float]], tuple | int]] = {1 << i: (0.0, x, i) for i, x in enumerate(parts)}
    for whole in range(1, 1 << len(parts)):
        part = (whole - 1) & whole
        while part:
            one, two = best.get(part), best.get(whole ^ part)
            if one and two and part > whole ^ part and one[1][1].keys() & two[1][1].keys():
                size = _estimate(one[1], two[1])
                cost = one[0] + two[0] + size[0]
                if whole not in best or cost < best[whole][0]:
                    best[whole] = (cost, size, (one[2], two[2]))
            part = (part - 1) & whole
    if (1 << len(parts)) - 1 not in best:
        raise ValueError("a pattern shares no variable with the others")
    return best[(1 << len(parts)) - 1][2]


def _in_order(parts: list[Part]) -> Solutions:
    def build(tree: tuple | int) -> Solutions:
        return parts[tree].solutions if isinstance(tree, int) else _join(build(tree[0]), build(tree[1]))

    return build(join_order([(p.rows, p.values) for p in parts]))


def match_patterns(triples: DataFrame, where: str) -> DataFrame:
    """The bindings of a graph pattern over triples (s, p, o, optionally lang): a column for each variable.

    Read are prefixed names, ``;`` and ``,``, groups, OPTIONAL, UNION, MINUS, paths
    (``/ | ^ + * ?``), FILTER with comparisons, ``&& || !``, BOUND, REGEX, CONTAINS,
    STRSTARTS and STRENDS, and FILTER (NOT) EXISTS; a language tag asks for the
    triple's ``lang``. Triples with a null are left out. Numbers compare as numbers, two variables too if both read
    as such. Filters hold for their group, those of an option for whether it is taken. A group
    begins with a pattern. Parts that share no variable at all are refused, as
    their product would be all that there is.
    """
    reader = _Reader(where)
    elements = reader.group("")
    lost = _variables(elements, tests=True) - _variables(elements)
    if lost:
        raise ValueError(f"no pattern binds {sorted(n for n, v in reader.names.items() if v in lost)}")
    if reader.at < len(reader.tokens):
        raise ValueError(f"expected the end, found {reader.peek()}")
    found = _Solver(triples).group(elements).frame
    return found.select(*(F.col(v).alias(name) for name, v in reader.names.items() if v in found.columns))
