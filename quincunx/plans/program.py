"""Reads a model program and lowers its formula straight to Spark SQL text.

There is no tree and no optimiser here: every operator of the formula turns into a
piece of SQL as soon as it is read, and Catalyst folds, shares and compiles the rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quincunx.functions.arithmetic import ieee_div_sql

# Fixed values of the program format.
STATISTICS = (
    "avg", "min", "max", "var", "std", "count",
    "valid_rate", "discard_rate", "p05", "p50", "p95",
)
DIRECTIVES = (
    "\\model", "\\normal", "\\distrib", "\\uniform", "\\iter", "\\response",
    "\\frac", "\\sqrt", "\\pm",
)
PROBABILITY_TOLERANCE = Decimal("1e-12")
PHASES = {"LEX": "LEXICAL", "SYN": "SYNTACTIC", "SEM": "SEMANTIC", "GEN": "GENERATION"}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    start_offset: int
    end_offset: int
    line: int
    column: int
    lexeme: str
    expected: tuple[str, ...] = ()
    found: str | None = None

    @property
    def phase(self) -> str:
        return PHASES[self.code[:3]]


class ProgramError(ValueError):
    """A program that cannot run, with every problem found in it."""

    def __init__(self, diagnostics: list[Diagnostic]):
        self.diagnostics = tuple(diagnostics)
        super().__init__("; ".join(f"{d.code} line {d.line}:{d.column} {d.message}" for d in diagnostics))


@dataclass(frozen=True)
class Normal:
    mean: float
    std: float


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float


@dataclass(frozen=True)
class Discrete:
    values: tuple[float, ...]
    probabilities: tuple[float, ...]


Distribution = Normal | Uniform | Discrete


@dataclass(frozen=True)
class Formula:
    """SQL text over columns v0, v1, ... (one per name, in order of first use).

    ``steps`` are intermediate columns that must exist before ``branches`` can be
    computed; they hold operands that the text mentions more than once.
    """

    names: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]
    branches: tuple[str, ...]

    @property
    def branch_ids(self) -> tuple[str, ...]:
        return ("main",) if len(self.branches) == 1 else ("plus", "minus")

    def evaluate(self, df: DataFrame, keep: list[str] | None = None, bind: Mapping[str, Column | str] | None = None) -> DataFrame:
        """``keep`` columns of ``df`` plus one raw column per branch.

        ``bind`` gives the column behind each formula name; without it ``df`` must
        already have the columns v0, v1, ...
        """
        keep = list(keep or [])
        if bind is not None:
            missing = [name for name in self.names if name not in bind]
            if missing:
                raise KeyError(f"formula names without a column: {missing}")
            inputs = [
                (F.col(bind[name]) if isinstance(bind[name], str) else bind[name]).cast("double").alias(f"v{k}")
                for k, name in enumerate(self.names)
            ]
            df = df.select(*keep, *inputs)
        # Catalyst keeps a projection whose results are used twice; steps that do not
        # depend on each other share one.
        level: dict[str, int] = {}
        for name, sql in self.steps:
            level[name] = 1 + max((level[used] for used in re.findall(r"t[0-9]+", sql)), default=0)
        for depth in sorted(set(level.values())):
            df = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in self.steps if level[name] == depth])
        return df.selectExpr(
            *keep, *[f"cast({sql} AS double) AS {b}" for b, sql in zip(self.branch_ids, self.branches)]
        )


@dataclass(frozen=True)
class Program:
    output: str
    formula: Formula
    variables: Mapping[str, Distribution]  # in declaration order
    iterations: int
    response: tuple[str, ...]

    def with_iterations(self, iterations: int) -> "Program":
        return replace(self, iterations=int(iterations))


@dataclass(frozen=True)
class _Token:
    kind: str  # directive, name, number, statistic, symbol, end
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class _Term:
    """A part of the formula: SQL per branch, and the exact value when it is constant."""

    sql: tuple[str, ...]
    value: Decimal | None = None


_NUMBER = r"(?:(?:0|[1-9][0-9]*)(?:\.[0-9]+)?|\.[0-9]+)"
_LEXEME = re.compile(
    rf"(?P<space>\s+)|(?P<directive>\\[A-Za-z]*)|(?P<name>[A-Za-z][A-Za-z0-9_]*)"
    rf"|(?P<number>{_NUMBER})|(?P<symbol>[{{}}=,+\-*/^])"
)
_RESPONSE_LEXEME = re.compile(r"(?P<space>\s+)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|(?P<symbol>[},])")
_PLAIN = re.compile(r"[vt][0-9]+|\(-[0-9.e+-]+D\)|[0-9.e+-]+D")


def _diagnostic(source: str, code: str, message: str, start: int, end: int, expected=(), found=None) -> Diagnostic:
    line = source.count("\n", 0, start) + 1
    column = start - (source.rfind("\n", 0, start) + 1) + 1
    return Diagnostic(code, message, start, end, line, column, source[start:end], tuple(expected), found)


def scan(source: str) -> list[_Token]:
    """Splits a program into tokens, ending with one ``end`` token."""

    def fail(code: str, message: str, start: int, end: int):
        raise ProgramError([_diagnostic(source, code, message, start, end)])

    tokens: list[_Token] = []
    at, response = 0, "no"  # response: no -> opening -> inside
    while at < len(source):
        found = (_RESPONSE_LEXEME if response == "inside" else _LEXEME).match(source, at)
        if found is None:
            char = source[at]
            if response == "inside":
                fail("LEX006", "only statistic names, commas and a closing brace may stand here", at, at + 1)
            if char == ".":
                fail("LEX003", "a number needs digits after its point", at, at + 1)
            fail("LEX005", f"character {char!r} is not part of the language", at, at + 1)
        kind, text, end = found.lastgroup, found.group(), found.end()
        if kind == "word":
            if text not in STATISTICS:
                fail("LEX007", f"unknown statistic {text!r}", at, end)
            kind = "statistic"
        elif kind == "directive":
            if text == "\\":
                fail("LEX002", "a directive needs a name", at, end)
            if text not in DIRECTIVES:
                fail("LEX001", f"unknown directive {text}", at, end)
            if text == "\\response":
                response = "opening"
        elif kind == "number" and end < len(source) and source[end] in ".0123456789":
            fail("LEX003", "malformed number", at, end + 1)
        elif kind == "symbol" and text == "{" and response == "opening":
            response = "inside"
        elif kind == "symbol" and text == "}" and response == "inside":
            response = "no"
        if kind != "space":
            tokens.append(_Token(kind, text, at, end))
        at = end
    tokens.append(_Token("end", "", len(source), len(source)))
    return tokens


@dataclass
class _Reader:
    source: str
    tokens: list[_Token]
    at: int = 0
    problems: list[Diagnostic] = field(default_factory=list)
    late_problems: list[Diagnostic] = field(default_factory=list)
    uses: dict[str, _Token] = field(default_factory=dict)
    steps: list[tuple[str, str]] = field(default_factory=list)
    forks: int = 0

    # -- tokens -------------------------------------------------------------
    @property
    def next(self) -> _Token:
        return self.tokens[self.at]

    def take(self) -> _Token:
        token = self.next
        self.at += 1
        return token

    def stop(self, code: str, message: str, expected=()):
        token = self.next
        raise ProgramError(
            [_diagnostic(self.source, code, message, token.start, token.end, expected, token.text or "end of program")]
        )

    def expect(self, text: str | None = None, kind: str | None = None) -> _Token:
        token = self.next
        if (text is not None and token.text != text) or (kind is not None and token.kind != kind):
            wanted = text or kind
            self.stop("SYN001", f"expected {wanted}, found {token.text or 'the end'}", (wanted,))
        return self.take()

    def report(self, code: str, message: str, first: _Token, last: _Token | None = None, late: bool = False):
        last = last or first
        into = self.late_problems if late else self.problems
        into.append(_diagnostic(self.source, code, message, first.start, last.end))

    def double(self, value: Decimal, token: _Token) -> float:
        number = float(value)
        if math.isinf(number):
            self.report("GEN001", "literal is too large for a double", token, late=True)
        elif number == 0.0 and value != 0:
            self.report("GEN004", "non-zero literal vanishes as a double", token, late=True)
        return number

    def signed(self) -> tuple[Decimal, _Token]:
        sign = self.take() if self.next.text in ("+", "-") else None
        token = self.expect(kind="number")
        value = Decimal(token.text)
        return (-value if sign and sign.text == "-" else value), token

    # -- formula ------------------------------------------------------------
    def literal(self, value: Decimal, token: _Token) -> str:
        number = self.double(value, token)
        return f"(-{-number!r}D)" if math.copysign(1.0, number) < 0 else f"{number!r}D"

    def pin(self, sql: str) -> str:
        """A name for ``sql`` so that it can be mentioned twice but computed once."""
        if _PLAIN.fullmatch(sql):
            return sql
        for name, known in self.steps:
            if known == sql:
                return name
        name = f"t{len(self.steps)}"
        self.steps.append((name, sql))
        return name

    def combine(self, left: _Term, right: _Term, text, value) -> _Term:
        exact = None
        if left.value is not None and right.value is not None:
            with localcontext() as context:
                context.prec = 60
                try:
                    exact = value(left.value, right.value)
                except (InvalidOperation, ZeroDivisionError, OverflowError):
                    exact = None
        return _Term(tuple(text(a, b) for a in left.sql for b in right.sql), exact)

    def quotient(self, left: _Term, right: _Term, first: _Token, last: _Token) -> _Term:
        if right.value is not None and right.value == 0:
            self.report("SEM050", "a constant denominator must not be zero", first, last)

        def text(n: str, d: str) -> str:
            if right.value is not None and re.fullmatch(r"[0-9.e+-]+D", d):
                return f"({n} / {d})"
            return ieee_div_sql(self.pin(n), self.pin(d))

        return self.combine(left, right, text, lambda n, d: n / d if d != 0 else None)

    def fork(self, left: _Term, right: _Term) -> _Term:
        self.forks += 1
        if len(left.sql) * len(right.sql) != 1:
            return left  # a second \pm: reported as SEM040 once the program is read
        a, b = self.pin(left.sql[0]), self.pin(right.sql[0])
        return _Term((f"({a} + {b})", f"({a} - {b})"))

    def formula(self, floor: int = 0) -> _Term:
        left = self.factor()
        while True:
            token = self.next
            if token.text in ("+", "-", "\\pm"):
                if floor >= 1:
                    return left
                self.take()
                right = self.formula(1)
                if token.text == "\\pm":
                    left = self.fork(left, right)
                elif token.text == "+":
                    left = self.combine(left, right, "({} + {})".format, Decimal.__add__)
                else:
                    left = self.combine(left, right, "({} - {})".format, Decimal.__sub__)
            elif token.text == "/":
                self.take()
                first = self.next
                right = self.factor()
                left = self.quotient(left, right, first, self.tokens[self.at - 1])
            elif token.text == "*":
                self.take()
                left = self.combine(left, self.factor(), "({} * {})".format, Decimal.__mul__)
            elif token.kind == "name" or token.text in ("\\frac", "\\sqrt", "{"):
                left = self.combine(left, self.power(), "({} * {})".format, Decimal.__mul__)
            elif token.kind == "number":
                self.stop("SYN042", "an implicit factor cannot start with a number", ("name", "\\frac", "\\sqrt", "{"))
            else:
                return left

    def factor(self) -> _Term:
        sign = self.take() if self.next.text in ("+", "-") else None
        term = self.power()
        if sign is None or sign.text == "+":
            return term
        return _Term(tuple(f"(-{sql})" for sql in term.sql), None if term.value is None else -term.value)

    def power(self) -> _Term:
        first = self.next
        base = self.atom()
        if self.next.text != "^":
            return base
        self.take()
        exponent, token = self.signed()
        if base.value is not None and base.value == 0 and exponent < 0:
            self.report("SEM052", "zero to a negative power is not defined", first, token)

        def exact(b: Decimal, e: Decimal):
            return b ** int(e) if e == e.to_integral_value() else None

        return self.combine(base, _Term((self.literal(exponent, token),), exponent), "power({}, {})".format, exact)

    def braced(self) -> _Term:
        self.expect("{")
        term = self.formula()
        self.expect("}")
        return term

    def atom(self) -> _Term:
        token = self.next
        if token.kind == "name":
            self.take()
            self.uses.setdefault(token.text, token)
            return _Term((f"v{list(self.uses).index(token.text)}",))
        if token.kind == "number":
            self.take()
            value = Decimal(token.text)
            return _Term((self.literal(value, token),), value)
        if token.text == "{":
            return self.braced()
        if token.text == "\\frac":
            self.take()
            above = self.braced()
            first = self.next
            below = self.braced()
            return self.quotient(above, below, first, self.tokens[self.at - 1])
        if token.text == "\\sqrt":
            self.take()
            first = self.next
            inner = self.braced()
            value = None
            if inner.value is not None:
                if inner.value < 0:
                    self.report("SEM051", "square root of a negative constant", first, self.tokens[self.at - 1])
                else:
                    value = inner.value.sqrt()
            return _Term(tuple(f"sqrt({sql})" for sql in inner.sql), value)
        self.stop("SYN041", "expected a formula", ("name", "number", "\\frac", "\\sqrt", "{"))

    # -- declarations ---------------------------------------------------------
    def pairs(self) -> list[tuple[Decimal, Decimal, _Token, _Token]]:
        found = []
        if self.next.text != "{":
            self.stop("SYN020", "a discrete variable needs at least one {value,probability} pair", ("{",))
        while True:
            first = self.expect("{")
            value, _ = self.signed()
            self.expect(",")
            probability = Decimal(self.expect(kind="number").text)
            found.append((value, probability, first, self.expect("}")))
            if self.next.text == "{":
                self.stop("SYN022", "pairs must be separated by commas", (",",))
            if self.next.text != ",":
                return found
            self.take()
            if self.next.text != "{":
                self.stop("SYN021", "expected another {value,probability} pair", ("{",))

    def discrete(self, name: _Token) -> Discrete:
        pairs = self.pairs()
        seen: set[Decimal] = set()
        as_double: dict[float, Decimal] = {}
        for value, probability, first, last in pairs:
            if not 0 <= probability <= 1:
                self.report("SEM012", f"probability {probability} is outside [0, 1]", first, last)
            if value in seen:
                self.report("SEM014", f"value {value} is repeated", first, last)
            seen.add(value)
            number = self.double(value, first)
            if as_double.setdefault(number, value) != value:
                self.report("GEN006", "two values become equal as doubles", first, last, late=True)
        total = sum((p for _, p, _, _ in pairs), Decimal(0))
        if abs(total - 1) > PROBABILITY_TOLERANCE:
            self.report("SEM013", f"probabilities of {name.text} sum to {total}, not 1", name)
        return Discrete(tuple(float(v) for v, *_ in pairs), tuple(float(p) for _, p, *_ in pairs))

    def declaration(self) -> tuple[_Token, Distribution]:
        kind = self.take().text
        name = self.expect(kind="name")
        self.expect("{")
        if kind == "\\distrib":
            distribution: Distribution = self.discrete(name)
        else:
            a, first = self.signed()
            self.expect(",")
            b, second = self.signed()
            low, high = self.double(a, first), self.double(b, second)
            if kind == "\\normal":
                if b <= 0:
                    self.report("SEM010", f"standard deviation of {name.text} must be positive", name, second)
                distribution = Normal(low, high)
            else:
                if not a < b:
                    self.report("SEM011", f"minimum of {name.text} must be below its maximum", name, second)
                elif not low < high:
                    self.report("GEN005", f"limits of {name.text} are equal as doubles", name, second, late=True)
                distribution = Uniform(low, high)
        self.expect("}")
        return name, distribution

    def program(self) -> Program:
        self.expect("\\model")
        self.expect("{")
        output = self.expect(kind="name")
        self.expect("=")
        first = self.next
        result = self.formula()
        self.expect("}")
        if self.forks > 1:
            self.report("SEM040", "a model may hold one \\pm at most", first, self.tokens[self.at - 1])

        declared: dict[str, tuple[_Token, Distribution]] = {}
        if self.next.text not in ("\\normal", "\\uniform", "\\distrib"):
            code = "SYN010" if self.next.text == "\\iter" else "SYN011"
            self.stop(code, "expected a distribution", ("\\normal", "\\uniform", "\\distrib"))
        while self.next.text in ("\\normal", "\\uniform", "\\distrib"):
            name, distribution = self.declaration()
            if name.text == output.text:
                self.report("SEM001", f"result {name.text} cannot be random", name)
            elif name.text in declared:
                self.report("SEM004", f"{name.text} is declared twice", name)
            else:
                declared[name.text] = (name, distribution)
        if not declared:
            self.report("SEM006", "the model has no valid random variable", output)
        for name, token in self.uses.items():
            if name == output.text:
                self.report("SEM002", f"result {name} cannot appear in its own formula", token)
            elif name not in declared:
                self.report("SEM003", f"{name} is used but not declared", token)
        for name, (token, _) in declared.items():
            if name not in self.uses:
                self.report("SEM005", f"{name} is declared but not used", token)

        self.expect("\\iter")
        self.expect("{")
        count = self.expect(kind="number")
        self.expect("}")
        if "." in count.text:
            self.report("SEM020", "the iteration count must be an integer", count)
        elif int(count.text) < 1:
            self.report("SEM021", "the iteration count must be 1 or more", count)

        opening = self.expect("\\response")
        self.expect("{")
        response: list[str] = []
        while True:
            if self.next.kind != "statistic":
                self.stop("SYN030", "expected a statistic", STATISTICS)
            response.append(self.take().text)
            if self.next.text != ",":
                break
            self.take()
        closing = self.expect("}")
        repeated = sorted({name for name in response if response.count(name) > 1})
        if repeated:
            self.report("SEM030", "repeated statistics: " + ", ".join(repeated), opening, closing)
        self.expect(kind="end")

        if self.problems or self.late_problems:
            raise ProgramError(self.problems or self.late_problems)
        return Program(
            output=output.text,
            formula=Formula(tuple(self.uses), tuple(self.steps), result.sql),
            variables={name: distribution for name, (_, distribution) in declared.items()},
            iterations=int(count.text),
            response=tuple(response),
        )


def read_program(text: str) -> Program:
    """A checked program; raises ProgramError with coded diagnostics otherwise."""
    return _Reader(text, scan(text)).program()


def read_formula(text: str) -> Formula:
    """A formula on its own, for use over the columns of any table."""
    reader = _Reader(text, scan(text))
    result = reader.formula()
    reader.expect(kind="end")
    if reader.forks > 1:
        reader.report("SEM040", "a formula may hold one \\pm at most", reader.tokens[0])
    problems = reader.problems or reader.late_problems
    if problems:
        raise ProgramError(problems)
    return Formula(tuple(reader.uses), tuple(reader.steps), result.sql)
