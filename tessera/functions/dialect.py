"""The SQL dialect: what differs from Spark SQL is rewritten to Spark SQL, the rest passes as it is.

Rewritten are, for each SELECT and the derived tables in its FROM:

- select aliases in WHERE, GROUP BY, HAVING and ORDER BY; a column of that name wins;
- ``+`` and ``-``: 32-bit wrap-around between integers, concatenation between strings;
- sum, avg, min, max: of integers in 32 bits, of strings over their byte lengths;
- an integer as a predicate (not zero is true), a comparison as a value (0 or 1);
- an aggregate without GROUP BY over no rows, which gives no row;
- names of derived-table columns without alias: ``unname_col<i>``.

All of that holds inside CASE, CAST, IN, BETWEEN, LIKE, IS NULL and common scalar
functions as well. Expressions beyond this grammar (OVER, subqueries, functions it
does not know) are left to Spark whole, with aliases put in. "Quoted" names are
names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"|\d+\.\d*|\.\d+|\d+|[^\W\d]\w*|<>|!=|<=|>=|\|\||::|.", re.S)
CLAUSES = ("from", "where", "group", "having", "order", "limit", "offset")
AGGREGATES = ("sum", "avg", "min", "max", "count")
RESERVED = frozenset("select from where group by having order limit offset join inner left right full outer cross on using as and or not asc desc union intersect except values natural semi anti lateral".split())

#: Scalar functions, and the type of what they give; none: that of their arguments.
FUNCTIONS = {"abs": "", "coalesce": "", "nullif": "", "greatest": "", "least": "", "length": "int", "char_length": "int", "octet_length": "int", "upper": "string", "lower": "string", "trim": "string", "concat": "string", "substring": "string", "replace": "string", "round": "other", "floor": "other", "ceil": "other", "sqrt": "other"}

#: Gives the (column, type) pairs of a FROM clause.
Schema = Callable[[str], list[tuple[str, str]]]


class Beyond(Exception):
    """An expression that this grammar does not know."""


def requoted(sql: str) -> str:
    """Names in double quotes get backquotes, as Spark reads them."""
    return "".join(f"`{t[1:-1]}`" if t.startswith('"') else t for t in TOKEN.findall(sql))


def tokens_of(sql: str) -> list[str]:
    return [t for t in TOKEN.findall(sql) if not t.isspace() and not t.startswith("--")]


def _text(tokens: list[str]) -> str:
    out = ""
    for i, t in enumerate(tokens):
        glue = not out or t in (".", ",", ")", "(") and not (t == "(" and tokens[i - 1].lower() in RESERVED | {"in", "over", "exists", ","}) or tokens[i - 1] in (".", "(")
        out += t if glue else f" {t}"
    return out


def split_at(tokens: list[str], mark: str) -> list[list[str]]:
    """Split at a token outside of parentheses."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t.lower() == mark and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def statements(sql: str) -> list[str]:
    return [_text(p) for p in split_at(tokens_of(sql), ";") if p]


@dataclass
class Select:
    items: list[list[str]]
    clauses: dict[str, list[str]]
    distinct: bool = False


def parse_select(tokens: list[str]) -> Select:
    if not tokens or tokens[0].lower() != "select":
        raise Beyond
    marks, depth = [], 0
    for i, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if not depth and t.lower() in ("union", "intersect", "except", "with", "window"):
            raise Beyond
        if not depth and t.lower() in CLAUSES:
            marks.append(i)
    ends = [*marks[1:], len(tokens)][: len(marks)]
    clauses = {}
    for i, end in zip(marks, ends, strict=True):
        name = tokens[i].lower()
        skip = 2 if name in ("group", "order") else 1
        clauses[name] = tokens[i + skip : end]
    head = tokens[1 : marks[0]] if marks else tokens[1:]
    distinct = bool(head) and head[0].lower() == "distinct"
    return Select(split_at(head[1:] if distinct else head, ","), clauses, distinct)


@dataclass
class Scope:
    columns: dict[str, str]  #: lower-case name, bare and qualified, to its type
    qualifiers: dict[str, str]  #: bare name to a qualifier that makes it a column
    aliases: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Expr:
    sql: str
    kind: str  #: int, string, bool or other
    aggregate: bool = False


def _kind(name: str) -> str:
    return {"int": "int", "smallint": "int", "tinyint": "int", "boolean": "bool"}.get(name, "string" if name == "string" or name.startswith(("varchar", "char")) else name)


class Parser:
    """Operator precedence over one expression, with types."""

    LEVELS = (("or",), ("and",), ("=", "<>", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, tokens: list[str], scope: Scope, grouped: frozenset[str] = frozenset()) -> None:
        self.tokens, self.scope, self.at, self.busy = tokens, scope, 0, grouped

    def peek(self) -> str:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Expr:
        out = self.level(0)
        if self.at != len(self.tokens):
            raise Beyond
        return out

    def level(self, n: int) -> Expr:
        if n == 2 and self.peek() == "not":
            self.take()
            inner = predicate(self.level(2))
            return Expr(f"(NOT {inner.sql})", "bool", inner.aggregate)
        if n == len(self.LEVELS):
            return self.atom()
        left = self.level(n + 1)
        while True:
            if self.peek() in self.LEVELS[n]:
                op = self.take()
                left = self.joined(left, op, self.level(n + 1))
            elif n == 2 and self.peek() in ("is", "in", "between", "like", "not"):
                left = self.tested(left)
            else:
                return left

    def word(self, *expected: str) -> str:
        if self.peek() not in expected:
            raise Beyond
        return self.take()

    def tested(self, a: Expr) -> Expr:
        """IS NULL, IN, BETWEEN and LIKE after their left side."""
        a = value(a)
        if self.peek() == "is":
            self.take()
            no = f"{self.take()} " if self.peek() == "not" else ""
            self.word("null")
            return Expr(f"({a.sql} IS {no}NULL)", "bool", a.aggregate)
        no = f"{self.take()} " if self.peek() == "not" else ""
        op = self.word("in", "between", "like").upper()
        if op == "IN":
            others = self.arguments()
            text = f"({', '.join(x.sql for x in others)})"
        elif op == "BETWEEN":
            low = self.level(3)
            self.word("and")
            others = [value(low), value(self.level(3))]
            text = f"{others[0].sql} AND {others[1].sql}"
        else:
            others = [self.level(3)]
            text = others[0].sql
        for b in others:
            if {a.kind, b.kind} == {"int", "string"}:
                raise TypeError(f"{a.kind} {op} {b.kind}")
        return Expr(f"({a.sql} {no}{op} {text})", "bool", a.aggregate or any(x.aggregate for x in others))

    def arguments(self) -> list[Expr]:
        self.word("(")
        if self.peek() in (")", "select"):
            raise Beyond
        out = [value(self.level(0))]
        while self.peek() == ",":
            self.take()
            out.append(value(self.level(0)))
        self.word(")")
        return out

    def case(self) -> Expr:
        parts, results, tests = ["CASE"], [], []
        if self.peek() != "when":
            tests.append(value(self.level(0)))
            parts.append(tests[0].sql)
        simple = bool(tests)
        while self.peek() == "when":
            self.take()
            test = self.level(0)
            tests.append(value(test) if simple else predicate(test))
            self.word("then")
            results.append(value(self.level(0)))
            parts.append(f"WHEN {tests[-1].sql} THEN {results[-1].sql}")
        if self.peek() == "else":
            self.take()
            results.append(value(self.level(0)))
            parts.append(f"ELSE {results[-1].sql}")
        self.word("end")
        return Expr(f"{' '.join(parts)} END", shared_kind(results), any(x.aggregate for x in [*results, *tests]))

    def cast(self) -> Expr:
        self.word("(")
        inner = value(self.level(0))
        self.word("as")
        kind = []
        while self.peek() != ")" or kind.count("(") > kind.count(")"):
            if self.at == len(self.tokens):
                raise Beyond
            kind.append(self.take())
        self.take()
        return Expr(f"CAST({inner.sql} AS {_text(kind)})", _kind({"integer": "int"}.get(kind[0].lower(), kind[0].lower())), inner.aggregate)

    def joined(self, a: Expr, op: str, b: Expr) -> Expr:
        aggregate = a.aggregate or b.aggregate
        if op.lower() in ("and", "or"):
            return Expr(f"({predicate(a).sql} {op.upper()} {predicate(b).sql})", "bool", aggregate)
        if op in self.LEVELS[2]:
            a, b = value(a), value(b)
            if {a.kind, b.kind} == {"int", "string"}:
                raise TypeError(f"{a.kind} {op} {b.kind}")
            return Expr(f"({a.sql} {op} {b.sql})", "bool", aggregate)
        a, b = value(a), value(b)
        if "null" in (a.kind, b.kind):
            a, b = (Expr(x.sql, y.kind, x.aggregate) if x.kind == "null" else x for x, y in ((a, b), (b, a)))
        if op in "+-*" and a.kind == b.kind == "int":
            return Expr(_wrapped(f"CAST({a.sql} AS BIGINT) {op} CAST({b.sql} AS BIGINT)"), "int", aggregate)
        if op == "+" and a.kind == b.kind == "string":
            return Expr(f"concat({a.sql}, {b.sql})", "string", aggregate)
        if {a.kind, b.kind} == {"int", "string"}:
            raise TypeError(f"{a.kind} {op} {b.kind}")
        return Expr(f"({a.sql} {op} {b.sql})", a.kind if a.kind == b.kind else "other", aggregate)

    def atom(self) -> Expr:
        t = self.take() if self.at < len(self.tokens) else ""
        if t == "(":
            inner = self.level(0)
            if self.peek() != ")":
                raise Beyond
            self.take()
            return inner
        if t == "-":
            inner = value(self.atom())
            return Expr(_wrapped(f"- CAST({inner.sql} AS BIGINT)") if inner.kind == "int" else f"(- {inner.sql})", inner.kind, inner.aggregate)
        if re.fullmatch(r"\d+", t):
            return Expr(t, "int" if int(t) < 1 << 31 else "bigint")
        if re.match(r"\d|\.\d", t):
            return Expr(t, "other")
        if t.startswith("'"):
            return Expr(t, "string")
        if t.lower() in ("true", "false"):
            return Expr(t, "bool")
        if t.lower() == "null":
            return Expr("NULL", "null")
        if t.lower() == "case":
            return self.case()
        if t.lower() == "cast" and self.peek() == "(":
            return self.cast()
        if not re.match(r"[^\W\d]|`", t) or t.lower() in RESERVED | {"case", "cast", "null", "interval", "date", "exists", "in", "between", "like", "is"}:
            raise Beyond
        if self.peek() == "(":
            return self.call(t)
        if self.peek() == ".":
            self.take()
            t = f"{t}.{self.take()}"
        return self.name(t)

    def name(self, t: str) -> Expr:
        low = t.replace("`", "").lower()
        if low in self.scope.columns:
            q = self.scope.qualifiers.get(low) if low in self.scope.aliases else None
            return Expr(f"{q}.{t}" if q else t, self.scope.columns[low])
        if low in self.scope.aliases and low not in self.busy:
            return Parser(self.scope.aliases[low], self.scope, self.busy | {low}).whole()
        raise Beyond

    def call(self, name: str) -> Expr:
        low = name.lower()
        if low in FUNCTIONS:
            inside = self.arguments()
            if self.peek() == "over":
                raise Beyond
            kind = FUNCTIONS[low] or shared_kind(inside)
            return Expr(f"{name}({', '.join(x.sql for x in inside)})", kind, any(x.aggregate for x in inside))
        self.take()
        if low not in AGGREGATES:
            raise Beyond
        distinct = ""
        if self.peek() == "distinct":
            distinct = f"{self.take()} "
        if self.peek() == "*" and low == "count":
            self.take()
            inner = Expr("*", "other")
        else:
            inner = value(self.level(0))
        if self.peek() != ")" or inner.aggregate:
            raise Beyond
        self.take()
        if self.peek() in ("over", "filter"):
            raise Beyond
        x = inner.sql
        if low == "count":
            return Expr(f"CAST(count({distinct}{x}) AS INT)", "int", True)
        if inner.kind == "string":
            x = f"octet_length({x})"
        elif inner.kind != "int":
            return Expr(f"{low}({distinct}{x})", inner.kind if low in ("min", "max") else "other", True)
        if low == "sum":
            return Expr(_wrapped(f"sum({distinct}CAST({x} AS BIGINT))"), "int", True)
        if low == "avg":
            return Expr(f"CAST(sum({distinct}CAST({x} AS BIGINT)) DIV count({distinct}{x}) AS INT)", "int", True)
        return Expr(f"{low}({x})", "int", True)


def _wrapped(sql: str) -> str:
    return f"CAST(pmod({sql} + 2147483648, 4294967296) - 2147483648 AS INT)"


def shared_kind(parts: list[Expr]) -> str:
    kinds = {p.kind for p in parts} - {"null"}
    return kinds.pop() if len(kinds) == 1 else "other" if kinds else "null"


def predicate(e: Expr) -> Expr:
    return Expr(f"({e.sql} <> 0)", "bool", e.aggregate) if e.kind == "int" else e


def value(e: Expr) -> Expr:
    return Expr(f"CAST({e.sql} AS INT)", "int", e.aggregate) if e.kind == "bool" else e


class Dialect:
    def __init__(self, schema: Schema) -> None:
        self.schema = schema

    def translate(self, sql: str) -> str:
        """Spark SQL for a SELECT of the dialect; text that is no plain SELECT comes back as it is, but for quoted names."""
        sql = requoted(sql)
        try:
            return self._select(tokens_of(sql), derived=False)
        except Beyond:
            return sql

    def _from(self, tokens: list[str]) -> str:
        out: list[str] = []
        i = 0
        while i < len(tokens):
            if tokens[i] == "(" and i + 1 < len(tokens) and tokens[i + 1].lower() == "select":
                depth, j = 1, i + 1
                while depth:
                    depth += (tokens[j] == "(") - (tokens[j] == ")")
                    j += 1
                inner = tokens[i + 1 : j - 1]
                try:
                    out.append(f"({self._select(inner, derived=True)})")
                except Beyond:
                    out.append(f"({_text(inner)})")
                i = j
            else:
                out.append(tokens[i])
                i += 1
        return self._on(out)

    def _on(self, tokens: list[str]) -> str:
        """ON conditions get the dialect's arithmetic, over the columns of the tables before them."""
        text, i = "", 0
        while i < len(tokens):
            if tokens[i].lower() != "on":
                text = _text([text, tokens[i]]) if text else tokens[i]
                i += 1
                continue
            j = i + 1
            depth = 0
            while j < len(tokens) and (depth or tokens[j].lower() not in ("join", "inner", "left", "right", "full", "cross", ",")):
                depth += (tokens[j] == "(") - (tokens[j] == ")")
                j += 1
            try:
                condition = predicate(Parser(tokens[i + 1 : j], self._scope(re.sub(r"(?i)\b(inner|left|right|full)( outer)? join\b|(?<!cross )\bjoin\b", "CROSS JOIN", text) if " on " not in text.lower() else text + " ON true")).whole()).sql
            except Beyond:
                condition = _text(tokens[i + 1 : j])
            text = f"{text} ON {condition}"
            i = j
        return text

    def _scope(self, source: str) -> Scope:
        columns: dict[str, str] = {}
        qualifiers: dict[str, str] = {}
        for name, kind in self.schema(source):
            low = name.lower()
            columns[low] = _kind(kind)
            if "." in low:
                q, bare = low.rsplit(".", 1)
                columns.setdefault(bare, _kind(kind))
                qualifiers.setdefault(bare, q)
        return Scope(columns, qualifiers)

    def _select(self, tokens: list[str], derived: bool) -> str:
        s = parse_select(tokens)
        if "from" not in s.clauses:
            raise Beyond
        source = self._from(s.clauses["from"])
        scope = self._scope(source)
        items = []
        for i, item in enumerate(s.items):
            alias = None
            if len(item) > 2 and item[-2].lower() == "as":
                item, alias = item[:-2], item[-1]
            elif len(item) > 1 and re.match(r"[^\W\d]|`", item[-1]) and item[-2] not in (".", "+", "-", "<", ">", "=", "(") and item[-1].lower() not in RESERVED | {"end"}:
                item, alias = item[:-1], item[-1]
            if alias:
                scope.aliases[alias.replace("`", "").lower()] = item
            items.append((i, item, alias))
        aggregated = False
        out = []
        for i, item, alias in items:
            if item[-1:] == ["*"] and (len(item) == 1 or item[-2] == "."):
                out.append(_text(item))
                continue
            # an alias is not seen by the other items
            try:
                e = value(Parser(item, Scope(scope.columns, {}, {})).whole())
                aggregated |= e.aggregate
                sql, name = e.sql, _text(item)
            except Beyond:
                sql, name = _text(item), None
                lower = [t.lower() for t in item]
                aggregated |= "over" not in lower and "select" not in lower and any(t in AGGREGATES for t in lower)
            label = alias or (f"unname_col{i}" if derived else None)
            if not label and name and sql != name:
                label = f"`{name}`"
            out.append(f"{sql} AS {label}" if label else sql)
        keys, hidden = [], []
        for key in split_at(s.clauses["order"], ",") if "order" in s.clauses else []:
            at = next((k for k, t in enumerate(key) if t.lower() in ("asc", "desc", "nulls")), len(key))
            text, has = self._expr(key[:at], scope)
            if has:  # an aggregate is computed beside the columns, sorted by, and left out
                hidden.append(f"{text} AS _key{len(hidden)}")
                text = f"_key{len(hidden) - 1}"
            keys.append(_text([text, *key[at:]]))
        if hidden:
            out = [x if " AS " in x else f"{x} AS `{_text(i[1])}`" for x, i in zip(out, items, strict=True)]
        names = [x.rsplit(" AS ", 1)[-1] for x in out]
        sql = f"SELECT {'DISTINCT ' if s.distinct else ''}{', '.join([*out, *hidden])} FROM {source}"
        if "where" in s.clauses:
            sql += f" WHERE {self._expr(s.clauses['where'], scope, True)[0]}"
        if "group" in s.clauses:
            sql += " GROUP BY " + ", ".join(self._expr(g, scope)[0] for g in split_at(s.clauses["group"], ","))
        having = []
        if "having" in s.clauses:
            text, has = self._expr(s.clauses["having"], scope, True)
            having.append(f"({text})")
            aggregated |= has
        if aggregated and "group" not in s.clauses:
            having.append("count(*) > 0")
        if having:
            sql += f" HAVING {' AND '.join(having)}"
        if hidden:
            sql = f"SELECT {', '.join(names)} FROM ({sql})"
        if keys:
            sql += f" ORDER BY {', '.join(keys)}"
        for name in ("limit", "offset"):
            if name in s.clauses:
                sql += f" {name.upper()} {_text(s.clauses[name])}"
        return sql

    def _expr(self, tokens: list[str], scope: Scope, condition: bool = False) -> tuple[str, bool]:
        try:
            e = Parser(tokens, scope).whole()
            e = predicate(e) if condition else e
            return (e.sql if condition or e.kind != "bool" else value(e).sql), e.aggregate
        except Beyond:
            out = []
            for i, t in enumerate(tokens):
                low = t.lower()
                lone = (i == 0 or tokens[i - 1] != ".") and (i + 1 == len(tokens) or tokens[i + 1] not in (".", "("))
                out.append(f"({_text(scope.aliases[low])})" if lone and low in scope.aliases and low not in scope.columns else t)
            return _text(out), any(t.lower() in AGGREGATES for t in tokens)
