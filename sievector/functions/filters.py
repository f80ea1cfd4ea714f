"""The filter language: text to syntax tree, tree to a Spark column or to bucket sets.

Grammar: OR of ANDs of predicates or parentheses.  Predicates: ``field op literal`` with six operators,
``field BETWEEN lo AND hi``, ``field IN [v, ...]``; ``lo <= field <= hi`` is sugar.  There is no NOT.

Values are compared as numbers if the value and every literal of the predicate are numbers, else as text in
byte order.  A missing value makes a predicate false.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number; what overflows to infinity does not.
NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TOKEN = re.compile(
    r"""\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.]))|(?P<word>[A-Za-z_][A-Za-z0-9_.-]*)
    |'(?P<single>(?:[^'\\]|\\.)*)'|"(?P<double>(?:[^"\\]|\\.)*)"|(?P<op>==|!=|>=|<=|>|<)|(?P<mark>[()\[\],]))""",
    re.X | re.S,
)
_FLIP = {"<": ">", "<=": ">="}


class FilterError(ValueError):
    """A filter that can't be read; the message has the place."""


def number(text: str) -> float | None:
    """The finite number that a text stands for, or None."""
    if re.match(NUM, text):
        x = float(text)
        return x if math.isfinite(x) else None
    return None


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Between:
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Logic:
    op: str  # AND or OR
    left: Node
    right: Node


Node = Compare | Between | In | Logic


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character at {at + len(text[at:]) - len(text[at:].lstrip())}")
        kind = m.lastgroup
        value = m[kind]
        if kind in ("single", "double"):
            kind, value = "string", re.sub(r"\\(.)", r"\1", value, flags=re.S)
        if kind == "word" and value.upper() in ("AND", "OR", "IN", "BETWEEN"):
            kind, value = "key", value.upper()
        out.append((kind, value, m.start(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.end = tokenize(text), 0, len(text)

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("key", "mark", "op") and self.tokens[self.at][1] in values

    def place(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else self.end

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise FilterError(f"expected {' or '.join(values)} at {self.place()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def literal(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("number", "string", "word"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise FilterError(f"expected a literal at {self.place()}")

    def chain(self, op: str, part) -> Node:
        node = part()
        while self.peek(op):
            self.at += 1
            node = Logic(op, node, part())
        return node

    def either(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", self.primary))

    def primary(self) -> Node:
        if self.peek("("):
            self.at += 1
            node = self.either()
            self.take(")")
            return node
        kinds = [(k, v if k == "op" else "") for k, v, _ in self.tokens[self.at : self.at + 5]]
        if [k for k, _ in kinds] == ["number", "op", "word", "op", "number"] and kinds[1][1] in _FLIP and kinds[3][1] in _FLIP:
            low, first, name, second, high = (v for _, v, _ in self.tokens[self.at : self.at + 5])
            self.at += 5
            return Logic("AND", Compare(name, _FLIP[first], low), Compare(name, second, high))
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise FilterError(f"expected a field at {self.place()}")
        name = self.tokens[self.at][1]
        self.at += 1
        if self.peek("BETWEEN"):
            self.at += 1
            low = self.literal()
            self.take("AND")
            return Between(name, low, self.literal())
        if self.peek("IN"):
            self.at += 1
            self.take("[")
            values = [self.literal()]
            while self.peek(","):
                self.at += 1
                values.append(self.literal())
            self.take("]")
            return In(name, tuple(values))
        return Compare(name, self.take("==", "!=", ">=", "<=", ">", "<"), self.literal())


def parse(text: str) -> Node:
    """The tree of a filter."""
    if not text.strip():
        raise FilterError("the filter is empty")
    parser = _Parser(text)
    node = parser.either()
    if parser.at < len(parser.tokens):
        raise FilterError(f"unexpected {parser.tokens[parser.at][1]!r} at {parser.place()}")
    return node


def leaves(node: Node) -> list[Node]:
    return leaves(node.left) + leaves(node.right) if isinstance(node, Logic) else [node]


def referenced_fields(node: Node) -> list[str]:
    return list(dict.fromkeys(x.field for x in leaves(node)))


# -- evaluation in plain Python: the rule that columns and category buckets follow ------------------------


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _test(value: str, op: str, literals: list[str]) -> bool:
    numbers = [number(value), *map(number, literals)]
    if None not in numbers:
        value, *literals = numbers
    else:
        value, *literals = (x.encode() for x in (value, *literals))
    return literals[0] <= value <= literals[1] if op == "between" else _OPS[op](value, literals[0])


def matches(node: Node, row: dict[str, str | None]) -> bool:
    """Whether a row of texts satisfies the filter."""
    if isinstance(node, Logic):
        pair = (matches(node.left, row), matches(node.right, row)) if node.op == "AND" else None
        return all(pair) if pair else matches(node.left, row) or matches(node.right, row)
    value = row.get(node.field)
    if value is None:
        return False
    if isinstance(node, Compare):
        return _test(value, node.op, [node.value])
    if isinstance(node, Between):
        return _test(value, "between", [node.low, node.high])
    return any(_test(value, "==", [v]) for v in node.values)


# -- columns ----------------------------------------------------------------------------------------------


def _exact(x: float) -> Column:
    return F.lit(int(x)) if x == int(x) and abs(x) < 2**31 else F.lit(x)


def numeric_value(column: Column, kind: T.DataType) -> Column:
    """The column as a double where it is a number, else null."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    x = F.when(column.cast("string").rlike(NUM), column.cast("string").try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_column(node: Node, schema: T.StructType, columns: dict[str, Column] | None = None) -> Column:
    """The filter as a boolean column over ``schema``.

    Numeric columns against numeric literals become plain comparisons, which reach the scan.  Missing
    values give null, which a filter drops like false.
    """
    if isinstance(node, Logic):
        left, right = (to_column(x, schema, columns) for x in (node.left, node.right))
        return left & right if node.op == "AND" else left | right
    if node.field not in schema.names:
        raise FilterError(f"unknown field {node.field!r}")
    kind = schema[node.field].dataType
    column = (columns or {}).get(node.field, F.col(f"`{node.field}`"))

    def one(op: str, literals: list[str]) -> Column:
        numbers = [number(x) for x in literals]
        test = lambda c, values: c.between(*values) if op == "between" else _OPS[op](c, values[0])
        as_text = lambda: test(column.cast("string"), [F.lit(x) for x in literals])
        if None in numbers:
            return as_text()
        values = [_exact(x) for x in numbers]
        if isinstance(kind, T.NumericType):
            return test(column, values)
        x = numeric_value(column, kind)
        return F.when(x.isNotNull(), test(x, [F.lit(float(n)) for n in numbers])).otherwise(as_text())

    if isinstance(node, Compare):
        return one(node.op, [node.value])
    if isinstance(node, Between):
        return one("between", [node.low, node.high])
    numbers = [number(v) for v in node.values]
    if isinstance(kind, T.NumericType) and None not in numbers:
        return column.isin([int(x) if x == int(x) and abs(x) < 2**31 else x for x in numbers])
    return reduce(lambda a, b: a | b, [one("==", [v]) for v in node.values])


# -- shapes -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Interval:
    field: str
    low: float = -math.inf
    high: float = math.inf
    low_closed: bool = True
    high_closed: bool = True

    def holds(self, x: float) -> bool:
        above = x >= self.low if self.low_closed else x > self.low
        return above and (x <= self.high if self.high_closed else x < self.high)

    def meet(self, other: Interval) -> Interval:
        low, low_closed = max((self.low, not self.low_closed), (other.low, not other.low_closed))
        high, high_closed = min((self.high, self.high_closed), (other.high, other.high_closed))
        return Interval(self.field, low, high, not low_closed, high_closed)


def as_interval(node: Node) -> Interval | None:
    """The interval of a BETWEEN, one inequality, or an AND of such on one field; None for other trees."""
    if isinstance(node, Between) and None not in (bounds := (number(node.low), number(node.high))):
        return Interval(node.field, *bounds)
    if isinstance(node, Compare) and node.op in (">", ">=", "<", "<=") and (x := number(node.value)) is not None:
        return Interval(node.field, low=x, low_closed=node.op == ">=") if node.op[0] == ">" else Interval(node.field, high=x, high_closed=node.op == "<=")
    if isinstance(node, Logic) and node.op == "AND":
        left, right = as_interval(node.left), as_interval(node.right)
        if left and right and left.field == right.field:
            return left.meet(right)
    return None


def single_field(node: Node) -> str | None:
    names = referenced_fields(node)
    return names[0] if len(names) == 1 else None


def single_equality(node: Node) -> tuple[str, str] | None:
    return (node.field, node.value) if isinstance(node, Compare) and node.op == "==" else None


def equality_tree(node: Node) -> bool:
    """Whether the tree is ANDs and ORs of equalities only."""
    return all(single_equality(x) for x in leaves(node))


def two_equalities(node: Node) -> tuple[str, Compare, Compare]:
    """(AND or OR, left, right) of a filter of two equalities on different fields."""
    if not (isinstance(node, Logic) and isinstance(node.left, Compare) and isinstance(node.right, Compare) and equality_tree(node)):
        raise FilterError("expected two equalities joined by AND or OR")
    if node.left.field == node.right.field:
        raise FilterError("the two fields must differ")
    return node.op, node.left, node.right


def relaxed(node: Node) -> Node:
    """The filter that a walk uses: every AND becomes OR."""
    return Logic("OR", relaxed(node.left), relaxed(node.right)) if isinstance(node, Logic) else node


# -- buckets ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Attribute:
    """How a column is encoded: categories by name, or numbers between a least and a greatest value."""

    key: str
    numeric: bool
    usable_bins: int
    min_value: float | None = None
    max_value: float | None = None
    categories: dict[str, int] = field(default_factory=dict, hash=False)
    all_numbers: bool = True

    def bucket(self, x: float) -> int:
        if self.max_value is None or not self.max_value > self.min_value:
            return 0
        place = math.trunc((x - self.min_value) / (self.max_value - self.min_value) * self.usable_bins)
        return min(max(place, 0), self.usable_bins - 1)


def allowed_buckets(node: Node, attribute: Attribute) -> set[int]:
    """Buckets that may hold a match of one predicate; never leaves out a bucket that does.

    Categories are tested one by one with the row rule, so they are exact.  Numeric predicates take every
    bucket that their bounds reach; ``!=`` and columns with values that are no numbers prune nothing.
    """
    if not attribute.numeric:
        return {b for name, b in attribute.categories.items() if matches(node, {node.field: name})}
    every = set(range(attribute.usable_bins))
    if not attribute.all_numbers:
        return every | {attribute.usable_bins}
    texts = [node.value] if isinstance(node, Compare) else [node.low, node.high] if isinstance(node, Between) else list(node.values)
    numbers = [number(t) for t in texts]
    if None in numbers or isinstance(node, Compare) and node.op == "!=":
        return every
    places = [attribute.bucket(x) for x in numbers]
    if isinstance(node, In) or node == Compare(node.field, "==", texts[0]):
        return set(places)
    if isinstance(node, Between):
        return set(range(places[0], places[1] + 1)) if numbers[0] <= numbers[1] else set()
    return set(range(places[0], attribute.usable_bins)) if node.op[0] == ">" else set(range(places[0] + 1))


def boundary_buckets(node: Node, attribute: Attribute) -> set[int]:
    """Bucket sets by bucket number, as a bucket engine compiles them: strict bounds and ``!=`` leave out
    the literal's whole bucket.  For reports on that engine's errors; searches prune by ``allowed_buckets``."""
    if not attribute.numeric:
        return allowed_buckets(node, attribute)
    every = set(range(attribute.usable_bins))
    if isinstance(node, Compare):
        x = number(node.value)
        if x is None:
            raise FilterError(f"{node.field} needs a number")
        b = attribute.bucket(x)
        return {"==": {b}, "!=": every - {b}, ">": {i for i in every if i > b}, ">=": {i for i in every if i >= b}, "<": {i for i in every if i < b}, "<=": {i for i in every if i <= b}}[node.op]
    return allowed_buckets(node, attribute)


def representative_buckets(node: Node, attribute: Attribute) -> set[int]:
    """Buckets whose representative, evenly spaced from the least to the greatest value, matches."""
    if not attribute.numeric:
        return allowed_buckets(node, attribute)
    step = (attribute.max_value - attribute.min_value) / max(1, attribute.usable_bins - 1)
    return {b for b in range(attribute.usable_bins) if matches(node, {node.field: repr(attribute.min_value + b * step)})}


def bucket_column(node: Node, attributes: dict[str, Attribute], prefix: str = "fid_", compile_leaf=allowed_buckets) -> Column:
    """A test on the encoded columns ``<prefix><field>`` that holds wherever the filter does."""
    if isinstance(node, Logic):
        left, right = (bucket_column(x, attributes, prefix, compile_leaf) for x in (node.left, node.right))
        return left & right if node.op == "AND" else left | right
    if node.field not in attributes:
        raise FilterError(f"unknown field {node.field!r}")
    allowed = sorted(compile_leaf(node, attributes[node.field]))
    column = F.col(f"{prefix}{node.field}")
    if not allowed:
        return F.lit(False)
    if allowed == list(range(allowed[0], allowed[-1] + 1)):
        return column.between(allowed[0], allowed[-1])
    return column.isin(allowed)


def tree_buckets(node: Node, attribute: Attribute) -> set[int]:
    """Bucket set of a whole tree over one field: AND is intersection, OR is union."""
    if isinstance(node, Logic):
        left, right = tree_buckets(node.left, attribute), tree_buckets(node.right, attribute)
        return left & right if node.op == "AND" else left | right
    return allowed_buckets(node, attribute)
